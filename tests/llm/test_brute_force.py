"""Operators against plain re-statements of their contracts, over odd documents."""

import hashlib
import random
import re
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, common, decontaminate, exact_dedup, language_id, near_dedup, sharding, substring_dedup, token_counts, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows, parts=5):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(parts)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return brute.odd_documents(request.param)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return common.materialise(table(spark, rows), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_exact_dedup(docs, rows):
    assert collected(exact_dedup.exact_dedup(docs)) == sorted(brute.exact(rows), key=repr)


def test_exact_dedup_of_runs_over_many_partitions(spark):
    rows = [(k, "same  text" if k % 3 else f"other {k % 7}") for k in range(3000)]
    got = collected(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    assert got == sorted(brute.exact(rows), key=repr)


def test_exact_dedup_by_name(spark):
    rows = [("b", "x"), ("a", "x"), (None, "x"), ("c", None)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "key string, body string"), "key", "body")
    assert sorted((r.key or "", r.keep_id, r.group_size, r.kept) for r in got.collect()) == [("", "a", 3, False), ("a", "a", 3, True), ("b", "a", 3, False), ("c", "c", 1, True)]


def test_substring_dedup(docs, rows):
    assert collected(substring_dedup.substring_dedup(docs)) == sorted(brute.substring(rows), key=repr)


def test_substring_dedup_in_many_blocks_and_buckets(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", (2000, 2000))
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", (5000, 5000))
    assert collected(substring_dedup.substring_dedup(docs)) == sorted(brute.substring(rows), key=repr)


def test_substring_dedup_gives_the_kept_text(spark):
    shared = " ".join(f"w{k}" for k in range(14))
    got = substring_dedup.substring_dedup(spark.createDataFrame([(2, f"a {shared} b"), (1, f"{shared}")], "doc_id long, text string"), with_text=True)
    assert {r.doc_id: r.kept_text for r in got.collect()} == {1: shared, 2: "a b"}


def benchmark(rows):
    rng = random.Random(3)
    texts = [r[1] for r in rows if r[1]]
    items = [("q0", None), ("q1", ""), ("q2", "one"), (None, "one TWO"), ("q2", "hi.x1")]
    for k in range(12):
        w = rng.choice(texts).split()
        at = rng.randrange(len(w) or 1)
        items.append((f"q{k + 3}", "; ".join(w[at : at + rng.choice([2, 9, 10, 11, 25])])))
    return items


def test_decontamination(spark, docs, rows, monkeypatch):
    items = benchmark(rows)
    marked = spark.createDataFrame(items, "item_id string, text string")
    expected = sorted(brute.contamination(rows, items), key=repr)
    assert collected(decontaminate.digest(decontaminate.find_contamination(docs, marked))) == expected
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    assert collected(decontaminate.digest(decontaminate.find_contamination(docs, marked))) == expected


def test_decontamination_cuts_only_the_passages(spark):
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    marked = spark.createDataFrame([("q", passage)], "item_id string, text string")
    rows = [(1, f"Before! {passage.upper()}. After\n", 0, "x"), (2, "Untouched;  text\t", 5, "y"), (3, None, None, None), (4, passage, 1, None)]
    got = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, id string"), marked)
    assert sorted(map(tuple, got.collect())) == [(1, "Before! . After\n", 16, "x"), (2, "Untouched;  text\t", 5, "y"), (3, None, None, None), (4, "", 0, None)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(docs, rows, size):
    assert collected(near_dedup.near_dedup(docs, shingle=size)) == sorted(brute.near(rows, size), key=repr)


def test_near_dedup_in_crowded_keys(spark, monkeypatch):
    """Links that no hub shows, and keys with many components, go through the exact blocks."""
    monkeypatch.setattr(near_dedup, "LISTED", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 600)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(90):
        w = list(base)
        for j in rng.sample(range(60), rng.randrange(1, 12)):
            w[j] = f"v{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=2)
    assert collected(got) == sorted(brute.near(rows, 2), key=repr)


def hidden_links(n):
    """Trios h, x, y with h-x and x-y linked and h-y just not, h the smallest in every band that x and y share."""
    a, b = near_dedup._functions()
    rows, seed = [], 0
    while len(rows) < 3 * n:
        seed += 1
        x = [f"s{seed}w{k}" for k in range(101)]  # 100 pairs of words
        h, y = x[:-1], [f"s{seed}v{k}" for k in range(11)] + x[11:]
        trio = [" ".join(w) for w in (h, x, y)]
        of = [brute.shingles(t, 2) for t in trio]
        assert brute.linked(of[0], of[1]) and brute.linked(of[1], of[2]) and not brute.linked(of[0], of[2])
        bh, bx, by = (near_dedup.band_keys(near_dedup.minima(near_dedup.shingle_set(near_dedup._Words(), t, 2), a, b)) for t in trio)
        if (bx == by).any() and (bh == bx)[bx == by].all():
            rows += [(len(rows) + k, t) for k, t in enumerate(trio)]
    return rows


def test_near_dedup_links_past_the_hub(spark):
    """Of a key's two star edges one is within a component: the other pair of that key is verified all the same."""
    rows = hidden_links(5)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shingle=2)
    assert collected(got) == sorted(brute.near(rows, 2), key=repr)


def test_near_dedup_links_past_the_hub_of_a_crowded_key(spark, monkeypatch):
    """Beyond LISTED components too, members that only an edge within a component holds are compared."""
    monkeypatch.setattr(near_dedup, "LISTED", 1)
    rows = hidden_links(5)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shingle=2)
    assert collected(got) == sorted(brute.near(rows, 2), key=repr)


def around_a_hub(hub, j):
    """Sets of 100 words m and x: m shares 89 of 111 with the hub, x 89 of 111 with m and 87 of 113 with the hub."""
    m = hub[:88] + [hub[88 + j % 12]] + [f"m{j}_{k}" for k in range(11)]
    return m, m[:87] + m[89:91] + [f"x{j}_{k}" for k in range(11)]


def test_near_dedup_in_one_crowded_key(spark):
    """Far more components than LISTED share a passage, and half of the links run past the hub: with the default constants."""
    n, hub = 90, [f"c{k}" for k in range(100)]
    found = [around_a_hub(hub, j) for j in range(n)]
    rows = [(0, hub), *((1 + j, m) for j, (m, _) in enumerate(found)), *((1 + n + j, x) for j, (_, x) in enumerate(found))]
    got = near_dedup.near_dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3), shingle=1)
    assert {r.component_id for r in got.collect()} == {0}


def test_near_dedup_in_many_chains(spark):
    """Chains h, m, x with h-m and m-x linked and h-x not: with the default constants."""
    rows = []
    for j in range(80):
        hub = [f"c{j}_{k}" for k in range(100)]
        rows += [(3 * j + k, " ".join(w)) for k, w in enumerate((hub, *around_a_hub(hub, j)))]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=1)
    assert all(r.component_id == r.doc_id // 3 * 3 for r in got.collect())


@pytest.mark.parametrize("n", [20, 60, 90])
def test_near_dedup_sends_a_member_of_a_key_once(spark, monkeypatch, n):
    """The rows of a key with n components are its members and not its pairs, below LISTED and beyond it; all its links are found."""
    words = lambda k: [f"g{k // 2}_{j}" for j in range(50 - k % 2)]
    rows = spark.createDataFrame([(k, " ".join(words(k))) for k in range(n)], "id long, text string")
    stars = spark.createDataFrame([(7, 0, k, n - 1) for k in range(1, n)], "key long, a long, b long, edges long")
    labels = spark.createDataFrame([], "id long, was long, comp long")
    weights = spark.createDataFrame([(k, len(words(k))) for k in range(n)], "id long, n long")
    within = lambda: {(r.a, r.b) for r in near_dedup._within_keys(stars, stars.select("a", "b"), labels, rows, weights, 1, 80).collect()}
    assert within() | {(0, 1)} == {(k, k + 1) for k in range(0, n, 2)}

    def counted(*_):
        return lambda table: pa.table({"a": table.column("gid")[:1], "b": pa.array([table.num_rows])})

    monkeypatch.setattr(near_dedup, "_verify_block", counted)
    assert sum(sent for _, sent in within()) == n


def test_near_dedup_sends_rows_in_proportion_to_a_group(spark, monkeypatch):
    """One dense group of which few pairs are linked, at its size and at twice its size, against brute force; blocks and roles in one row included."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(160):
        w = list(base)
        for j in rng.sample(range(120), rng.randrange(8, 20)):
            w[j] = f"v{k}_{j}"
        texts.append((k, " ".join(w)))
    sent, real = [], common.materialise

    def seen(df, label):
        out = real(df, label)
        if label == "contesters":
            sent.append(out.count())
        return out

    monkeypatch.setattr(common, "materialise", seen)
    for n, block in ((80, 1024), (160, 1024), (160, 16)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = near_dedup.near_dedup(spark.createDataFrame(texts[:n], "doc_id long, text string").repartition(3), shingle=1)
        assert collected(got) == sorted(brute.near(texts[:n], 1), key=repr)
    assert all(s <= (near_dedup.BANDS + 1) * n for s, n in zip(sent, (80, 160, 160), strict=True))


def test_near_dedup_finds_every_link_of_whole_documents(spark):
    """Recall against an exact join of all pairs of texts, with shingles of five words."""
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = list(zip(docs["doc_id"], docs["text"]))
    got = near_dedup.near_dedup(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert collected(got) == sorted(brute.near(rows, 5), key=repr)


def test_posterior_bound_is_the_chosen_probability():
    from math import comb

    least = near_dedup.least_matches(0.8, 0.01)
    for n, m in zip(range(16, 65, 16), least):
        tail = lambda m: sum(comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(m + 1))
        assert tail(m) >= 0.01 > (tail(m - 1) if m else 0)


def test_bpe_of_documents(docs, rows):
    library = Tokenizer.from_file(PATH)
    expected = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        expected.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(library.decode(ids, skip_special_tokens=False))))
    assert collected(bpe.encode_documents(docs, PATH, digests=True, lexicon=20)) == sorted(expected, key=repr)
    assert collected(bpe.encode_documents(docs, PATH, digests=True, lexicon=0)) == sorted(expected, key=repr)
    decoded = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH)
    assert sorted((str(r.doc_id), brute.sha(r.text)) for r in decoded.collect()) == sorted((str(e[0]), e[3]) for e in expected)


def test_token_counts_of_documents(docs, rows):
    counts = token_counts.Counts(token_counts.Pieces(public_tokenizers.path("piece_bpe_32k.model")))
    expected = [(r[0], sum(map(counts.__getitem__, p)), len(p)) for r in rows for p in [token_counts.pre_tokens(r[1]) if r[1] else []]]
    assert collected(token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))) == sorted(expected, key=repr)


def test_sharding(docs, rows):
    import zlib

    got = sharding.assign_shards(docs, 16).collect()
    texts = lambda r: ((r[1] or "").encode())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r[0]), len(texts(r)) + 1, zlib.crc32(texts(r))) for r in rows)
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
    assert all(x == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert collected(sharding.assign_shards(docs.repartition(3), 16)) == sorted(map(tuple, got), key=repr)  # whatever the partitions


def test_sharding_of_very_many_equal_rows(spark, monkeypatch):
    """A row without an identifier and text that stands there very often is dealt out like any other."""
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(None, None)] * 3000 + [(k % 40, "t") for k in range(500)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 16).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), 1 + len(t or ""), 2238339752 if t else 0) for i, t in rows)
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
    assert all(x == list(range(len(x))) for x in slots.values()) and {len(x) for x in slots.values()} == {218, 219}
    nulls = [sum(r.doc_id is None for r in got if r.shard == s) for s in range(16)]
    assert max(nulls) - min(nulls) < 60  # 187.5 each, with a standard deviation of 5
    assert collected(sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 16)) == sorted(map(tuple, got), key=repr)


def test_sharding_is_uniform(spark):
    """Where row 0 goes, and whether rows 0 and 1 share a shard, over many seeds."""
    rng = np.random.default_rng(0)
    counts, times, together = np.zeros(4), 2000, 0
    for seed in rng.integers(0, 1 << 30, times):
        matrix = sharding.communication_matrix([3, 2, 4], 4, int(seed))
        assert matrix.sum(1).tolist() == [3, 2, 4] and sorted(matrix.sum(0)) == [2, 2, 2, 3]
        counts += matrix[1]
        together += (matrix[1] == 2).any()
    expected = times * 2 * np.array([3, 2, 2, 2]) / 9
    assert (abs(counts - expected) < 5 * np.sqrt(expected)).all()
    share = (3 + 1 + 1 + 1) / 36  # pairs within a shard among all pairs of nine rows
    assert abs(together / times - share) < 5 * np.sqrt(share / times)


def test_large_hypergeometric_draws_have_the_right_moments():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 10**9, 40_000
    x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(3000)])
    spread = np.sqrt(n * 0.75 * 0.25)
    assert abs(x.mean() - 0.75 * n) < 5 * spread / np.sqrt(3000) and 0.93 < x.std() / spread < 1.07


def test_shards_are_written_in_slot_order(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k}", f"s{k}") for k in range(50)], "doc_id long, text string, shard_name string")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [12, 12, 13, 13]
    assert sorted(r.doc_id for r in got.collect()) == list(range(50))


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    plain = [a + b for a in "bcdfgh" for b in ("ona", "eru", "ilo", "asti")]
    out = []
    for k in range(n):
        toxic, poor = rng.random() < 0.2, rng.random() < 0.3
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        w += [rng.choice(["moron", "scumbag", "vileness"]) for _ in range(2)] * toxic + ["zzz"] * poor
        rng.shuffle(w)
        out.append((k, " ".join(w), int(not poor), int(toxic)))
    return out


def test_toxicity_on_documents_without_labels(spark):
    rows = toxic_corpus(1500, 1)
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, id string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[:700]] + [(5, None, None), (None, 1, 1), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, toxicity.chain_of_labels())
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 1500 and all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in got.values())
    assert sum(got[r[0]].toxic == bool(r[3]) for r in rows[700:]) / 800 > 0.98
    assert sorted(map(tuple, toxicity.keep_clean(docs, model).collect())) == sorted((r[0], r[1], "x") for r in rows if not got[r[0]].toxic)
    again = toxicity.train(docs.repartition(3), labels, toxicity.chain_of_labels())
    assert again[2] == model[2] and all((a == b).all() for x, y in zip(again[0], model[0]) for a, b in zip(x[:3], y[:3]))


def test_chain_learns_from_out_of_fold_probabilities():
    """A second category that equals the first can't be read off what the first remembers of noise."""
    rng = np.random.default_rng(0)
    n = 400
    sets = [np.unique(rng.integers(0, 1 << 20, 30)).astype(np.uint32) for _ in range(n)]  # nothing to learn
    y = rng.integers(0, 2, n)
    models, _ = toxicity.fit_chain(sets, np.stack([y, y], 1), np.arange(n) % 3)
    assert abs(models[1].chain[0]) < 1.5


def test_toxicity_of_odd_documents(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], k % 2, int(k % 5 == 0)) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels, toxicity.chain_of_labels())).collect()
    assert sorted(map(str, (r.doc_id for r in scored))) == sorted(str(r[0]) for r in rows)
    none = toxicity.train(docs, labels.limit(0), toxicity.chain_of_labels())
    assert not any(r.toxic for r in toxicity.score(docs, none).collect())
    assert toxicity.keep_clean(docs, none).count() == len(rows) and toxicity.keep_clean(docs, none).columns == docs.columns


LANGS = {"aa": "mara tovi nelo basu kiri doma", "bb": "strink glupth wemps drazz quilf hroj", "cc": "éaué üöwo ñañi çoça øløg šiši"}


def test_language_identification(spark):
    rng = random.Random(2)
    text = lambda lang, n: " ".join(rng.choice(LANGS[lang].split()) for _ in range(n))
    rows = [(k, text(lang, rng.randrange(3, 40)), lang) for k in range(600) for lang in [rng.choice(list(LANGS))]]
    rows += [(1000, None, "aa"), (1001, "12 !?", "aa"), (1002, "", None), (1003, f"{text('aa', 30)} {text('bb', 60)}", None), (None, text("cc", 9), "cc"), (1004, text("bb", 20000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = language_id.identify(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(by[r[0]].lang_pred == r[2] for r in rows[:600])
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1004].lang_pred == "bb" and by[None].held_out
    shares = {x.lang: x.share for x in by[1003].languages}
    assert set(shares) == {"aa", "bb"} and abs(shares["bb"] - 2 / 3) < 0.12 and by[1003].lang_pred == "bb"
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)


def test_language_mixtures_match_a_plain_inference(spark):
    """Every document's EM, chosen set, language and score, one trigram after another: pure, mixed, blank and odd texts."""
    rng = random.Random(6)
    text = lambda lang, n: " ".join(rng.choice(LANGS[lang].split()) for _ in range(n))
    rows = []
    for k in range(150):
        parts = rng.sample(list(LANGS), rng.choice([1, 1, 2, 3]))
        rows.append((k, " ".join(text(x, rng.randrange(1, 25)) for x in parts), parts[0] if len(parts) == 1 else None))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "7 ?!", "cc"), (903, "MARA Tovi x", None), (None, text("bb", 5), "bb"), (904, "😀𝔸mara İ", "aa"), (905, "zzz qqq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(got) == len(rows)
    for i, held, lang, score, shares in brute.languages(rows):
        r = got[i]
        assert (r.held_out, r.lang_pred) == (held, lang) and r.score == pytest.approx(score, abs=1e-6), i
        assert {x.lang: x.share for x in r.languages} == pytest.approx(shares, abs=1e-6), i


def test_language_identification_never_reads_held_out_labels(spark):
    import zlib

    held = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 5 == 0]
    docs = spark.createDataFrame([(k, "mara tovi", "aa") for k in held], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(docs).collect()} == {"und"}


def test_a_text_of_many_megabytes(spark):
    """Whole, whatever its length: one text of 21 MB, its near copy, and a short text that shares a passage with both."""
    rng = random.Random(9)
    vocabulary = [f"w{k:05d}" for k in range(50_000)]
    long = rng.choices(vocabulary, k=3_000_000)
    passage = [f"p{k}" for k in range(60)]
    long[2_900_000:2_900_000] = passage
    near = list(long)
    near[17] = "other"
    rows = [(1, " ".join(passage)), (2, " ".join(long)), (3, " ".join(near))]
    docs = common.materialise(spark.createDataFrame(rows, "doc_id long, text string"), "long")
    n = len(long)
    assert len(rows[1][1]) > 20_000_000
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect()}
    assert removed == {1: (60, 0), 2: (n, 60), 3: (n, n - 1)}
    items = spark.createDataFrame([("q", " ".join(passage[20:45]))], "item_id string, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.digest(decontaminate.find_contamination(docs, items)).collect()}
    assert hits == {1: (60, 25), 2: (n, 25), 3: (n, 25)}
    sizes = {i: len(set(zip(w, w[1:]))) for i, w in ((1, passage), (2, long), (3, near))}
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs, shingle=2).collect()}
    assert groups == {1: (sizes[1], 1), 2: (sizes[2], 2), 3: (sizes[3], 2)}
    counts = token_counts.Counts(token_counts.Pieces(public_tokenizers.path("piece_bpe_32k.model")))
    tokens = lambda words: sum(n * counts[token_counts.SPACE + w] for w, n in Counter(words).items())
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()} == {1: tokens(passage), 2: tokens(long), 3: tokens(near)}


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "item_id string, text string")
    results = [
        exact_dedup.exact_dedup(empty),
        substring_dedup.substring_dedup(empty),
        decontaminate.digest(decontaminate.find_contamination(empty, none)),
        near_dedup.near_dedup(empty),
        bpe.encode_documents(empty, PATH),
        token_counts.count_tokens(empty, public_tokenizers.path("piece_bpe_32k.model")),
        sharding.assign_shards(empty),
        language_id.identify(empty),
        toxicity.score(empty, toxicity.train(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"), toxicity.chain_of_labels())),
        decontaminate.clean(empty, none),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_an_empty_benchmark_changes_nothing(spark, docs, rows):
    none = spark.createDataFrame([], "item_id string, text string")
    assert collected(decontaminate.clean(docs, none)) == sorted(rows, key=repr)
    assert not re.search("True", str(collected(decontaminate.digest(decontaminate.find_contamination(docs, none)).select("contaminated"))))
    assert docs.where(F.col("doc_id").isNull()).count() == 3


def test_the_sample_is_bounded_by_bytes(spark):
    rows = toxic_corpus(400, 3)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    fitted = lambda b: sum(len(m[0]) for m in toxicity.train(docs, labels, toxicity.chain_of_labels(), sample_bytes=b)[0])
    assert fitted(1) == 0 < fitted(1 << 20)


def test_a_long_text_displaces_no_other_from_the_sample(spark):
    rows = toxic_corpus(400, 3)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    first = labels.orderBy(F.xxhash64("doc_id")).first().doc_id
    docs = spark.createDataFrame([(r[0], "ona " * 300_000 if r[0] == first else r[1]) for r in rows], "doc_id long, text string")
    got = toxicity.score(docs, toxicity.train(docs, labels, toxicity.chain_of_labels(), sample_bytes=1 << 20)).collect()
    assert sum(r.toxic == bool(rows[r.doc_id][3]) for r in got if r.doc_id != first) / 399 > 0.98
