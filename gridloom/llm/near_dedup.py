"""MinHash near-deduplication with sequential Bayesian verification.

1. Every document becomes its set of word shingles (64-bit hashes).  Documents with one and the same set form a class, and only
   the class's smallest identifier goes on.
2. A class gets ``BANDS`` band keys of ``ROWS`` minima each, and ``CHECKS`` further minima of 16 bits.  With 40 bands of 6, a
   pair at similarity 0.8 has no common key with a probability of 5e-6.
3. Members of one band key are joined in a star around the smallest one, first within a map block and then among the blocks'
   hubs, so a key that a third of all documents share costs a row for each document and never a row for each pair.
4. A candidate pair's checks are compared in batches of 16.  After m of n matches the similarity has the posterior
   Beta(m + 1, n - m + 1); a pair is pruned once its posterior probability of reaching the threshold is below ``MISS``.
5. Survivors are verified on their full sets: first the best hub of each document, then all that still joins two components.
6. A star says nothing about two members that both differ from its hub.  Where a key still holds several components, all its
   other pairs are verified on full sets too, in blocks that count common shingles with array operations; nothing is sampled.
   A key's members go there once each.  Its pairs of components are listed, which spares meeting again in other keys, only
   where that asks about no more documents than the key has members.
7. Components come from minimum labels with pointer jumping; every round is a written table.

So step 6 sends a row at most for each document and for each member of a key, times the blocks of a key past ``BLOCK`` members;
its comparisons, within the blocks, are the number of a key's outsiders times its members.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a text of fewer words than a shingle is
its whole sequence; rows without an identifier don't link others, and take the component of a document with an equal set, else
null; identifiers are taken to be unique, and repeated rows are reported as often as they stand there; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROWS, BANDS, CHECKS, BATCH = 6, 40, 64, 16
#: Chosen probability of pruning a pair that reaches the threshold.
MISS = 1e-7
#: Identifiers up to this number (8 MB) are broadcast to pick texts; beyond it the join is shuffled.
BROADCAST_IDS = 1 << 20
#: Components of one key up to which their pairs are listed; members and shingles of a block in step 6.
LISTED, BLOCK, BLOCK_SHINGLES = 64, 1024, 1 << 20
#: Bytes of keys in a bucket, about.
BUCKET_BYTES = 32 << 20
#: Documents of a map block.
FLUSH = 4096

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(known: dict, text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles: words of white space, A-Z in lower case."""
    words = text.encode().lower().split() if text else []
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h)
    if not n:
        return h
    k = min(size, n)
    total = h[: n - k + 1].copy()
    for j in range(1, k):
        total = _mixed(total * _A + h[j : n - k + 1 + j] * _B)
    return np.unique(_mixed(total + np.uint64(k)))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(8))
    k = ROWS * BANDS + CHECKS
    return rng.integers(0, 1 << 32, (k, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (k, 1), dtype=np.uint64).astype(np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set; half of the functions take the other half of the bits."""
    half = len(a) // 2
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(shingles), 2048):
        for x, rows in ((low, slice(0, half)), (high, slice(half, None))):
            v = x[None, k : k + 2048] * a[rows]
            v += b[rows]
            out[rows] = np.minimum(out[rows], v.min(1))
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different bands apart."""
    rows = low[: ROWS * BANDS].reshape(ROWS, BANDS).astype(np.uint64)  # a band has rows of both halves
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in rows:
        key = _mixed(key * _A + r)
    return key


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For 16, 32, ... checks: the fewest matches at which P(similarity >= threshold) is still ``miss`` or more.

    The posterior tail of Beta(m + 1, n - m + 1) is the probability of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(BATCH, CHECKS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _describe(size: int):
    """The task: id, text, mark to id, mark, n, the set's digest, band keys, checks."""

    def task(batches):
        known = _Words()
        a, b = _functions()
        for batch in batches:
            n, sets, bands, checks = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(known, text, size)
                n.append(len(s))
                if len(s):
                    low = minima(s, a, b)
                    sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(low).tobytes())
                    checks.append(low[ROWS * BANDS :].astype(np.uint16).tobytes())
                else:
                    sets.append(None)
                    bands.append(None)
                    checks.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.binary()), pa.array(checks, pa.binary())], names=["id", "mark", "n", "set_key", "bands", "checks"])

    return task


def _stars(keys: np.ndarray, ids: np.ndarray):
    """Star edges (key, hub, other) and the hubs (key, hub) of equal keys."""
    by = np.lexsort((ids, keys))
    keys, ids = keys[by], ids[by]
    new = np.ones(len(by), bool)
    new[1:] = keys[1:] != keys[:-1]
    hub = ids[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    edge = ~new & (hub != ids)
    edge[1:] &= ~((keys[1:] == keys[:-1]) & (ids[1:] == ids[:-1]))
    return (keys[edge], hub[edge], ids[edge]), (keys[new], ids[new])


def _send_keys(buckets: int):
    """The task: id, bands to packed hubs by bucket (kind 0) and finished edges (kind 1)."""

    def task(batches):
        held: list[tuple] = []
        count = 0

        def flush():
            keys = np.concatenate([k for k, _ in held])
            ids = np.concatenate([np.repeat(i, BANDS) for _, i in held])
            edges, (hub_keys, hubs) = _stars(keys, ids)
            cuts = np.searchsorted(((hub_keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cuts))
            rows = [(int(b), hub_keys[cuts[b] : cuts[b + 1]].tobytes(), hubs[cuts[b] : cuts[b + 1]].tobytes(), None) for b in full]
            ecut = np.searchsorted(((edges[0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            rows += [(int(b), *(x[ecut[b] : ecut[b + 1]].tobytes() for x in edges)) for b in np.flatnonzero(np.diff(ecut))]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)], names=["bucket", "keys", "hubs", "others"])

        for batch in batches:
            bands = batch.column("bands")
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids):
                held.append((np.frombuffer(b"".join(bands.to_pylist()), np.uint64), ids))
                count += len(ids)
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    return task


def _join_stars(table: pa.Table) -> pa.Table:
    """Of one bucket: all star edges, those among the blocks' hubs too, each with the number of its key's edges."""
    get = lambda name, rows, kind: np.concatenate([np.frombuffer(x, kind) for x in rows[name]] or [np.zeros(0, kind)])
    rows = table.to_pydict()
    made = [k for k, x in enumerate(rows["others"]) if x is not None]
    open_ = [k for k, x in enumerate(rows["others"]) if x is None]
    pick = lambda ks: {n: [rows[n][k] for k in ks] for n in ("keys", "hubs", "others")}
    done, sent = pick(made), pick(open_)
    edges, _ = _stars(get("keys", sent, np.uint64), get("hubs", sent, np.int64))
    parts = [np.concatenate([x, get(n, done, k)]) for x, n, k in zip(edges, ("keys", "hubs", "others"), (np.uint64, np.int64, np.int64), strict=True)]
    _, of, count = np.unique(parts[0], return_inverse=True, return_counts=True)  # a key is in one bucket
    return pa.table({"key": pa.array(parts[0].view(np.int64)), "a": pa.array(parts[1]), "b": pa.array(parts[2]), "edges": pa.array(count[of])})


def _prune(least: list[int]):
    """The task: a, b, checks_a, checks_b to a, b, matches of the pairs that the posterior doesn't rule out."""

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, CHECKS) for c in ("checks_a", "checks_b"))
            live, matches = np.arange(len(x)), np.zeros(len(x), np.int32)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[live] += (x[live, part] == y[live, part]).sum(1, dtype=np.int32)
                live = live[matches[live] >= m]
            keep = pa.array(live)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep), pa.array(matches[live])], names=["a", "b", "matches"])

    return task


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(size: int, percent: int):
    """The task: a, b, text_a, text_b to the linked pairs."""

    def task(batches):
        known = _Words()
        last, of = object(), None
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                if a != last:
                    last, of = a, shingle_set(known, ta, size)
                if _linked(of, shingle_set(known, tb, size), percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return task


def _verify_block(size: int, percent: int):
    """Of one block: links of each query to the members, one for each component of theirs.

    Common shingles of a query with all members are counted at once, over the members' sets laid end to end.
    """

    def task(table: pa.Table) -> pa.Table:
        known = _Words()
        rows = table.select(["id", "comp", "base", "asks", "text"]).to_pydict()
        sets = [shingle_set(known, t, size) for t in rows["text"]]
        base = [k for k, b in enumerate(rows["base"]) if b]
        out = []
        if base:
            sizes = np.array([len(sets[k]) for k in base])
            every, place = np.unique(np.concatenate([sets[k] for k in base]), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ids, comps = np.array([rows["id"][k] for k in base]), np.array([rows["comp"][k] for k in base])
            for k, asks in enumerate(rows["asks"]):
                if not asks:
                    continue
                at = np.minimum(np.searchsorted(every, sets[k]), len(every) - 1)
                mark = np.zeros(len(every), np.int32)
                mark[at[every[at] == sets[k]]] = 1
                both = np.add.reduceat(mark[place], starts)
                hit = np.flatnonzero((100 * both >= percent * (len(sets[k]) + sizes - both)) & (comps != rows["comp"][k]))
                _, first = np.unique(comps[hit], return_index=True)
                out += [(min(rows["id"][k], int(y)), max(rows["id"][k], int(y))) for y in ids[hit[first]]]
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return task


def components(links: DataFrame) -> DataFrame:
    """A written table (id, was, comp): the smallest identifier of each linked document's component."""
    spark = links.sparkSession
    both = common.materialise(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "links")
    labels = common.materialise(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("y")).select("id", F.least("id", "y").alias("comp")), "labels")
    while True:
        near = both.join(labels.select("id", "comp"), both["y"] == labels["id"]).groupBy("x").agg(F.min("comp").alias("other"))
        lower = labels.join(near, labels["id"] == near["x"]).select("id", F.col("comp").alias("was"), F.least("comp", "other").alias("comp"))
        up = labels.select(F.col("id").alias("root"), F.col("comp").alias("above"))
        new = common.materialise(lower.join(up, lower["comp"] == up["root"]).select("id", "was", F.least("comp", "above").alias("comp")), "labels")
        common.release(labels)
        labels = new
        if not new.where("comp <> was").limit(1).count():
            common.release(both)
            return labels


def _with_comp(df: DataFrame, labels: DataFrame, col: str, out: str) -> DataFrame:
    found = labels.select(F.col("id").alias("_id"), F.col("comp").alias("_comp"))
    return df.join(found, F.col(col) == F.col("_id"), "left").withColumn(out, F.coalesce("_comp", col)).drop("_id", "_comp")


def _texts_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the wanted documents.  Few identifiers are broadcast, after a count; many are joined by a shuffle."""
    ids = common.materialise(ids.distinct(), "wanted")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(wanted, "id", "left_semi")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, mark: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept and, if given, the whole number ``mark`` of the row."""
    common.bounded_batches(docs.sparkSession)
    with common.temporary(docs.sparkSession) as kept:
        described, classes, labels = _linked_components(docs, id_col, text_col, shingle, percent, F.lit(None) if mark is None else mark)
        kept += [described, classes, labels]
    member = described.select("id", "mark", "n", "set_key").join(classes.select(F.col("set_key").alias("of"), F.col("id").alias("rep")), F.col("set_key") == F.col("of"), "left")
    found = _with_comp(member.withColumn("rep", F.coalesce("rep", "id")), labels, "rep", "component_id")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), *(["mark"] if mark is not None else []))


def _linked_components(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, mark: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: each row's description, the classes, the components of those that are linked."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = common.materialise(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), mark.cast("long").alias("mark")).mapInArrow(_describe(shingle), "id long, mark long, n long, set_key binary, bands binary, checks binary"), "minhash")
    classes = described.where("set_key IS NOT NULL AND id IS NOT NULL").groupBy("set_key").agg(F.min_by(F.struct("bands", "checks", "n"), "id").alias("s"), F.min("id").alias("id"))
    classes = common.materialise(classes.select("id", "set_key", "s.bands", "s.checks", "s.n"), "classes")
    buckets = max(2 * common.partitions(spark), -(-16 * BANDS * classes.count() // BUCKET_BYTES))
    stars = classes.select("id", "bands").mapInArrow(_send_keys(buckets), "bucket int, keys binary, hubs binary, others binary")
    stars = common.materialise(stars.groupBy("bucket").applyInArrow(_join_stars, "key long, a long, b long, edges long"), "stars")
    pairs = stars.select("a", "b").distinct()
    checks = classes.select("id", "checks")
    known = pairs.join(checks.select(F.col("id").alias("a"), F.col("checks").alias("checks_a")), "a").join(checks.select(F.col("id").alias("b"), F.col("checks").alias("checks_b")), "b")
    survivors = common.materialise(known.select("a", "b", "checks_a", "checks_b").mapInArrow(_prune(least_matches(percent / 100)), "a long, b long, matches int"), "survivors")
    texts = common.materialise(_texts_of(rows, survivors.select(F.col("a").alias("id")).union(survivors.select("b"))).dropDuplicates(["id"]), "texts")

    def verified(candidates: DataFrame) -> DataFrame:
        candidates = common.materialise(candidates.select("a", "b"), "candidates")
        some = common.materialise(_texts_of(texts, candidates.select(F.col("a").alias("id")).union(candidates.select("b"))), "texts")
        with_b = candidates.join(some.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        full = with_b.join(some.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        return common.materialise(full.select("a", "b", "text_a", "text_b").mapInArrow(_verify(shingle, percent), "a long, b long"), "linked")

    best = survivors.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a"))
    links = verified(best)
    labels = components(links)
    apart = _with_comp(_with_comp(survivors, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb").select("a", "b").join(best, ["a", "b"], "left_anti")
    links = links.union(verified(apart))
    labels = components(links)
    more = common.materialise(_within_keys(stars, pairs, labels, rows, classes.select("id", "n"), shingle, percent), "linked")
    if more.limit(1).count():
        labels = components(links.union(more))
    return described, classes, labels


def _contests_of(table: pa.Table) -> pa.Table:
    """Of one key: each pair of its components (LISTED at most) as the larger one and the smaller one, or else the key.

    All members of the smaller one are asked about; where these are more rows than the key's members, the key goes by itself.
    """
    comps, sizes = (table.column(c).to_numpy() for c in ("comp", "size"))
    by = np.lexsort((comps, -sizes))
    comps, sizes = comps[by], sizes[by]
    if np.arange(len(by)) @ sizes > table.column("members")[0].as_py():
        return pa.table({"key": table.column("key")[:1], "gid": pa.nulls(1, pa.int64()), "small": pa.nulls(1, pa.int64()), "alone": pa.nulls(1, pa.bool_())})
    i, j = np.triu_indices(len(by), 1)
    return pa.table({"key": pa.nulls(len(i), pa.int64()), "gid": pa.array(comps[i]), "small": pa.array(comps[j]), "alone": pa.array(sizes[i] == 1)})


def _within_keys(stars: DataFrame, pairs: DataFrame, labels: DataFrame, rows: DataFrame, weights: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between members of one key whose components differ so far and that no star compared."""
    several = stars.where("edges > 1")  # a star of one edge has been compared
    placed = common.materialise(_with_comp(_with_comp(several, labels, "a", "ca"), labels, "b", "cb"), "placed")
    both = lambda edges: edges.select("key", "edges", F.col("a").alias("id"), F.col("ca").alias("comp")).union(edges.select("key", "edges", "b", "cb"))
    ends = both(placed.where("ca <> cb"))
    keys = common.materialise(ends.groupBy("key").agg(F.approx_count_distinct("comp", 0.05).alias("n")), "keys")
    few = ends.join(keys.where(f"n <= {LISTED}").select("key"), "key").select("key", "comp", (F.col("edges") + 1).alias("members")).distinct()
    sizes = labels.groupBy("comp").agg(F.count("*").alias("size"))
    few = few.join(sizes, "comp", "left").fillna(1, ["size"]).select("key", "comp", "size", "members")
    contests = common.materialise(few.groupBy("key").applyInArrow(_contests_of, "key long, gid long, small long, alone boolean").distinct(), "contests")
    compared = pairs.select(F.col("a").alias("gid"), F.col("b").alias("small"), F.lit(True).alias("alone"))
    listed = common.materialise(contests.where("gid IS NOT NULL").join(compared, ["gid", "small", "alone"], "left_anti").select("gid", "small"), "listed")
    everyone = labels.select("id", "comp")

    def members(comps: DataFrame) -> DataFrame:
        """(gid, id, comp) of the components' members; a document without a link is its own."""
        comps = comps.select("gid", F.col("of").alias("_of"))
        return comps.join(everyone, F.col("_of") == F.col("comp"), "left").select("gid", F.coalesce("id", "_of").alias("id"), F.col("_of").alias("comp"))

    role = lambda base, asks: (F.lit(base).alias("base"), F.lit(asks).alias("asks"))
    asked = members(listed.select("gid", F.col("gid").alias("of")).distinct()).select("*", *role(True, False))
    asking = members(listed.select("gid", F.col("small").alias("of"))).select("*", *role(False, True))
    # the other keys: all members once, by the key itself; those of its largest component are asked about only
    others = keys.where(f"n > {LISTED}").select("key").union(contests.where("key IS NOT NULL").select("key"))
    crowd = common.materialise(both(placed.join(others, "key")).select(F.col("key").alias("gid"), "id", "comp").distinct(), "crowd")
    largest = crowd.groupBy("gid", "comp").agg(F.count("*").alias("size")).groupBy("gid").agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"))
    crowd = crowd.join(largest, "gid").select("gid", "id", "comp", F.lit(True).alias("base"), (F.col("comp") != F.col("largest")).alias("asks"))
    base = common.materialise(asked.union(asking).union(crowd).join(weights, "id"), "contesters")

    def needed(role: str):
        """Blocks of a gid's members, bounded by their number and by their shingles."""
        of = lambda c: F.sum(F.when(F.col(role), c).otherwise(0))
        return F.greatest(F.lit(1), F.ceil(of(F.lit(1)) / BLOCK), F.ceil(of(F.col("n")) / BLOCK_SHINGLES)).cast("int")

    blocks = common.materialise(base.groupBy("gid").agg(needed("base").alias("base_blocks"), needed("asks").alias("asks_blocks")), "blocks")  # a plain join below, which may be split where a gid is hot
    own = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    dealt = base.join(blocks, "gid").withColumns({"row": own("base_blocks"), "column": own("asks_blocks")})
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    at = lambda i, j, base, asks: F.struct(i.alias("i"), j.alias("j"), base.alias("base"), asks.alias("asks"))
    # block i of the base meets block j of those who ask; a member with both roles is once where its own two blocks meet
    as_base = F.transform(F.filter(every("asks_blocks"), lambda j: F.col("base")), lambda j: at(F.col("row"), j, F.lit(True), F.col("asks") & (j == F.col("column"))))
    as_asking = F.transform(F.filter(every("base_blocks"), lambda i: F.col("asks") & (~F.col("base") | (i != F.col("row")))), lambda i: at(i, F.col("column"), F.lit(False), F.lit(True)))
    dealt = dealt.select("gid", "id", "comp", F.explode(F.concat(as_base, as_asking)).alias("at")).select("gid", "id", "comp", "at.*")
    texts = _texts_of(rows, base.select("id")).dropDuplicates(["id"])
    return dealt.join(texts, "id").groupBy("gid", "i", "j").applyInArrow(_verify_block(shingle, percent), "a long, b long").distinct()
