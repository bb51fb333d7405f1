import random

import public_tokenizers
import pytest
import sentencepiece

from gridloom.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return tc.Pieces(PATH)


def brute(pieces, text):
    """The recurrence over the whole text, without pre-tokens, a trie or an automaton."""
    text = tc.SPACE + text.replace(" ", tc.SPACE)
    longest = max(map(len, pieces.score))
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        top = None
        for start in range(max(0, end - longest), end):
            s = pieces.score.get(text[start:end])
            if s is not None and (top is None or best[start][0] + s > top[0]):
                top = (best[start][0] + s, best[start][1] + 1)
        if text[end - 1] not in pieces.score:
            s = best[end - 1][0] + pieces.unknown
            if top is None or s > top[0]:
                top = (s, best[end - 1][1] + len(text[end - 1].encode()))
        best.append(top)
    return best[-1][1]


def as_unigram():
    """The file with its model type set to unigram, for the library."""
    raw, out, at = open(PATH, "rb").read(), bytearray(), 0

    def varint(b, i):
        n = shift = 0
        while True:
            n |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if b[i - 1] < 128:
                return n, i

    def put(n):
        o = bytearray()
        while n > 127:
            o.append(n & 127 | 128)
            n >>= 7
        return bytes([*o, n])

    while at < len(raw):
        tag, i = varint(raw, at)
        size, i = varint(raw, i)
        body = raw[i : i + size]
        if tag >> 3 == 2:  # the trainer's settings; of a field given twice the last counts
            body += put(3 << 3) + put(1)
        out += put(tag) + put(len(body)) + body
        at = i + size
    p = sentencepiece.SentencePieceProcessor()
    p.LoadFromSerializedProto(bytes(out))
    return p


def words(rng, n):
    return " ".join(rng.choice(["the", "ontion", "Erheble", "réeuxch", "achlich", "it's", "x|y", "ñandú", "ingoron", "aaaaaaa"]) + rng.choice(["", ".", ","]) for _ in range(n))


def test_matches_the_library_as_unigram():
    pieces = tc.Pieces(PATH, stored=True)
    library, counts = as_unigram(), tc.Counts(pieces)  # the library adds in 32 bits, so only single words are exact there
    for word in ("the", "ontion", "Erheble", "réeuxch", "achlich", "it's", "x|y", "ñandú", "ingoron", "aaaaaaa", "disgusting"):
        for end in ("", ".", ",", "!?"):
            best = library.nbest_encode_as_pieces(word + end, 40)  # the first are the best; of equal ones any may come first
            score = lambda found: sum(map(pieces.score.__getitem__, found))
            assert sum(map(counts.__getitem__, tc.pre_tokens(word + end))) in {len(x) for x in best if score(x) == score(best[0])}


def test_matches_brute_force(pieces):
    counts, rng = tc.Counts(pieces), random.Random(2)
    texts = ["", " ", "  a   b ", "\n\n", "a\nb \n c", "你好世界 𝟘😀x", "\x00\t", "▁▁ x", "z" * 700, "no" * 300 + " end"]
    texts += [words(rng, 6) for _ in range(50)] + ["".join(rng.choice("ab \né😀t") for _ in range(40)) for _ in range(200)]
    for text in texts:
        if text:
            assert sum(map(counts.__getitem__, tc.pre_tokens(text))) == brute(pieces, text), repr(text)


def test_memory_is_bounded(pieces, monkeypatch):
    monkeypatch.setattr(tc, "NODES", 50)
    counts, rng = tc.Counts(pieces), random.Random(4)
    for _ in range(100):
        text = words(rng, 3)
        assert sum(map(counts.__getitem__, tc.pre_tokens(text))) == brute(pieces, text)
    assert len(counts.trie.best) < 50 + tc.LONG


def test_scores_follow_the_law_of_ranks(pieces):
    import math

    stored = tc.Pieces(PATH, stored=True).score
    assert math.fsum(map(math.exp, pieces.score.values())) == pytest.approx(1)
    by = sorted(stored, key=lambda p: -stored[p])
    assert all(pieces.score[a] > pieces.score[b] for a, b in zip(by, by[1:]) if stored[a] > stored[b])
    assert pieces.score[by[0]] - pieces.score[by[9]] == pytest.approx(math.log((10 + tc.SHIFT) / (1 + tc.SHIFT)))


def test_counts_are_near_those_of_the_files_own_tokenizer(pieces):
    import pyarrow.parquet as pq

    own, counts = sentencepiece.SentencePieceProcessor(model_file=PATH), tc.Counts(pieces)
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t]
    of = lambda t: sum(map(counts.__getitem__, tc.pre_tokens(t)))
    assert [of("hello world this is  a test"), of("The international organisation, 2024.")] == [8, 10]
    assert abs(sum(map(of, texts)) / sum(map(len, own.encode(texts))) - 1) < 0.03


def test_registered_query(spark, pieces):
    """Every whole text, by the plain recurrence."""
    import pyarrow.parquet as pq

    from gridloom.llm import queries

    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    want = {i: brute(pieces, t) if t else 0 for i, t in zip(docs["doc_id"], docs["text"])}
    assert {r.doc_id: r.n_tokens for r in queries.op10_token_counts(spark, "/root/testdata/sf0.001").collect()} == want
