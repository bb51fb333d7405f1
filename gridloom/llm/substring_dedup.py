"""Substring deduplication by difference-cover anchors.

A passage of ``WINDOW`` = 13 words that starts at place i of one document and at j of another has, for some shift d < 7, both
i + d and j + d in the difference cover {0, 1, 3} modulo 7; the 7 words from there lie within the passage.  So it is enough to
hash 7-word anchors at 3 of 7 places: any shared window shares an aligned anchor.  Around anchors that two documents share, each
match is then extended to all 13-word windows that hold the anchor; the smallest document that has a window keeps it.

Documents are packed once into blocks of some megabytes (a written table).  A block sends each distinct anchor once, however
many of its documents have it, as 4 bytes in a bucket; the bucket answers with one bit.  Windows then travel the same way with
the smallest identifier of the block, and the answer is the smallest of all.  A passage that a third of all documents share
thus costs one entry for each block, never one for each document or pair.

Anchors are compared by the low 32 bits of their hash within a bucket (a chance equality only makes a window a candidate).  Windows are
compared by 128 bits, two independent 64-bit hashes over two independent 64-bit hashes of each word: among 10**13 windows two different
ones agree with a probability under 1e-12, and only such a pair could be taken for equal.

A block sends a row to each bucket it has keys for.  The sizes of blocks and buckets both grow with the square root of the corpus, so
rows grow in proportion to it; where memory ends that growth (at some 8 GB for buckets, 130 GB for blocks) rows get thinner instead,
and there are never more of them than anchors.  Buckets are cut by the corpus' size (anchors) or the number of shared anchors (windows).

Defined results: null and empty texts have no words; a window repeated within one document or among rows of one identifier is
kept; a null identifier counts as larger than any other, and rows that have it keep what only they share; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Least and most bytes of text in a block, and of keys in a bucket, about.
BLOCK_BYTES, BUCKET_BYTES = (1 << 20, 16 << 20), (8 << 20, 32 << 20)
#: Bytes of a window's keys and owner, and windows that hold one anchor.
WINDOW_BYTES, WINDOWS = 24, PERIOD

#: Odd multipliers of the two polynomials.
_M, _M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_LAST = np.iinfo(np.int64).max


class WordHashes(dict):
    """Numbers of words, and two independent 64-bit hashes of each (the halves of a 128-bit one)."""

    def __init__(self):
        self.fresh: list[bytes] = []
        self.first = self.second = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        k = self[word] = len(self)
        return k

    def of(self, words, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of n words.  The memory is bounded, but for the words of one block."""
        if len(self) > 300_000:
            self.clear()
            self.first = self.second = np.zeros(0, np.uint64)
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, n)
        if self.fresh:
            found = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.fresh)), np.uint64)
            self.first, self.second = np.concatenate([self.first, found[::2]]), np.concatenate([self.second, found[1::2]])
            self.fresh.clear()
        return self.first[numbers], self.second[numbers]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spans_hash(h: np.ndarray, length: int, m: int = _M) -> np.ndarray:
    """Hash of the ``length`` words from each place: a polynomial over word hashes, built by doubling."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, have, power, width = None, 0, h, 1
    while True:
        if length & width:
            if done is None:
                done, have = power, width
            else:  # the part so far, then this one
                done = done[: len(done) - width] * _power(m, width) + power[have : have + len(done) - width]
                have += width
        width *= 2
        if width > length:
            break
        power = power[: len(power) - width // 2] * _power(m, width // 2) + power[width // 2 :]
    return mixed(done[:n])


def _power(m: int, k: int) -> np.uint64:
    return np.uint64(pow(m, k, 1 << 64))


def _pack(limit: int):
    """The task: id, text to blocks of documents: block, bytes of text, ids, sizes, zstd of the texts one after another."""
    return lambda batches: _packed(batches, limit)


def _packed(batches, limit: int):
    pid, k = TaskContext.get().partitionId(), 0
    coder = zstandard.ZstdCompressor(level=1)
    ids, texts, size = [], [], 0

    def block():
        nonlocal ids, texts, size, k
        sizes = np.array([len(t) for t in texts], np.int64)
        out = pa.RecordBatch.from_arrays([pa.array([pid << 32 | k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tobytes()], pa.binary()), pa.array([coder.compress(b"".join(texts))], pa.binary())], names=["block", "ids", "sizes", "texts"])
        ids, texts, size, k = [], [], 0, k + 1
        return out

    for batch in batches:
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = (text or "").encode()
            if texts and size + len(raw) > limit:
                yield block()
            ids.append(i)
            texts.append(raw)
            size += len(raw)
    if texts:
        yield block()


def _unpack(row: dict):
    """(identifiers as numbers, texts) of a block."""
    sizes = np.frombuffer(row["sizes"], np.int64)
    raw = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=int(sizes.sum()) + 1) if sizes.sum() else b""
    ends = np.cumsum(sizes)
    return np.array([_LAST if i is None else i for i in row["ids"]], np.int64), [raw[e - s : e] for s, e in zip(sizes, ends, strict=True)]


class Block:
    """The words of a block's documents, laid end to end: their hashes, and where each document begins and ends."""

    def __init__(self, known: WordHashes, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.n = int(sizes.sum())
        self.first, self.second = known.of(chain.from_iterable(self.words), self.n)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of each anchor: at cover places of documents that are long enough for a window."""
        begin, end = self.begins[self.doc], self.ends[self.doc]
        place = np.arange(self.n)
        at = np.flatnonzero(np.isin((place - begin) % PERIOD, COVER) & (place + ANCHOR <= end) & (end - begin >= WINDOW))
        return spans_hash(self.first, ANCHOR)[at], at

    def around(self, at: np.ndarray) -> np.ndarray:
        """Places of the windows that hold one of the anchors at these places."""
        low, high = np.maximum(at - PERIOD + 1, self.begins[self.doc[at]]), np.minimum(at, self.ends[self.doc[at]] - WINDOW)
        return np.flatnonzero(np.cumsum(np.bincount(low, minlength=self.n + 1) - np.bincount(high + 1, minlength=self.n + 1)) > 0)

    def inside(self, at: np.ndarray) -> np.ndarray:
        """Those of the places whose window ends within the document."""
        return at[at + WINDOW <= self.ends[self.doc[at]]]


def _groups(hashes: np.ndarray, doc: np.ndarray):
    """Distinct hashes in order, each entry's group, and whether two documents of the block have it."""
    by = np.argsort(hashes, kind="stable")
    ordered, docs = hashes[by], doc[by]
    new = np.ones(len(by), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(new) - 1
    several = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts) if len(starts) else np.zeros(0, bool)
    return ordered[starts], group, several


def _bucket_cuts(ordered: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets take equal ranges of the hash, so a bucket is a slice of the ordered ones."""
    of = ((ordered >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))


def _send_anchors(buckets: int):
    def task(batches):
        known = WordHashes()
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(known, _unpack(row)[1])
                hashes, at = block.anchors()
                ordered, _, several = _groups(hashes, block.doc[at])
                cuts = _bucket_cuts(ordered, buckets)
                low = ordered.astype(np.uint32)
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full.astype(np.int32)),
                        pa.array(np.full(len(full), row["block"], np.int64)),
                        pa.array([low[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                        pa.array([np.packbits(several[cuts[b] : cuts[b + 1]]).tobytes() for b in full], pa.binary()),
                    ],
                    names=["bucket", "block", "keys", "several"],
                )

    return task


def _match_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block, which of its anchors another document has too."""
    keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")]
    sizes = np.array([len(k) for k in keys])
    every = np.concatenate(keys)
    shared = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip(table.column("several"), sizes, strict=True)]).astype(bool)
    by = np.argsort(every, kind="stable")
    ordered = every[by]
    again = np.zeros(len(by), bool)
    again[1:] = ordered[1:] == ordered[:-1]
    again[:-1] |= again[1:]
    shared[by] |= again
    parts = np.split(shared, np.cumsum(sizes)[:-1])
    some = [k for k, p in enumerate(parts) if p.any()]
    take = lambda name: table.column(name).take(pa.array(some, pa.int64()))
    return pa.table({"block": take("block"), "bucket": take("bucket"), "n": pa.array([int(parts[k].sum()) for k in some], pa.int64()), "shared": pa.array([np.packbits(parts[k]).tobytes() for k in some], pa.binary())})


def _send_windows(anchor_buckets: int, buckets: int):
    """The task: blocks with their anchors' answers to candidate windows by bucket."""

    def task(batches):
        known = WordHashes()
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts = _unpack(row)
                block = Block(known, texts)
                hashes, at = block.anchors()
                ordered, group, _ = _groups(hashes, block.doc[at])
                cuts = _bucket_cuts(ordered, anchor_buckets)
                shared = np.zeros(len(ordered), bool)
                for answer in row["answers"]:
                    a, b = cuts[answer["bucket"]], cuts[answer["bucket"] + 1]
                    shared[a:b] = np.unpackbits(np.frombuffer(answer["shared"], np.uint8), count=b - a)
                starts = block.around(at[shared[group]])
                if not len(starts):
                    continue
                first, second, owner = spans_hash(block.first, WINDOW)[starts], spans_hash(block.second, WINDOW, _M2)[starts], ids[block.doc[starts]]
                by = np.lexsort((owner, second, first))
                first, second, owner = first[by], second[by], owner[by]
                starts = np.flatnonzero(_changes(first, second))
                last = np.append(starts[1:], len(by)) - 1
                first, second, least, several = first[starts], second[starts], owner[starts], owner[last] != owner[starts]
                cuts = _bucket_cuts(first, buckets)
                full = np.flatnonzero(np.diff(cuts))
                cut = lambda x, b: x[cuts[b] : cuts[b + 1]]
                columns = [pa.array([cut(x, b).tobytes() for b in full], pa.binary()) for x in (first, second, least)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), row["block"], np.int64)), *columns, pa.array([np.packbits(cut(several, b)).tobytes() for b in full], pa.binary())],
                    names=["bucket", "block", "first", "second", "least", "several"],
                )

    return task


def _changes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where an ordered pair of keys differs from the one before."""
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return new


def _match_windows(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block, its windows that a smaller document has, with the smallest identifier."""
    read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
    firsts = read("first", np.uint64)
    sizes = np.array([len(k) for k in firsts])
    first, second, least = np.concatenate(firsts), np.concatenate(read("second", np.uint64)), np.concatenate(read("least", np.int64))
    several = np.concatenate([np.unpackbits(x, count=n) for x, n in zip(read("several", np.uint8), sizes, strict=True)]).astype(bool)
    by = np.lexsort((second, first))
    new = _changes(first[by], second[by])
    smallest = np.empty(len(by), np.int64)
    smallest[by] = np.minimum.reduceat(least[by], np.flatnonzero(new))[np.cumsum(new) - 1]
    useful = (smallest < least) | several
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    some = [k for k in range(len(sizes)) if useful[cuts[k] : cuts[k + 1]].any()]
    part = lambda x, k: x[cuts[k] : cuts[k + 1]][useful[cuts[k] : cuts[k + 1]]].tobytes()
    return pa.table({"block": table.column("block").take(pa.array(some, pa.int64())), **{n: pa.array([part(x, k) for k in some], pa.binary()) for n, x in (("first", first), ("second", second), ("smallest", smallest))}})


class Answers:
    """Ordered windows of a block with the smallest identifiers that have them."""

    def __init__(self, first: np.ndarray, second: np.ndarray, smallest: np.ndarray):
        by = np.lexsort((second, first))
        self.first, self.second, self.smallest = first[by], second[by], smallest[by]
        starts = np.flatnonzero(np.concatenate([[True], self.first[1:] != self.first[:-1]])) if len(by) else np.zeros(0, int)
        self.longest = int(np.diff(np.append(starts, len(by))).max(initial=0))  # windows with one first hash: 1, but for chance

    def __len__(self):
        return len(self.first)

    def may_hold(self, first: np.ndarray) -> np.ndarray:
        """Places of the windows whose first hash is there; a table of its leading bits rules out most of the others at once."""
        table = np.zeros(1 << 20, bool)
        table[self.first >> np.uint64(44)] = True
        at = np.flatnonzero(table[first >> np.uint64(44)])
        return at[self.first[np.minimum(np.searchsorted(self.first, first[at]), len(self) - 1)] == first[at]]

    def places(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Where each window is, -1 where it isn't."""
        out = np.full(len(first), -1, np.int64)
        at = np.searchsorted(self.first, first)
        for k in range(self.longest):
            j = np.minimum(at + k, len(self) - 1)
            hit = (self.first[j] == first) & (self.second[j] == second)
            out[hit] = j[hit]
        return out


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie under a window that starts at one of the places."""
    near = np.zeros(n + 1, np.int32)
    near[starts] += 1
    near[starts + WINDOW] -= 1
    return np.cumsum(near[:n]) > 0


def _remove(with_text: bool):
    """The task: blocks with their windows' answers to each document's result."""

    def task(batches):
        known = WordHashes()
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts = _unpack(row)
                get = lambda name, kind: np.concatenate([np.frombuffer(a[name], kind) for a in row["answers"] or []] or [np.zeros(0, kind)])  # noqa: B023, E731
                answers = Answers(get("first", np.uint64), get("second", np.uint64), get("smallest", np.int64))
                block = Block(known, texts)
                gone = np.zeros(block.n, bool)
                if len(answers):
                    first = spans_hash(block.first, WINDOW)
                    starts = block.inside(answers.may_hold(first))
                    k = answers.places(first[starts], spans_hash(block.second, WINDOW, _M2)[starts])
                    gone = covered(starts[(k >= 0) & (answers.smallest[k] < ids[block.doc[starts]])], block.n)
                n_removed = np.bincount(block.doc[gone], minlength=len(ids))
                n_words, digests, kept_texts = block.ends - block.begins, [], []
                for d, words in enumerate(block.words):
                    kept = words
                    if n_removed[d]:
                        kept = list(compress(words, (~gone[block.begins[d] : block.ends[d]]).tolist()))
                    joined = b" ".join(kept)
                    digests.append(hashlib.sha256(joined).hexdigest())
                    kept_texts.append(joined.decode() if with_text else None)
                columns = [pa.array(row["ids"], pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
                names = ["id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(kept_texts, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return task


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    between = lambda x, least, most: min(max(x, least), most)
    block_bytes, bucket_bytes = between(math.isqrt(size >> 9), *BLOCK_BYTES), between(math.isqrt(size << 17), *BUCKET_BYTES)
    fewest = 2 * spark.sparkContext.defaultParallelism
    blocks = common.materialise(rows.mapInArrow(_pack(block_bytes), "block long, ids array<long>, sizes binary, texts binary"), "blocks")
    blocks = blocks.where("block IS NOT NULL")  # both joins below then take one and the same exchange of the blocks
    anchor_buckets = max(fewest, -(-size // 3 // bucket_bytes))  # 3 keys of 4 bytes for 7 words, each of 6 bytes or so
    anchors = blocks.mapInArrow(_send_anchors(anchor_buckets), "bucket int, block long, keys binary, several binary")
    shared = common.materialise(anchors.groupBy("bucket").applyInArrow(_match_anchors, "block long, bucket int, n long, shared binary"), "shared")
    found = shared.agg(F.sum("n")).first()[0] or 0
    buckets = max(fewest, -(-found * WINDOWS * WINDOW_BYTES // bucket_bytes))
    answers = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared")).alias("answers"))
    windows = blocks.join(answers, "block").mapInArrow(_send_windows(anchor_buckets, buckets), "bucket int, block long, first binary, second binary, least binary, several binary")
    smallest = windows.groupBy("bucket").applyInArrow(_match_windows, "block long, first binary, second binary, smallest binary")
    finals = smallest.groupBy("block").agg(F.collect_list(F.struct("first", "second", "smallest")).alias("answers"))
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return blocks.join(finals, "block", "left").mapInArrow(_remove(with_text), schema).withColumnRenamed("id", id_col)
