"""Benchmark decontamination with an FM-index for each shard of training text.

A task gathers documents into shards of about a million words, builds the shard's FM-index, backward-searches every distinct
window of the benchmark, locates the occurrences and merges them into removal spans.  Documents never move: no shuffle.  The
benchmark's windows are broadcast in blocks of bounded size (``BLOCK_WORDS``), one at a time; a larger benchmark takes one pass over the
documents for each block, with a written table between two of them, and spans and items add up.

Defined results: null and empty texts have no words and are clean; an item without words is never found; items that share an
identifier count once; an item with a null identifier is named "null"; repeated documents each get their own row; an empty
benchmark or document table gives clean documents or no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .fm_index import FMIndex

WINDOW = 10
#: Words of one shard's index, and of one broadcast block of the benchmark.
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 21

#: Bytes of words as they are, A-Z in lower case, all else as a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SPANS = T.ArrayType(T.IntegerType())
ITEMS = T.ArrayType(T.StringType())


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class _Known(dict):
    def __missing__(self, word):
        return 0


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, limit: int):
    """Blocks of (vocabulary, windows as symbols, lengths, items of each window)."""
    vocabulary, windows, size = {}, {}, 0

    def block():
        phrases = np.zeros((len(windows), window), np.int32)
        for k, w in enumerate(windows):
            phrases[k, : len(w)] = w
        return vocabulary, phrases, np.array([len(w) for w in windows], np.int32), [sorted(x) for x in windows.values()]

    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        found = words(text)
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found]
        for k in range(max(len(ids) - window + 1, min(1, len(ids)))):
            windows.setdefault(tuple(ids[k : k + window]), set()).add("null" if item is None else item)
        size += len(found)
        if size >= limit:
            yield block()
            vocabulary, windows, size = {}, {}, 0
    if windows:
        yield block()


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spans (start, end, start, end, ...) that cover the given ones."""
    if not len(starts):
        return np.zeros(0, np.int32)
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([new[1:], [True]])
    return np.stack([starts[new], reach[last]], 1).ravel().astype(np.int32)


def _scan(shared, limit, text: str = "text", finish=None):
    """The task: batches with a column of texts, and last n_words, spans, items; spans and items gain what this block finds.

    ``finish`` makes the result of such a batch and its spans; all other columns are only passed on.
    """

    def task(batches):
        vocabulary, phrases, lengths, items = shared.value
        known, top = _Known(vocabulary), len(vocabulary)

        def flush(held):
            symbols = np.concatenate([x for _, parts in held for x in parts])
            sizes = np.array([len(x) for _, parts in held for x in parts])
            begins = np.concatenate([[0], np.cumsum(sizes)])
            index = FMIndex(symbols, top)
            low, high = index.search(phrases, lengths)
            times = high - low
            hit = np.flatnonzero(times > 0)
            rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(times[hit])[:-1]]), times[hit]) + np.arange(times[hit].sum())
            which = np.repeat(hit, times[hit])
            place = index.locate(rows)
            doc = np.searchsorted(begins, place, "right") - 1
            by = np.argsort(doc, kind="stable")
            doc, which, start = doc[by], which[by], (place - begins[doc])[by]
            cuts = np.searchsorted(doc, np.arange(len(sizes) + 1))
            k = 0
            for batch, parts in held:
                spans, named = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                for j in range(len(parts)):
                    a, b = cuts[k], cuts[k + 1]
                    k += 1
                    if a < b:
                        old = np.array(spans[j], np.int64)
                        spans[j] = merged(np.concatenate([old[::2], start[a:b]]), np.concatenate([old[1::2], start[a:b] + lengths[which[a:b]]]))
                        named[j] = sorted({*named[j], *(x for w in np.unique(which[a:b]) for x in items[w])})
                kept = batch.columns[:-3]
                if finish is not None:
                    yield finish(kept, spans, batch.schema.names[:-3])
                    continue
                found = [pa.array([len(x) - 1 for x in parts], pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(named, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*kept, *found], names=batch.schema.names)

        held, size = [], 0
        for batch in batches:
            parts = []
            for raw in batch.column(text).to_pylist():
                found = words(raw)
                part = np.zeros(len(found) + 1, np.int32)  # ends with a boundary
                part[:-1] = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
                parts.append(part)
                size += len(part)
            held.append((batch, parts))
            if size >= limit:
                yield from flush(held)
                held, size = [], 0
        if held and size:
            yield from flush(held)

    return task


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, text, n_words, spans (word places: start, end, start, end, ...), items (sorted)."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", ITEMS)])
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast(ITEMS).alias("items"))
    found, shared = _passes(found, benchmark, item_col, item_text_col, window)
    return found.mapInArrow(_scan(shared, SHARD_WORDS), schema)


def _passes(found: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int, text: str = "text"):
    """``found`` after all blocks but the last, and the last one, broadcast.  Each block is gone before the next one is made."""
    spark = found.sparkSession
    shared = written = None
    for block in _blocks(benchmark, item_col, text_col, window, BLOCK_WORDS):
        if shared is not None:
            found = common.materialise(found.mapInArrow(_scan(shared, SHARD_WORDS, text), found.schema), "spans")
            shared.destroy()
            if written is not None:
                common.release(written)
            written = found
        shared = spark.sparkContext.broadcast(block)  # at most BLOCK_WORDS words and one item more
    return found, shared or spark.sparkContext.broadcast(({}, np.zeros((0, window), np.int32), np.zeros(0, np.int32), []))


def n_hit(spans):
    """Words under the merged spans."""
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(spans) - 2, F.lit(0)), F.lit(2)), F.lit(0).cast("long"), lambda s, k: s + F.coalesce(F.get(spans, k + 1) - F.get(spans, k), F.lit(0)))


_WORD = re.compile(rb"[^ ]+")


def without_spans(text: str, spans) -> str:
    """The text without the words under the spans, from each span's first to its last byte."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    kept, end = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        kept.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*kept, raw[end:]]).decode()


def _cut(text_at: int, size_at: int | None):
    """Columns and spans to a batch whose texts, and their sizes, change where there are spans."""

    def finish(columns: list, spans: list, names: list[str]):
        if hit := [k for k, s in enumerate(spans) if len(s)]:
            texts = columns[text_at].to_pylist()
            for k in hit:
                texts[k] = without_spans(texts[k], list(spans[k]))
            columns[text_at] = pa.array(texts, pa.string())
            if size_at is not None:
                sizes = columns[size_at].to_pylist()
                for k in hit:
                    sizes[k] = len(texts[k])
                columns[size_at] = pa.array(sizes, columns[size_at].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return finish


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with the benchmark's passages cut out of their texts, and their sizes set to what is left."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    names, numbered = docs.columns, [f"c{k}" for k in range(len(docs.columns))]
    text = numbered[names.index(text_col)]
    cut = _cut(names.index(text_col), names.index(size_col) if size_col in names else None)
    found = docs.toDF(*numbered).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast(ITEMS)})
    plain = T.StructType(found.schema.fields[:-3])
    found, last = _passes(found, benchmark, "item_id", "text", window, text)
    return found.mapInArrow(_scan(last, SHARD_WORDS, text, cut), plain).toDF(*names)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    hit = n_hit(F.col("spans"))
    return found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
