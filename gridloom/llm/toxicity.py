"""Toxicity by a classifier chain.

The categories are predicted one after another: each is a logistic regression on the presence of words and word beginnings and on
the probabilities of all categories before it.  For training, those probabilities are out-of-fold predictions (``FOLDS`` folds, features
chosen and weights fitted without the fold), so a later model never sees how an earlier one remembers its training rows; for
prediction the earlier models are fitted on all rows of the sample.  The last category decides; its threshold is the one with the
best F1 on the out-of-fold predictions.

The models are fitted on a bounded sample: the labelled documents with the smallest hashes of their identifiers, up to ``SAMPLE`` and
up to ``SAMPLE_BYTES`` of text (the first is always in).  Texts over 1/``LONG`` of the bytes come after all others, the shortest first, so
none of them displaces a shorter one.  Each document is counted and fitted on as a whole; every document is scored on its whole text, in place: no document moves.

Defined results: null and empty texts have no features and get the base rates; labels that are null are not learned from, and of
labels repeated for a document the largest counts; where no labels are left every probability is 0 and nothing is toxic; each
row gets its own result, repeated or without identifier; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Labelled documents to fit on, bytes of their texts, folds, features of a model, lengths of word beginnings.
SAMPLE, SAMPLE_BYTES, FOLDS, FEATURES, STARTS = 8_000, 64 << 20, 3, 600, (5, 6, 7)
#: A text over this part of the sample's bytes is a long one.
LONG = 64
_BITS = (1 << 21) - 1
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashed features of one lower-case word."""
    return [xxhash.xxh32_intdigest(word.encode()) & _BITS] + [xxhash.xxh32_intdigest(f"{word[:k]}*".encode()) & _BITS for k in STARTS if len(word) >= k]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def _extract(batches):
    for batch in batches:
        out = [np.unique(np.array([f for w in words(t) for f in features(w)], np.uint32)).tobytes() for t in batch.column("text").to_pylist()]
        columns = {n: batch.column(n) for n in batch.schema.names if n != "text"}
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(out, pa.binary())], names=[*columns, "features"])


class Linear:
    """Logistic regression on the chosen features, the chain's probabilities and a constant."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, chain: np.ndarray, bias: float):
        self.chosen, self.weights, self.chain, self.bias = chosen, weights, chain, bias

    def parts(self) -> tuple:
        """What is broadcast holds plain values only."""
        return self.chosen, self.weights, self.chain, self.bias


def choose(rows: np.ndarray, ids: np.ndarray, y: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features whose presence differs most between the classes, by the z score of two proportions, and their scales.

    A feature's scale is the logarithm of its rates' ratio, so strong features need small weights and the ridge spares them.

    Counts take one array over all hash values, whatever the number of documents.
    """
    n, n1 = int(inside.sum()), int(y[inside].sum())
    n0 = n - n1
    both = np.bincount(ids[inside[rows]], minlength=_BITS + 1)
    pos = np.bincount(ids[(inside & (y == 1))[rows]], minlength=_BITS + 1)
    seen = np.flatnonzero(both >= 3)
    pos, both = pos[seen], both[seen]
    rate = both / n
    z = np.abs(pos / n1 - (both - pos) / n0) / np.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0) + 1e-12)
    z[z < 4] = 0
    top = np.argsort(-z, kind="stable")[:FEATURES]
    top = np.sort(top[z[top] > 0])
    return seen[top].astype(np.uint32), np.abs(np.log((pos[top] + 0.5) / (n1 + 1) * (n0 + 1) / (both[top] - pos[top] + 0.5)))


def dense(rows: np.ndarray, ids: np.ndarray, n: int, chosen: np.ndarray) -> np.ndarray:
    """Presence of the chosen features, a row for each document."""
    x = np.zeros((n, len(chosen)), np.float32)
    place = np.full(_BITS + 1, -1, np.int16)
    place[chosen] = np.arange(len(chosen))
    at = place[ids]
    hit = at >= 0
    x[rows[hit], at[hit]] = 1
    return x


def fit(rows: np.ndarray, ids: np.ndarray, y: np.ndarray, chain: np.ndarray, inside: np.ndarray, ridge: float = 1.0, rounds: int = 300) -> Linear:
    """Nesterov's accelerated gradient on the documents inside; all orders are fixed, so the result is the same every time."""
    n = int(inside.sum())
    base = float(np.clip(y[inside].mean(), 1e-6, 1 - 1e-6)) if n else 1e-6
    if not n or y[inside].min() == y[inside].max():
        return Linear(np.zeros(0, np.uint32), np.zeros(0), np.zeros(chain.shape[1]), float(np.log(base / (1 - base))))
    chosen, scale = choose(rows, ids, y, inside)
    x = np.concatenate([dense(rows, ids, len(y), chosen)[inside] * scale.astype(np.float32), chain[inside].astype(np.float32), np.ones((n, 1), np.float32)], 1)
    y = y[inside]
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        size = float(np.linalg.norm(v))
        v /= size
    step = 1 / (size / 4 + ridge)
    w = np.zeros(x.shape[1], np.float64)
    w[-1] = np.log(base / (1 - base))
    look, t = w.copy(), 1.0
    shrink = np.full(len(w), ridge)
    shrink[-1] = 0
    for _ in range(rounds):
        g = x.T @ (1 / (1 + np.exp(-(x @ look.astype(np.float32)))) - y).astype(np.float32) + shrink * look
        new = look - step * g
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look, w = new + (before - 1) / t * (new - w), new
    k = len(chosen)
    return Linear(chosen, w[:k] * scale, w[k:-1], float(w[-1]))


def probability(m: Linear, x: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Of each row: presence of the model's features, probabilities of the categories before."""
    return 1 / (1 + np.exp(-np.clip(x @ m.weights + chain @ m.chain + m.bias, -30, 30)))


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> tuple[list[Linear], float]:
    """Models of the categories in order, and the last one's threshold (a probability)."""
    n, k = labels.shape
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    ids = np.concatenate(sets) if n else np.zeros(0, np.uint32)
    models, chain = [], np.zeros((n, 0))
    for c in range(k):
        y = labels[:, c].astype(np.float64)
        out = np.zeros(n)
        for f in np.unique(folds):
            inside = folds != f
            m = fit(rows, ids, y, chain, inside)
            out[~inside] = probability(m, dense(rows, ids, n, m.chosen)[~inside], chain[~inside])
        models.append(fit(rows, ids, y, chain, np.ones(n, bool)))
        chain = np.concatenate([chain, out[:, None]], 1)
    threshold = 1.1  # no label, nothing is toxic
    if n and 0 < labels[:, -1].sum() < n:
        p, y = chain[:, -1], labels[:, -1]
        by = np.argsort(-p, kind="stable")
        hits, taken = np.cumsum(y[by]), np.arange(1, n + 1)
        f1 = 2 * hits / (taken + y.sum())
        best = int(np.argmax(f1))
        low = p[by[best + 1]] if best + 1 < n else 0.0
        threshold = float((p[by[best]] + low) / 2)
    return models, threshold


def _score(shared):
    """The task: id, text to id and the categories' probabilities; the chain runs over whole batches."""

    def task(batches):
        models, names, threshold = shared.value
        models = [Linear(*m) for m in models]
        every = np.unique(np.concatenate([m.chosen for m in models]))
        number = {int(f): k for k, f in enumerate(every)}
        place = [np.searchsorted(every, m.chosen) for m in models]
        known: dict[str, tuple] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.zeros((len(texts), len(every)), np.float32)
            for k, text in enumerate(texts):
                found = set()
                for w in words(text):
                    hit = known.get(w)
                    if hit is None:
                        if len(known) > 150_000:
                            known.clear()
                        hit = known[w] = tuple(number[f] for f in features(w) if f in number)
                    if hit:
                        found.update(hit)
                if found:
                    x[k, list(found)] = 1
            chain = np.zeros((len(texts), 0))
            for m, at in zip(models, place, strict=True):
                chain = np.concatenate([chain, probability(m, x[:, at], chain)[:, None]], 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(chain[:, k]) for k in range(len(names))), pa.array(chain[:, -1] >= threshold)], names=["id", *(f"p_{n}" for n in names), "toxic"])

    return task


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES):
    """(models, names, threshold) from a bounded sample of the labelled documents."""
    common.bounded_batches(docs.sparkSession)
    names = list(categories)
    marked = labels.select(F.col(id_col).alias("id"), *(c.cast("int").alias(n) for n, c in categories.items())).dropna()
    marked = marked.groupBy("id").agg(*(F.max(n).alias(n) for n in names)).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = rows.select("id", F.octet_length("text").alias("size")).join(F.broadcast(marked), "id").groupBy("id", *names).agg(F.max("size").alias("size"))  # ``sample`` rows at most
    long = F.when(F.col("size") > sample_bytes // LONG, F.col("size")).otherwise(0)
    before = Window.orderBy(long, F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    chosen = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") < sample_bytes).drop("size", "before")
    rows = rows.join(F.broadcast(chosen), "id")
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.select("id", *names, "text").mapInArrow(_extract, f"id {kind}, {', '.join(f'{n} int' for n in names)}, features binary").collect()
    first = {r.id: r for r in sorted(found, key=lambda r: (r.id, r.features), reverse=True)}  # one row for each identifier
    found = [first[i] for i in sorted(first)]
    y = np.array([[r[n] for n in names] for r in found], np.int64).reshape(len(found), len(names))
    folds = np.array([xxhash.xxh32_intdigest(str(r.id)) % FOLDS for r in found], np.int64)
    sets = [np.frombuffer(r.features, np.uint32) for r in found]
    del found, first
    models, threshold = fit_chain(sets, y, folds)
    return [m.parts() for m in models], names, threshold


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, p_<category> in the chain's order, toxic."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(model)  # FEATURES weights for each category
    return rows.mapInArrow(_score(shared), f"id {kind}, {', '.join(f'p_{n} double' for n in model[1])}, toxic boolean").withColumnRenamed("id", id_col)


def chain_of_labels() -> dict[str, Column]:
    """The chain over the columns of ``labels``: low quality first, then toxicity."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def _keep(shared):
    """The task: whole rows; those that the chain rejects go.  The text is column ``text_at``."""

    def task(batches):
        (model, text_at) = shared.value
        held: list[pa.RecordBatch] = []

        def named():
            for batch in batches:
                held.append(batch)
                text = batch.column(text_at)
                yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), text], names=["id", "text"])

        class _Model:
            value = model

        for decided in _score(_Model)(named()):
            yield held.pop(0).filter(pa.compute.invert(decided.column(decided.num_columns - 1)))

    return task


def keep_clean(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, as they are; nothing moves."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model, docs.columns.index(text_col)))
    return docs.mapInArrow(_keep(shared), docs.schema)
