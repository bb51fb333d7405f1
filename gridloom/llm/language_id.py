"""Language identification by mixture inference.

Each language has a model of letter trigrams (hashed to 2**16 values, so a model's size is fixed), counted over all documents that
may be learned from.  A document is taken as a mixture of languages: expectation-maximisation estimates the proportions from the
trigram likelihoods, first over all languages, then over the first, the first two, ... languages in the order of their
proportions, as long as the penalised likelihood of the set rises.  The language with the largest proportion in the chosen set is
the prediction; the score is that proportion times the weight of the chosen set against the next best one.

Overlapping trigrams aren't independent, so the log-likelihood is divided by 3 before the penalty of half a logarithm of the
number of trigrams for each further language.

Defined results: a null text or one without letters is ``und`` with score 0, and so is every text where nothing can be learned; a
null language is not learned from; a null identifier is held out; ties go to the first language in alphabetical order; each
row gets its own result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VALUES = 1 << 16
#: Added to each trigram's count; EM rounds at most, and the change of proportions that ends them.
SMOOTHING, ROUNDS, SETTLED = 0.05, 30, 1e-3
UNKNOWN = "und"


class Trigrams:
    """Hashed trigrams of a text's lower-case letters; anything else parts words."""

    def __init__(self):
        plane = [chr(c) for c in range(0x10000)]
        self.map = np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in plane], np.uint32)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values and their counts; empty without letters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = self.map[np.minimum(codes, 0xFFFF)]
        for c in np.unique(codes[codes > 0xFFFF]):
            low[codes == c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 32
        low = np.concatenate([[32], low, [32]]).astype(np.uint32)
        blank = low == 32
        low = low[~(blank & np.concatenate([[False], blank[:-1]]))]
        if len(low) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA77) ^ low[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return np.unique((h >> np.uint32(16)).astype(np.int64), return_counts=True)


def _count(batches):
    """lang, text to lang, value, n for a whole task."""
    grams, found = Trigrams(), {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            value, n = grams(text)
            if len(value):
                counts = found.get(lang)
                if counts is None:
                    counts = found[lang] = np.zeros(VALUES, np.int64)
                counts[value] += n
    for lang, counts in found.items():
        value = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value, pa.int32()), pa.array(counts[value], pa.int64())], names=["lang", "value", "n"])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of each trigram value in each."""
    common.bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, value int, n long").groupBy("lang", "value").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for r in counts.toLocalIterator():  # VALUES rows for each language at most
        found.setdefault(r.lang, np.zeros(VALUES))[r.value] = r.n
    langs = sorted(found)
    table = np.array([found[x] for x in langs]).reshape(len(langs), VALUES).T + SMOOTHING
    return langs, table / table.sum(0) if langs else table


def proportions(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture weights by EM, and the log-likelihood.  p: likelihood of each value in each language; n: counts."""
    k = p.shape[1]
    w, total = np.full(k, 1 / k), n.sum()
    if k > 1:
        for _ in range(ROUNDS):
            new = w * (p.T @ (n / (p @ w))) / total
            moved = np.abs(new - w).max()
            w = new
            if moved < SETTLED:
                break
    return w, float(n @ np.log(p @ w))


def infer(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The chosen languages (columns of p), their proportions, and the weight of this set against the next best."""
    everything, _ = proportions(p, n)
    order = np.argsort(-everything, kind="stable")
    single = n @ np.log(p)
    best = int(np.argmax(single))
    order = np.concatenate([[best], order[order != best]])
    penalty = 0.5 * np.log(max(2.0, n.sum()))
    chosen, weights, value = order[:1], np.ones(1), single[best] / 3
    others = np.delete(single, best)
    rival = others.max() / 3 if len(others) else -np.inf
    for k in range(2, p.shape[1] + 1):
        w, likelihood = proportions(p[:, order[:k]], n)
        now = likelihood / 3 - penalty * (k - 1)
        if now <= value:
            rival = max(rival, now)
            break
        rival, chosen, weights, value = value, order[:k], w, now
    return chosen, weights, float(1 / (1 + np.exp(min(0.0, max(-700.0, rival - value)))) if rival > -np.inf else 1.0)


def _predict(model):
    def task(batches):
        langs, table = model.value
        grams = Trigrams()
        for batch in batches:
            predicted, scores, sets = [], [], []
            for text in batch.column("text").to_pylist():
                value, n = grams(text) if text else ((), ())
                if not len(value) or not langs:
                    predicted.append(UNKNOWN)
                    scores.append(0.0)
                    sets.append([])
                    continue
                chosen, weights, sure = infer(table[value], n.astype(np.float64))
                by = np.argsort(-weights, kind="stable")
                predicted.append(langs[chosen[by[0]]])
                scores.append(float(min(1.0, weights[by[0]] * sure)))
                sets.append([{"lang": langs[chosen[k]], "share": float(weights[k])} for k in by])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(predicted, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind)], names=["id", "held_out", "lang_pred", "score", "languages"])

    return task


def held_out(id_col: str):
    """The fold that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score, languages (the chosen set with its shares)."""
    spark = docs.sparkSession
    model = learn(docs.where(~held_out(id_col)), text_col, lang_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(model)  # VALUES numbers for each language
    return rows.mapInArrow(_predict(shared), f"id {kind}, held_out boolean, lang_pred string, score double, languages array<struct<lang: string, share: double>>").withColumnRenamed("id", id_col)
