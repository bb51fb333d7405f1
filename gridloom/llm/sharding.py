"""Uniform sharding by a hypergeometric communication matrix.

The rows lie in source partitions, by a hash of identifier, text and copy number.  Equal rows (same identifier, size and CRC) are
interchangeable, so they are counted first and then dealt out again as numbered copies: however many there are, no task gathers them,
and documents of equal texts are no group that stays together: the law is ``rows``, each row counts once.  Entry (p, s) of the matrix says how many rows go from partition p to shard s; the rows
of the matrix are drawn from the exact multivariate hypergeometric law given what each shard still lacks, so shard sizes are
exact (at most one apart) and every assignment is equally likely.  Each partition permutes its rows and deals them out by its
row of the matrix; after the exchange each shard permutes again, in sub-ranges of a second random key, so no task sorts a shard
alone.  All draws come from ``seed``; with the same rows the result is the same.  Only counts reach the driver: one number for
each source partition (2**18 rows) and one for each shard and sub-range.

Defined results: a null text has no bytes (size 1, CRC 0); null and repeated identifiers are rows like any others, told apart by
CRC, size and copy number (equal rows are interchangeable); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a source partition, and of a sub-range of a shard; copies of one row that are dealt out at once.
SOURCE_ROWS, COPIES = 1 << 18, 1 << 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` balls are good.  Beyond numpy's range: the ratio-of-uniforms method."""
    if not (good and drawn):
        return 0
    if not bad:
        return drawn
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    mean = drawn * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - drawn) / max(1, total - 1)) + 0.5)
    mode = (drawn + 1) * (good + 1) // (total + 2)

    def log_choose_ratio(n: int, k: int, m: int) -> float:
        """log C(n, k) - log C(n, m) by a sum of logs, or by Stirling's series where the sum would be long."""
        if abs(k - m) <= 4096:
            a, b = min(k, m), max(k, m)
            i = np.arange(a, b, dtype=np.float64)
            v = float(np.log((n - i) / (i + 1)).sum())
            return v if k >= m else -v
        return math.lgamma(m + 1) + math.lgamma(n - m + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        x = math.floor(mean + 0.5 + 1.7155277699214135 * (spread + 0.5) * (v - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= log_choose_ratio(good, x, mode) + log_choose_ratio(bad, drawn - x, drawn - mode):
            return x


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Exact numbers of rows from each source partition to each shard; shard sizes are at most one apart."""
    total = sum(counts)
    lacks = [total // shards + (s < total % shards) for s in range(shards)]
    rng = np.random.Generator(np.random.PCG64(seed))
    matrix = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        rest = sum(lacks)
        for s in range(shards):
            k = hypergeometric(rng, lacks[s], rest - lacks[s], n)
            rest -= lacks[s]
            n -= k
            lacks[s] -= k
            matrix[p, s] = k
    return matrix


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot (gapless from 0 in its shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    distinct = common.materialise(rows.groupBy("id", "bytes", "crc").agg(F.count("*").alias("n")), "rows")  # the texts are read once
    n = distinct.agg(F.sum("n")).first()[0] or 0
    sources = max(64, -(-n // SOURCE_ROWS))
    ranges = max(1, -(-n // (shards * SOURCE_ROWS)), min(16, n // (shards * 64)))
    upto = lambda count: F.sequence(F.lit(0).cast("long"), count - 1)
    once = distinct.where("n = 1").select("id", "bytes", "crc", F.lit(0).cast("long").alias("copy"))
    parts = distinct.where("n > 1").select("*", F.explode(upto(F.ceil(F.col("n") / COPIES))).alias("part")).repartition("id", "crc", "part")
    several = parts.select("id", "bytes", "crc", F.explode(upto(F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES))).alias("k"), "part")
    rows = once.union(several.select("id", "bytes", "crc", F.col("part") * COPIES + F.col("k")))
    rows = rows.withColumn("source", F.pmod(F.xxhash64(F.lit(seed), "id", "bytes", "crc", "copy"), F.lit(sources)))
    found = dict(rows.groupBy("source").count().collect())  # at most ``sources`` numbers
    keys = sorted(found)
    matrix = communication_matrix([found[k] for k in keys], shards, seed)
    dealt = spark.createDataFrame([(k, [int(x) for x in c]) for k, c in zip(keys, matrix.cumsum(1), strict=True)], "source long, upto array<long>")
    local = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "id", "copy"), "id", "crc", "bytes", "copy")
    rows = rows.withColumn("k", F.row_number().over(local) - 1).join(dealt, "source")
    mixed = F.xxhash64(F.lit(seed + 2), "id", "crc", "copy")
    rows = rows.select("id", "bytes", "crc", F.expr("size(filter(upto, x -> x <= k))").alias("shard"), F.pmod(F.shiftrightunsigned(mixed, 20), F.lit(ranges)).alias("part"), mixed.alias("mixed"))
    rows = common.materialise(rows, "dealt")
    sizes = rows.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    again = Window.partitionBy("shard", "part").orderBy("mixed", "id", "crc", "bytes")
    placed = rows.withColumn("k", F.row_number().over(again) - 1).join(starts, ["shard", "part"])
    return placed.select(F.col("id").alias(id_col), (F.col("bytes") + 1).alias("size"), F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("k")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text", files_per_shard: int = 1) -> None:
    """Write whole rows as ``path/shard=NN``, each shard's files in slot order; identifiers must be unique here."""
    placed = assign_shards(docs, shards, seed, id_col, text_col).select(F.col(id_col).alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = docs.join(placed, docs[id_col].eqNullSafe(placed["_id"])).drop("_id")
    rows.repartitionByRange(shards * files_per_shard, "_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot").withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(path)
