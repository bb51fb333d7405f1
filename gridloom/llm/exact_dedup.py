"""Exact deduplication by content sort.

Sampled splitters range-partition the rows in the order of their normalised bytes, Spark's external sort places equal
texts next to each other, and neighbouring texts are compared in full; of a run of equal texts the first row, which has
the smallest identifier, stays.

Splitters must stay small, so the order is (first bytes of the text, digest, whole text, identifier): rows are dealt by
the first, second and last of these, and a run of equal texts may go on over any number of partitions.  A group that
holds a third of all rows is thereby shared evenly by a third of the tasks.  Each partition reports its first and last
run; the driver joins those that continue (two short records a partition) after a full comparison on the executors.

Defined results: a null text counts as empty; rows with a null identifier sort after all others, so they stay only where
the group has no identifier; of rows repeated with one identifier, one stays; an empty table gives an empty result; columns
other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of the text that splitters carry.
HEAD = 48


def normalised(text):
    """Each run of white space as one space; null as empty.  Single spaces need no replacement."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _runs(batches):
    """Runs of equal neighbours of one sorted partition."""
    pid = TaskContext.get().partitionId()
    open_run: list[pa.RecordBatch] = []
    carry, emitted = None, False

    def out(rows: pa.Table, starts: np.ndarray, last: bool) -> pa.RecordBatch:
        nonlocal emitted
        n = rows.num_rows
        sizes = np.diff(np.append(starts, n))
        first = np.zeros(n, bool)
        first[starts] = True
        edge = np.zeros(n, np.int32)
        if not emitted:
            edge[: sizes[0]] |= 1
        if last:
            edge[starts[-1] :] |= 2
        emitted = True
        ids = rows.column("id").combine_chunks()
        text = pc.if_else(pa.array(first & (edge > 0)), rows.column("norm").combine_chunks(), pa.scalar(None, pa.string()))
        names = ["pid", "id", "mark", "keep_id", "run_size", "first", "edge", "sha", "edge_text"]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, pid, np.int32)),
                ids,
                rows.column("mark").combine_chunks(),
                ids.take(pa.array(np.repeat(starts, sizes))),
                pa.array(np.repeat(sizes, sizes).astype(np.int64)),
                pa.array(first),
                pa.array(edge),
                rows.column("sha").combine_chunks(),
                text,
            ],
            names=names,
        )

    def closed(parts: list[pa.RecordBatch], last: bool = False) -> pa.RecordBatch:
        return out(pa.Table.from_batches(parts), np.zeros(1, np.int64), last)

    def lean(part: pa.RecordBatch, head: bool) -> pa.RecordBatch:
        """An open run keeps the text of its first row alone."""
        norm = part.column("norm")
        kept = norm.slice(0, 1) if head else norm.slice(0, 0)
        rest = pa.nulls(part.num_rows - len(kept), pa.string())
        return pa.RecordBatch.from_arrays([part.column("id"), pa.concat_arrays([kept, rest]), part.column("sha"), part.column("mark")], names=["id", "norm", "sha", "mark"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm = batch.column("norm").cast(pa.string())
        batch = pa.RecordBatch.from_arrays([batch.column("id"), norm, batch.column("sha"), batch.column("mark")], names=["id", "norm", "sha", "mark"])
        same = np.empty(n, bool)
        same[0] = carry is not None and norm[0].as_py() == carry
        same[1:] = pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~same)
        if len(starts):
            carry = norm[n - 1].as_py()
        else:
            open_run.append(lean(batch, not open_run))
            continue
        if starts[0] > 0:
            open_run.append(lean(batch.slice(0, starts[0]), not open_run))
        if open_run:
            yield closed(open_run)
        if starts[-1] > starts[0]:
            yield out(pa.Table.from_batches([batch.slice(starts[0], starts[-1] - starts[0])]), starts[:-1] - starts[0], False)
        open_run = [lean(batch.slice(starts[-1]), True)]
    if open_run:
        yield closed(open_run, True)


def _chains(edges: list, joined: set[tuple[int, int]]) -> list[tuple]:
    """(pid, edge, keep_id, size, head) for each run that continues over partitions."""
    chains, chain = [], []
    for e in edges:  # in global order
        if chain and not (e.edge & 1 and chain[-1].edge & 2 and (chain[-1].pid, e.pid) in joined):
            chains.append(chain)
            chain = []
        chain.append(e)
    chains += [chain] if chain else []
    return [(e.pid, e.edge, c[0].keep_id, sum(x.run_size for x in c), k == 0) for c in chains if len(c) > 1 for k, e in enumerate(c)]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 and, if given, the whole number ``mark`` of the row."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), (F.lit(None) if mark is None else mark).cast("long").alias("mark")).withColumn("sha", F.sha2("norm", 256))
    order = [F.substring(F.encode("norm", "UTF-8"), 1, HEAD), F.col("sha")]
    ordered = rows.repartitionByRange(*order, F.col("id").asc_nulls_last()).sortWithinPartitions(*order, "norm", F.col("id").asc_nulls_last())
    schema = T.StructType(
        [
            T.StructField("pid", T.IntegerType()),
            T.StructField("id", kind),
            T.StructField("mark", T.LongType()),
            T.StructField("keep_id", kind),
            T.StructField("run_size", T.LongType()),
            T.StructField("first", T.BooleanType()),
            T.StructField("edge", T.IntegerType()),
            T.StructField("sha", T.StringType()),
            T.StructField("edge_text", T.StringType()),
        ]
    )
    runs = common.materialise(ordered.mapInArrow(_runs, schema), "content-sort")
    at_edge = runs.where("edge_text IS NOT NULL")
    # two records a partition at most, without their texts
    edges = sorted(at_edge.select("pid", "edge", "sha", "keep_id", "run_size").collect(), key=lambda e: (e.pid, e.edge != 1))
    near = [(a.pid, b.pid) for a, b in zip(edges, edges[1:]) if a.pid != b.pid and a.sha == b.sha]
    moved = []
    if near:
        a = at_edge.where("edge >= 2").select(F.col("pid").alias("a"), F.col("edge_text").alias("a_text"))
        b = at_edge.where("edge % 2 = 1").select(F.col("pid").alias("b"), F.col("edge_text").alias("b_text"))
        pairs = spark.createDataFrame(near, "a int, b int")
        equal = pairs.join(a, "a").join(b, "b").where("a_text = b_text").select("a", "b").collect()
        moved = _chains(edges, {(r.a, r.b) for r in equal})
    if moved:
        fix = spark.createDataFrame(moved, T.StructType([schema["pid"], schema["edge"], T.StructField("new_keep", kind), T.StructField("new_size", T.LongType()), T.StructField("head", T.BooleanType())]))
        runs = runs.join(F.broadcast(fix), ["pid", "edge"], "left")  # at most two rows a partition
    else:
        runs = runs.select("*", F.lit(None).cast(kind).alias("new_keep"), F.lit(None).cast("long").alias("new_size"), F.lit(None).cast("boolean").alias("head"))
    return runs.select(
        F.col("id").alias(id_col),
        F.when(F.col("head").isNull(), F.col("keep_id")).otherwise(F.col("new_keep")).alias("keep_id"),
        F.coalesce("new_size", "run_size").alias("group_size"),
        (F.col("first") & F.coalesce("head", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["mark"] if mark is not None else []),
    )
