"""Flat binary files: a data source for coordinates and values, and a sink for rasters.

Files hold items of one type in native order without a header; item i of each belongs to observation i.  Readers take slices of the
files, so any number of tasks can read, but many small slices don't make a task each; paths must be visible to every executor.  A raster
is written at fixed offsets into one file beside the target, so a repeated task writes the same bytes again; it takes the target's place
when all tasks are done, and goes when one fails.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridloom.functions.dtypes import DType, dtype

#: Items of a reader's slice and of a record batch.
SLICE, BATCH = 1 << 22, 1 << 16
#: Tasks of a reader whose slices are small; more only as there would be with slices of the usual size.
TASKS = 64


def _size(path: str) -> int:
    if not os.path.isfile(path):
        raise ValueError(f"{path}: no such file")
    return os.path.getsize(path)


def _arrow(items: np.ndarray, d: DType) -> pa.Array:
    if d.style == "coded":
        return pa.array([x.tobytes() for x in items], pa.binary())
    kinds = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "tinyint": pa.int8(), "float": pa.float32(), "double": pa.float64()}
    return pa.array(items).cast(kinds.get(d.spark, pa.decimal128(20, 0)))


class _Slice(InputPartition):
    def __init__(self, start: int, count: int):
        super().__init__(start)
        self.start, self.count = start, count


class _Reader(DataSourceReader):
    """Checks sizes on the driver, reads slices on the executors."""

    def __init__(self, options: dict):
        self.files = [(n, options[n], dtype("float32")) for n in ("lats", "lons", "time") if options.get(n)]
        if options.get("data"):
            self.files.append(("data", options["data"], dtype(options.get("dtype", "float32"))))
        if not self.files:
            raise ValueError("no file to read: give lats and lons, or data")
        counts = {}
        for name, path, d in self.files:
            size = _size(path)
            if size % d.size:
                raise ValueError(f"{path}: {size} bytes aren't whole {d.name} items")
            counts[name] = size // d.size
        if len(set(counts.values())) > 1:
            raise ValueError(f"the files have different numbers of items: {counts}")
        if ("lats" in counts) != ("lons" in counts):
            raise ValueError("lats and lons belong together")
        self.n = next(iter(counts.values()))
        self.slice = int(options.get("slice", SLICE))

    def partitions(self):
        """A task for each slice; where slices are small and many, a task for several that follow one another."""
        most = max(TASKS, -(-self.n // SLICE))
        step = self.slice * max(1, -(-self.n // (self.slice * most)))
        return [_Slice(k, min(step, self.n - k)) for k in range(0, self.n, step)] or [_Slice(0, 0)]

    def read(self, part):
        for at in range(part.start, part.start + part.count, BATCH):
            n = min(BATCH, part.start + part.count - at)
            columns, names = [pa.array(np.arange(at, at + n, dtype=np.int64))], ["record_index"]
            found = {name: _arrow(np.fromfile(path, d.numpy, n, offset=at * d.size), d) for name, path, d in self.files}
            for name, out in (("lats", "lat"), ("lons", "lon"), ("time", "t"), ("data", "value")):
                if name in found:
                    columns.append(found[name])
                elif name == "time" and "lats" in found:
                    columns.append(pa.array(np.zeros(n, np.float32)))
                else:
                    continue
                names.append(out)
            yield pa.RecordBatch.from_arrays(columns, names=names)


class _Written(WriterCommitMessage):
    pass


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.dtype = options["path"], dtype(options["dtype"])
        self.beside = f"{self.path}.{uuid.uuid4().hex}.tmp"
        with open(self.beside, "wb") as f:  # once, on the driver: the whole file
            f.truncate(int(options["items"]) * self.dtype.size)

    def commit(self, messages):
        os.replace(self.beside, self.path)

    def abort(self, messages):
        if os.path.exists(self.beside):
            os.remove(self.beside)

    def write(self, batches):
        file = os.open(self.beside, os.O_WRONLY)
        try:
            for batch in batches:
                idx = batch.column("idx").to_numpy()
                if self.dtype.style == "coded":
                    items = np.frombuffer(b"".join(batch.column("value").to_pylist()), self.dtype.numpy)
                elif self.dtype.spark.startswith("decimal"):
                    items = np.array([int(v) for v in batch.column("value").to_pylist()], self.dtype.numpy)
                else:
                    items = batch.column("value").to_numpy(zero_copy_only=False).astype(self.dtype.numpy)
                by = np.argsort(idx, kind="stable")
                idx, items = idx[by], items[by]
                for part in np.split(np.arange(len(idx)), np.flatnonzero(np.diff(idx) != 1) + 1):
                    if len(part):
                        os.pwrite(file, items[part].tobytes(), int(idx[part[0]]) * self.dtype.size)
        finally:
            os.close(file)
        return _Written()


class RawSource(DataSource):
    """``gridloom_raw``: options lats, lons, time, data, dtype to read; path, dtype, items to write (idx, value)."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_raw"

    def schema(self) -> str:
        parts = ["record_index bigint"]
        if self.options.get("lats"):
            parts += ["lat float", "lon float", "t float"]
        if self.options.get("data"):
            parts.append(f"value {dtype(self.options.get('dtype', 'float32')).spark}")
        return ", ".join(parts)

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def read_raw(spark: SparkSession, lats: str | None = None, lons: str | None = None, time: str | None = None, data: str | None = None, dtype: str = "float32", slice: int = SLICE) -> DataFrame:
    """record_index, [lat, lon, t,] [value] of flat files; without a time file t is 0."""
    spark.dataSource.register(RawSource)
    given = {k: v for k, v in {"lats": lats, "lons": lons, "time": time, "data": data}.items() if v}
    _Reader({**given, "dtype": dtype})  # fail on the driver, before a job
    return spark.read.format("gridloom_raw").options(**given, dtype=dtype, slice=slice).load()


def read_raster(spark: SparkSession, path: str, width: int, dtype: str = "float32") -> DataFrame:
    """row, col, idx, value of a raster file."""
    items = read_raw(spark, data=path, dtype=dtype)
    w = F.lit(width).cast("long")
    return items.select(F.floor(F.col("record_index") / w).cast("int").alias("row"), F.pmod("record_index", w).cast("int").alias("col"), F.col("record_index").alias("idx"), "value")


def write_raster(raster: DataFrame, path: str, items: int, dtype: str = "float32", column: str = "value") -> None:
    """Write a dense raster (idx and a column of the type) as one file, rows from the top."""
    spark = raster.sparkSession
    spark.dataSource.register(RawSource)
    rows = raster.select("idx", F.col(column).alias("value")).repartitionByRange("idx").sortWithinPartitions("idx")
    rows.write.format("gridloom_raw").mode("append").options(path=path, dtype=dtype, items=items).save()
