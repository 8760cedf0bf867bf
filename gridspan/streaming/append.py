"""Growing arrays: appending micro-batches along the first dimension, and reading an array as it grows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..array import ArrayFrame
from ..plans.catalog import resize
from ..sources import zarr
from ..sources.box import grouped
from ..sources.stores import open_store


def extent(path: str, array: str) -> int:
    return zarr.open_array(open_store(path), array).shape[0]


def append_rows(rows: ArrayFrame, path: str, array: str, batch: int | None = None) -> int:
    """Rows after the array's present extent; the extent after it.

    With a batch number a repeated batch changes nothing: the number of the last one is kept in the array's attributes
    together with the extent that it began at, and is written again in the same place.
    """
    store = open_store(path)
    meta = zarr.open_array(store, array)
    base = f"{array.strip('/')}/" if array.strip("/") else ""
    last = meta.attributes.get("appended", {})
    start = meta.shape[0]
    if batch is not None and last.get("batch") is not None and batch <= last["batch"]:
        if batch < last["batch"]:
            return meta.shape[0]
        start = last["start"]
    n = rows.shape[0]
    resize(path, array, (start + n, *meta.shape[1:]))
    doc = json.loads(store.get(f"{base}zarr.json"))
    doc["attributes"] = {**(doc.get("attributes") or {}), "appended": {"batch": batch, "start": start}}
    store.put(f"{base}zarr.json", json.dumps(doc).encode())
    names = [f"i{k}" for k in range(rows.rank)]
    moved = rows.df.select((F.col(rows.dims[0]) + start).alias("i0"), *[F.col(d).alias(m) for d, m in zip(rows.dims[1:], names[1:], strict=True)], rows.v.alias("v"))
    outer = [c if isinstance(c, int) else max(c) for c in meta.chunks]
    cells = [F.expr(f"{m} div {c}") for m, c in zip(names, outer, strict=True)]
    spark = rows.df.sparkSession
    zarr.register(spark)
    moved = moved.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *cells).sortWithinPartitions(*cells, *names)
    moved.write.format("zarrarray").option("path", path).option("array", array).mode("append").save()
    return start + n


def append_stream(stream: DataFrame, path: str, array: str, checkpoint: str, value: str = "v"):
    """A query that appends each micro-batch of single values to a one-dimensional array, in the order of ``i0``."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            n = batch.count()
            if n:
                dense = batch.select("i0", F.col(value).alias("v"))
                low = dense.agg(F.min("i0").alias("low"), F.max("i0").alias("high")).first()
                if low["high"] - low["low"] + 1 != n:
                    raise ValueError("a batch's rows must be numbered without gaps")
                append_rows(ArrayFrame(dense.select((F.col("i0") - low["low"]).alias("i0"), "v"), ("i0",), (n,)), path, array, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class GrowingReader(DataSourceStreamReader):
    """Offsets are extents of the first dimension."""

    def __init__(self, path: str, array: str, step: int):
        self.path, self.array, self.step = path, array, step
        self.base = f"{array.strip('/')}/" if array.strip("/") else ""

    def initialOffset(self):
        return {"rows": 0}

    def latestOffset(self):
        return {"rows": extent(self.path, self.array)}

    def partitions(self, start, end):
        meta = zarr.open_array(open_store(self.path), self.array)
        low, high = [start["rows"], *[0] * (len(meta.shape) - 1)], [end["rows"], *meta.shape[1:]]
        each = max(1, self.step // max(1, meta.chunk_bytes()))
        return [p for p in grouped([(c, low, high) for c in meta.cells(low, high)], each) if p.cells] or grouped([], 1)

    def read(self, partition):
        store = open_store(self.path)
        meta = zarr.open_array(store, self.array)
        for cell, low, high in partition.cells:
            x = zarr.read_chunk(store, self.base, meta, cell, low, high)
            if x is None:
                x = zarr.full(tuple(meta.chunk_size(k, c) for k, c in enumerate(cell)), meta.kind, meta.fill)
            batch = zarr.elements(x, meta.origin(cell), meta, low, high)
            if batch is not None:
                yield batch

    def commit(self, end):
        pass


class GrowingSource(DataSource):
    """``spark.readStream.format("growingarray")`` with the options ``path`` and ``array``."""

    @classmethod
    def name(cls):
        return "growingarray"

    def schema(self):
        meta = zarr.open_array(open_store(self.options["path"]), self.options.get("array", ""))
        return T.StructType([*[T.StructField(d, T.LongType()) for d in meta.dims], T.StructField("v", zarr.spark_kind(meta.kind))])

    def streamReader(self, schema):
        return GrowingReader(self.options["path"], self.options.get("array", ""), int(self.options.get("partitionBytes", zarr.PARTITION_BYTES)))


def read_growing(spark, path: str, array: str = "") -> DataFrame:
    spark.dataSource.register(GrowingSource)
    return spark.readStream.format("growingarray").option("path", path).option("array", array).load()
