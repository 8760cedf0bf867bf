"""Shared plumbing of the corpus operators: bounded batches, shared checkpoints."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a Python worker handles at a time; longer single texts are handled alone.
SLICE_BYTES = 4_000_000
#: Bytes of the batches that go between Spark and its Python workers.
BATCH_BYTES = 8 << 20
#: What a worker process keeps from task to task, by name. Spark reuses its workers, so it would outlive the operator.
KEPT: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or else the checkpoint directory that the context was given.

    Only a session in a single process, such as a test's, gets a temporary one of its own; a cluster has to name it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridspan-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared checkpoint folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Row ranges of ``batch`` whose texts have ``limit`` bytes together at most (one row at least)."""
    if not batch.num_rows:
        return
    length = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    total = np.cumsum(length)
    low = 0
    while low < batch.num_rows:
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(low, high - low)
        low = high


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES from here on, for memory's sake: rows are as long as texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def on_worker(spark: SparkSession, function, *arguments):
    """``function(*arguments)`` computed in one task: for fits on bounded samples, which then leave the driver alone."""
    sent = spark.sparkContext.broadcast(arguments)

    def once(_):
        try:
            return function(*sent.value)
        finally:
            give_back()

    return spark.sparkContext.parallelize([0], 1).map(once).first()


def give_back() -> None:
    """Return to the system what this process has freed: an idle worker's memory still counts as its executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def tidy(function: Callable[[Iterator], Iterator], keeps: str | None = None) -> Callable[[Iterator], Iterator]:
    """``function`` over a task's batches, after dropping all that is KEPT but ``keeps``; freed memory is given back at its end."""

    @wraps(function)
    def run(batches):
        for name in [n for n in KEPT if n != keeps]:
            del KEPT[name]
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers, each of as many bytes as the largest needs."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return kind.char.encode() + zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), blob[:1].decode())


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(31)) * np.uint64(buckets)) >> np.uint64(32)


def grouped(batches, columns: tuple[str, ...], take: Callable) -> Iterator:
    """``take(key, rows)`` of each run of rows with equal values in the first of ``columns``; rows: the values of the others."""
    key, rows = None, []
    for batch in batches:
        for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if rows and values[0] != key:
                yield from take(key, rows)
                rows = []
            key = values[0]
            rows.append(values[1:])
    if rows:
        yield from take(key, rows)
