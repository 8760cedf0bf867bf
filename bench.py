"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridspan.array import ArrayFrame
from gridspan.operators import reduce, selection
from gridspan.plans import registry
from gridspan.sources import h5, zarr

SIDE = 2048
HEADLINE = ["hyperslab_strided", "box", "points", "transpose", "reshape", "block_mean_f32", "block_mode", "pyramid_nearest", "delta_encode", "virtual_overlay", "resize_grow", "cast_clamp_u8", "displacement_linear", "chunk_keys"]


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def matrix_file(folder: str) -> str:
    """A 2048 x 2048 float64 array of 1,024 gzip chunks, 32 MiB, written from memory."""
    store, doc = zarr.open_store(folder), zarr.make_document((SIDE, SIDE), "float64", (64, 64), codecs_=[{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 4}}])
    store.put("m/zarr.json", json.dumps(doc).encode())
    meta = zarr.open_array(store, "m")
    x = np.add.outer(np.arange(SIDE) * 0.5, np.arange(SIDE))
    for cell in meta.cells():
        i, j = (c * 64 for c in cell)
        store.put(f"m/{meta.key(cell)}", zarr.encode(meta.pipeline, x[i : i + 64, j : j + 64], meta.kind, meta.fill))
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="gridspan-bench-")
    times: dict[str, float] = {}
    try:
        sink(registry.QUERIES["block_mean_f32"](spark, sf_dir))  # warm-up
        for name in HEADLINE:
            began = time.time()
            sink(registry.QUERIES[name](spark, sf_dir))
            times[name] = round(time.time() - began, 3)
        small = ArrayFrame(spark.range(4096).select(F.expr("id div 64").alias("i0"), F.expr("id % 64").alias("i1"), F.col("id").cast("double").alias("v")), ("i0", "i1"), (64, 64))
        for _ in range(2):  # warm-up of each kind of scan and write
            zarr.write_array(small, folder, "s", data_type="float64", chunks=(16, 16))
            sink(selection.box(zarr.read_array(spark, folder, "s"), (8, 8), (9, 9)).df)
            h5.write_dataset(small, f"{folder}/s.h5", "/s", dtype="<f8", chunks=(16, 16))
            sink(selection.box(h5.read_dataset(spark, f"{folder}/s.h5", "/s"), (8, 8), (9, 9)).df)
        matrix_file(folder)
        array = zarr.read_array(spark, folder, "m", partitionBytes=4 << 20)
        sink(array.df)
        for name, make in {
            "zarr_whole_read": lambda: array.df,
            "zarr_box": lambda: selection.box(array, (512, 512), (512, 512)).df,
            "zarr_stride_2x2": lambda: selection.hyperslab(array, (0, 0), (SIDE // 2, SIDE // 2), (2, 2)).df,
            "zarr_block_mean": lambda: reduce.block_mean(array, (2, 2)).df,
        }.items():
            began = time.time()
            sink(make())
            times[name] = round(time.time() - began, 3)
        a = ArrayFrame(spark.range(1 << 20).select(F.expr("id div 1024").alias("i0"), F.expr("id % 1024").alias("i1"), F.col("id").cast("double").alias("v")), ("i0", "i1"), (1024, 1024))
        began = time.time()
        zarr.write_array(a, folder, "w", data_type="float64", chunks=(128, 128))
        times["zarr_write"] = round(time.time() - began, 3)
        began = time.time()
        h5.write_dataset(a, f"{folder}/w.h5", "/w", dtype="<f8", chunks=(128, 128))
        times["hdf5_write"] = round(time.time() - began, 3)
        began = time.time()
        sink(h5.read_dataset(spark, f"{folder}/w.h5", "/w", partitionBytes=1 << 20).df)
        times["hdf5_whole_read"] = round(time.time() - began, 3)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "seconds for the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
