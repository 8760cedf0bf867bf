"""Registered queries that go through the formats: what was written is read back, whole or in part."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import casts, checksums, codecs
from ..operators import reduce, selection
from ..sources import h5, zarr
from . import catalog, images, registry, validate
from .registry import MATRIX, matrix, query, table


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; only a session in a single process gets a local one without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "gridspan")
    return f"{base.removeprefix('file://')}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str, name: str, **options):
    a, path = matrix(spark, sf_dir), scratch(spark, name)
    zarr.write_array(a, path, "m", data_type="float32", chunks=(64, 16), **options)
    return a, path


@query(f"SELECT i0, i1, v FROM {MATRIX}")
def zarr_roundtrip(spark, sf_dir):
    return zarr.read_array(spark, stored(spark, sf_dir, "zarr")[1], "m").df


@query(f"SELECT i0 - 100 AS i0, i1 - 8 AS i1, v FROM {MATRIX} WHERE i0 >= 100 AND i0 < 300 AND i1 >= 8 AND i1 < 40")
def zarr_sharded_box(spark, sf_dir):
    path = stored(spark, sf_dir, "shards", shards=(256, 64))[1]
    return selection.box(zarr.read_array(spark, path, "m"), (100, 8), (200, 32)).df


@query(f"SELECT i0 // 2 AS i0, i1 // 2 AS i1, round(sum(v::DOUBLE) / count(*), 6) AS v FROM {MATRIX} GROUP BY i0 // 2, i1 // 2")
def zarr_block_mean(spark, sf_dir):
    a = reduce.block_mean(zarr.read_array(spark, stored(spark, sf_dir, "mean")[1], "m"), (2, 2))
    return a.with_value(F.round("v", 6)).df


@query(f"SELECT (i0 - 10) // 7 AS i0, (i1 - 3) // 5 AS i1, v FROM {MATRIX} WHERE i0 >= 10 AND (i0 - 10) % 7 = 0 AND (i0 - 10) // 7 < 60 AND i1 >= 3 AND (i1 - 3) % 5 = 0 AND (i1 - 3) // 5 < 12")
def hdf5_strided(spark, sf_dir):
    path = f"{scratch(spark, 'strided')}.h5"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    h5.write_dataset(matrix(spark, sf_dir), path, "/g/m", dtype="<f4", chunks=(64, 16), filters=("shuffle", "deflate", "fletcher32"))
    return selection.hyperslab(h5.read_dataset(spark, path, "/g/m"), (10, 3), (60, 12), (7, 5)).df


@query(f"SELECT i0, i1, v FROM {MATRIX}")
def hdf5_roundtrip(spark, sf_dir):
    path = f"{scratch(spark, 'roundtrip')}.h5"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    h5.write_dataset(matrix(spark, sf_dir), path, "/m", dtype="<f4", chunks=(100, 64), filters=("zstd",))
    return h5.read_dataset(spark, path, "/m").df


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def codec_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    passes = []
    for steps in ([("shuffle", {"size": 4}), ("zstd", {}), ("crc32c", {})], [("bitshuffle", {"size": 4, "compress": "lz4"}), ("fletcher32", {})], [("blosc", {"size": 8})], [("bz2", {}), ("adler32", {})]):
        passes += [(steps, False), (steps, True)]
    return codecs.recoded(df, passes).select("doc_id", F.sha2("data", 256).alias("digest"))


@query()
def chunk_checksums(spark, sf_dir):
    checksums.bounded_batches(spark)
    data = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", *[checksums.column(n, data).alias(n) for n in ("crc32", "crc32c", "adler32", "fletcher32", "lookup3", "xxh64")])


@query("SELECT event_id AS i0, value::FLOAT AS v FROM events")
def cast_float32(spark, sf_dir):
    return registry.events(spark, sf_dir, casts.cast_float(F.col("value"), "float32")).df


@query("SELECT '/m' AS path, 'array' AS kind, 3 AS format, (SELECT count(*) FROM embeddings)::VARCHAR || 'x64' AS shape UNION ALL SELECT '/', 'group', 3, NULL")
def catalog_nodes(spark, sf_dir):
    path = stored(spark, sf_dir, "catalog")[1]
    return catalog.nodes(spark, path).select("path", "kind", "format", F.when(F.col("shape").isNotNull(), F.concat_ws("x", F.col("shape").cast("array<string>"))).alias("shape"))


@query("SELECT DISTINCT 'm/c/' || (i0 // 64) || '/' || (i1 // 16) AS key FROM " + MATRIX)
def chunk_catalog(spark, sf_dir):
    return catalog.chunks(spark, stored(spark, sf_dir, "chunks")[1], "m").select("key")


@query(f"""WITH a AS (SELECT i0 // 2 AS i0, i1 // 2 AS i1, (sum(v::DOUBLE) / count(*))::FLOAT AS v FROM {MATRIX} GROUP BY i0 // 2, i1 // 2)
SELECT i0, i1, round(v::DOUBLE, 5) AS v FROM a""")
def image_pyramid_level(spark, sf_dir):
    path = scratch(spark, "image")
    images.write_pyramid(matrix(spark, sf_dir), path, "", axes="yx", factors=(2, 2), data_type="float32", chunks=(128, 32), levels=2)
    return images.level(spark, path, "", 1)[0].with_value(F.round(F.col("v").cast("double"), 5)).df


@query()
def image_issues(spark, sf_dir):
    path = scratch(spark, "issues")
    images.write_pyramid(matrix(spark, sf_dir), path, "", axes="yx", factors=(2, 2), data_type="float32", chunks=(128, 32), levels=2)
    return validate.validate(spark, path)

