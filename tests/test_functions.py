"""Codecs, checksums, casts, transforms and texts."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspan.array import ArrayFrame
from gridspan.functions import casts, checksums, chunks, codecs, text
from gridspan.functions import transforms as tf


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_give_back_what_they_took(data):
    for name, (encode, decode) in codecs.CODECS.items():
        options = {"size": 4} if "shuffle" in name else {}
        assert decode(encode(data, **options), len(data), **options) == data, name
    for how in ("lz4", "zstd"):
        assert codecs.bitshuffle_decode(codecs.bitshuffle_encode(data, 4, compress=how), 4, compress=how, limit=len(data)) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.sampled_from(["zlib", "gzip", "bz2", "lz4", "lz4_filter", "lzf", "blosc", "crc32c", "fletcher32"]))
def test_damaged_bytes_raise_typed_errors(data, name):
    try:
        codecs.CODECS[name][1](data, 1000)
    except (codecs.CodecError, OSError, ValueError):
        pass
    except Exception as e:  # noqa: BLE001
        assert type(e).__name__ in ("error", "ArrowInvalid"), e


def test_limits_hold():
    bomb = codecs.zlib_encode(b"\0" * 100_000)
    with pytest.raises(codecs.CodecError):
        codecs.zlib_decode(bomb, 1000)


def test_known_checksums():
    assert checksums.crc32c(b"123456789") == 0xE3069283
    assert checksums.lookup3(b"Four score and seven years ago") == 0x17770551
    assert checksums.adler32(b"Wikipedia") == 0x11E60398
    long = np.random.default_rng(1).bytes(200_003)
    state = 0xFFFFFFFF
    for b in long:
        state = (state >> 8) ^ checksums._CRC32C[(state ^ b) & 255]
    assert checksums.crc32c(long) == state ^ 0xFFFFFFFF


def bytewise(data):
    state = 0xFFFFFFFF
    for b in data:
        state = (state >> 8) ^ checksums._CRC32C[(state ^ b) & 255]
    return state ^ 0xFFFFFFFF


def test_crc32c_of_all_lengths():
    rng = np.random.default_rng(2)
    values = [rng.bytes(n) for n in (*range(40), 63, 64, 65, 255, 256, 257, 511, 513, 3000, (1 << 18) - 1, (1 << 18) + 3, (1 << 18) + 65)]
    values += [b * n for b in (b"\0", b"\xff") for n in (1, 4, 64, 257)]
    assert [checksums.crc32c(v) for v in values] == [bytewise(v) for v in values]


def jenkins(data):
    """lookup3 one value and one word at a time."""
    m, turned = 0xFFFFFFFF, lambda x, k: (x << k | x >> (32 - k)) & 0xFFFFFFFF
    s = [(0xDEADBEEF + len(data)) & m] * 3
    for at in range(0, len(data), 12):
        s = [(x + int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "little")) & m for i, x in enumerate(s)]
        if at + 12 < len(data):
            for i, k in enumerate((4, 6, 8, 16, 19, 4)):
                x, y, z = i % 3, (i + 2) % 3, (i + 1) % 3
                s[x] = (s[x] - s[y] & m) ^ turned(s[y], k)
                s[y] = s[y] + s[z] & m
    for i, k in enumerate((14, 11, 25, 16, 4, 14, 24) if data else ()):
        x, y = (i + 2) % 3, (i + 1) % 3
        s[x] = (s[x] ^ s[y]) - turned(s[y], k) & m
    return s[2]


def test_lookup3_of_all_lengths():
    rng = np.random.default_rng(2)
    values = [rng.bytes(n) for n in (*range(40), 63, 64, 65, 255, 256, 257, 511, 513, 3000, (1 << 18) - 1, (1 << 18) + 3, (1 << 18) + 65)]
    values += [b * n for b in (b"\0", b"\xff") for n in (1, 4, 64, 257)]
    assert checksums.many("lookup3", values) == [checksums.lookup3(v) for v in values] == [jenkins(v) for v in values]
    assert checksums.lookup3_all([]).tolist() == [] and checksums.lookup3(b"") == 0xDEADBEEF


def test_checksum_columns(spark):
    values = [b"", None, b"123456789", b"Four score and seven years ago", b"ab" * 5000, None]
    df = spark.createDataFrame(list(enumerate(values)), "k int, data binary")
    names = ("crc32", "crc32c", "adler32", "fletcher32", "lookup3", "xxh64")
    got = {r.k: r for r in df.select("k", *[checksums.column(n, F.col("data")).alias(n) for n in names]).collect()}
    for k, v in enumerate(values):
        assert [got[k][n] for n in names] == [None if v is None else checksums.many(n, [v])[0] for n in names]


def test_many_short_values_are_hashed_together():
    rng = np.random.default_rng(3)
    values = [rng.bytes(1000 + k) for k in range(1000)]

    def seconds(run, values):
        start = time.process_time()
        run(values)
        return time.process_time() - start

    checksums.many("crc32c", values[:20])
    one_by_one = 10 * seconds(lambda vs: [bytewise(v) for v in vs], values[:100])
    assert seconds(lambda vs: checksums.many("crc32c", vs), values) < one_by_one / 2
    assert seconds(lambda vs: checksums.many("lookup3", vs), values) < one_by_one / 2


def test_codec_columns(spark):
    df = spark.createDataFrame([(1, b"abc" * 100), (2, None), (3, b"")], "k int, data binary")
    steps = [("shuffle", {"size": 4}), ("zlib", {}), ("crc32c", {})]
    back = codecs.coded(codecs.coded(df, steps), steps, decode=True)
    assert sorted((r.k, None if r.data is None else bytes(r.data)) for r in back.collect()) == [(1, b"abc" * 100), (2, None), (3, b"")]


def test_codec_passes_share_a_worker(spark):
    df = spark.createDataFrame([(1, b"abc" * 100), (2, None), (3, b"")], "k int, data binary")
    steps, more = [("shuffle", {"size": 4}), ("zlib", {}), ("crc32c", {})], [("blosc", {"size": 8})]
    back = codecs.recoded(df, [(steps, False), (steps, True), (more, False), (more, True)])
    assert sorted((r.k, None if r.data is None else bytes(r.data)) for r in back.collect()) == [(1, b"abc" * 100), (2, None), (3, b"")]


@pytest.mark.parametrize("name", ["codec_roundtrip"])
def test_a_task_has_one_worker_at_a_time(spark, tmp_path, name):
    from gridspan.plans import roundtrips

    spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = getattr(roundtrips, name)(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_batches_of_codecs_are_bounded(spark):
    rows = 60
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(rows, numPartitions=1).select("id", F.encode(F.expr("repeat('x', 1000000)"), "UTF-8").alias("data"))
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.get_total_buffer_size()]}) for b in batches)
    seen = [r.n for r in codecs.coded(df, [("adler32", {})]).mapInArrow(sizes, "n bigint").collect()]
    assert len(seen) > 5 and max(seen) < 3 * checksums.BATCH_BYTES
    out = pa.array([b"x" * 1_000_000] * rows)
    assert [len(p) for p in checksums.slices(out)] == [4] * 15


@pytest.mark.parametrize("rounding, want", [("nearest-even", [2, -2, 0, 4]), ("towards-zero", [2, -2, 0, 3]), ("towards-positive", [3, -2, 1, 4]), ("towards-negative", [2, -3, 0, 3]), ("nearest-away", [3, -3, 1, 4])])
def test_roundings(spark, rounding, want):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.5,), (3.5,)], "x double")
    assert [r[0] for r in df.select(casts.cast_value(F.col("x"), "int32", rounding=rounding)).collect()] == want


def test_ranges(spark):
    df = spark.createDataFrame([(300.0,), (-1.0,), (math.inf,)], "x double")
    assert [r[0] for r in df.select(casts.cast_value(F.col("x"), "uint8", out_of_range="clamp")).collect()] == [255, 0, 255]
    finite = spark.createDataFrame([(300.0,), (-1.0,)], "x double")
    assert [r[0] for r in finite.select(casts.cast_value(F.col("x"), "uint8", out_of_range="wrap")).collect()] == [44, 255]
    with pytest.raises(Exception, match="not a value"):
        df.select(casts.cast_value(F.col("x"), "uint8")).collect()
    nan = spark.createDataFrame([(math.nan,)], "x double")
    assert nan.select(casts.cast_value(F.col("x"), "int8", scalar_map=[(math.nan, 7)])).first()[0] == 7
    wide = spark.createDataFrame([(-1,)], "x bigint")
    assert int(wide.select(casts.cast_value(F.col("x"), "uint64", source="int64", out_of_range="wrap")).first()[0]) == 2**64 - 1


def test_narrow_floats():
    x = np.array([1 + 2**-12, -0.0, np.nan, 1e30])
    assert casts.narrow_float(x[:1], "float16", "towards-positive")[0] > 1
    assert casts.narrow_float(x[:1], "float16")[0] == 1
    assert np.signbit(casts.narrow_float(x[1:2], "float16"))[0]
    assert casts.narrow_float(x[3:], "float16", out_of_range="clamp")[0] == np.finfo(np.float16).max
    with pytest.raises(OverflowError):
        casts.narrow_float(x[3:], "float16")
    assert casts.round_bits(np.array([1.0000001], np.float32), 3)[0] == 1


def test_transforms(spark):
    t = tf.Sequence((tf.Scale((2.0, 4.0)), tf.MapAxis((1, 0)), tf.Translation((1.0, -1.0))))
    df = spark.createDataFrame([(3.0, 5.0)], "x double, y double")
    assert tuple(tf.transform_points(df, ["x", "y"], t).first()) == (21.0, 5.0)
    back = tf.Sequence((t, t.inverse()))
    assert tuple(tf.transform_points(df, ["x", "y"], back).first()) == (3.0, 5.0)
    assert tf.Scale((0.0, 1.0)).inverse() is None and tf.ProjectAxis(drop=(0,)).inverse() is None
    assert tf.Affine(((1.0, 2.0, 0.0), (2.0, 4.0, 0.0))).inverse() is None
    with pytest.raises(ValueError):
        tf.rotation([[1, 1], [0, 1]])
    path = tf.coordinate_path([("a", "b", tf.Scale((2.0,))), ("c", "b", tf.Translation((1.0,)))], "a", "c")
    assert path.apply([F.lit(3.0)]) and tf.coordinate_path([], "a", "z") is None


def test_chunks():
    assert chunks.run_lengths([3, [2, 3]]) == [3, 2, 2, 2]
    assert chunks.key_text(()) == "c" and chunks.key_text((), "v2", ".") == "0" and chunks.key_text((1, 2)) == "c/1/2"
    assert chunks.overlapped((5,), (10,), (4,)) == [range(1, 4)]
    assert np.prod(chunks.guess_chunks((10_000, 10_000), 8)) * 8 <= 1 << 20
    assert chunks.block_shape((10, 1000, 1000), 8, 1 << 20) == (1, 131, 1000)


def test_texts(spark):
    df = spark.createDataFrame([(-1, "ab\0c", "x "), (text.NAT, "q  ", 'a"b')], "n bigint, s string, c string")
    got = df.select(text.time_text(F.col("n"), "D").alias("d"), text.fixed_string(F.col("s")).alias("s"), text.csv_field(F.col("c")).alias("c"), text.time_text(F.col("n"), "ns").alias("ns")).collect()
    assert tuple(got[0]) == ("1969-12-31", "ab", '"x "', "1969-12-31T23:59:59.999999999")
    assert got[1]["d"] is None and got[1]["c"] == '"a""b"'
    assert text.bytes_text(1536) == "1.5 KiB" and text.shape_text((4,)) == "(4,)"
    for value, kind in ((math.inf, "float64"), (1.5, "float32"), (True, "bool"), (3, "int8"), (1 + 2j, "complex128")):
        assert text.fill_from_json(text.fill_to_json(value, kind), kind) == value
    a = ArrayFrame(spark.range(6).select(F.expr("id div 3").alias("i0"), F.expr("id % 3").alias("i1"), F.col("id").alias("v")), ("i0", "i1"), (2, 3))
    assert [r["line"] for r in text.dump_lines(a, "json").collect()] == ["[0,1,2]", "[3,4,5]"]
