"""Values at the ends of the number types, staged writes, narrow plans, and files read by ranges."""

import functools
import http.server
import math
import os
import threading
from decimal import Decimal

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridspan.array import ArrayFrame
from gridspan.functions import casts
from gridspan.operators import assemble, reduce, selection
from gridspan.plans import catalog
from gridspan.sources import h5, stores, zarr
from gridspan.streaming import append

EDGES = [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 0.49999999999999994, 127.5, -128.5, 255.5, 2.0**31, -(2.0**31), 2.0**53, 2.0**53 + 2, -(2.0**53) - 2, 2.0**62, 1e19, -1e19, 2.0**63, -(2.0**63), 2.0**64, 2.0**64 - 2048, 1e300, -1e300]


def whole(x: float, rounding: str) -> int:
    exact = Decimal(x)
    low = int(exact.to_integral_value("ROUND_FLOOR"))
    rest = exact - low
    if not rest:
        return low
    up = {"towards-zero": x < 0, "towards-positive": True, "towards-negative": False}
    if rounding in up:
        return low + up[rounding]
    if rest != Decimal("0.5"):
        return low + (rest > Decimal("0.5"))
    return low + (low % 2 if rounding == "nearest-even" else x > 0)


def wanted(x: float, target: str, rounding: str, rule: str):
    low, high = casts.RANGES[target]
    n = whole(x, rounding)
    if rule == "clamp":
        return min(max(n, low), high)
    if rule == "wrap":
        return (n - low) % (high - low + 1) + low
    return n if low <= n <= high else None


@pytest.mark.parametrize("rounding", casts.ROUNDINGS)
def test_float_casts_at_the_edges(spark, rounding):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(EDGES)], "k int, v double")
    for target in ("int8", "uint8", "int32", "int64", "uint64"):
        for rule in ("clamp", "wrap"):
            got = {r.k: int(r.o) for r in df.select("k", casts.cast_value(F.col("v"), target, rounding=rounding, out_of_range=rule).alias("o")).collect()}
            want = [wanted(x, target, rounding, rule) for x in EDGES]
            assert [got[i] for i in range(len(EDGES))] == want
            assert casts.cast_array(np.array(EDGES), target, rounding, rule).tolist() == want
        good = [x for x in EDGES if wanted(x, target, rounding, "error") is not None]
        assert casts.cast_array(np.array(good), target, rounding).tolist() == [wanted(x, target, rounding, "error") for x in good]
        rows = spark.createDataFrame([(x,) for x in good], "v double")
        assert sorted(int(r[0]) for r in rows.select(casts.cast_value(F.col("v"), target, rounding=rounding)).collect()) == sorted(wanted(x, target, rounding, "error") for x in good)


def test_casts_refuse():
    for x in (math.nan, math.inf, 3e10):
        with pytest.raises(OverflowError):
            casts.cast_array(np.array([x]), "int32")
    with pytest.raises(OverflowError):
        casts.cast_array(np.array([math.inf]), "int32", out_of_range="wrap")
    assert casts.cast_array(np.array([math.inf, -math.inf]), "uint8", out_of_range="clamp").tolist() == [255, 0]
    assert casts.cast_array(np.array([math.nan, 1.0]), "uint8", pairs=[["NaN", 9]]).tolist() == [9, 1]
    assert casts.cast_array(np.array([300, -4]), "uint8", out_of_range="clamp").tolist() == [255, 0]
    assert casts.cast_array(np.array([2**64 - 1], np.uint64), "int64", out_of_range="clamp").tolist() == [2**63 - 1]
    assert casts.cast_array(np.array([300, -4]), "uint8", out_of_range="wrap").tolist() == [44, 252]
    assert casts.cast_array(np.array([1e-9, 1.0]), "float32").dtype == np.float32


def test_store_exactly(spark):
    longs = spark.createDataFrame([(2**53 + 1,), (2**63 - 1,), (-(2**63),)], "v bigint")
    assert sorted(r[0] for r in longs.select(casts.store_exactly(F.col("v"), "int64")).collect()) == [-(2**63), 2**53 + 1, 2**63 - 1]
    doubles = spark.createDataFrame([(2.0**53,), (-(2.0**63),), (2.0**62,)], "v double")
    assert sorted(r[0] for r in doubles.select(casts.store_exactly(F.col("v"), "int64")).collect()) == [-(2**63), 2**53, 2**62]
    for value, kind, target in ((2.0**63, "double", "int64"), (2.0**64, "double", "uint64"), (0.5, "double", "int8"), (128, "bigint", "int8"), (-1, "bigint", "uint64"), (math.nan, "double", "int8")):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(value,)], f"v {kind}").select(casts.store_exactly(F.col("v"), target)).collect()


@pytest.mark.parametrize("rounding", casts.ROUNDINGS)
def test_cast_value_codec(rounding):
    codecs = [{"name": "cast_value", "configuration": {"data_type": "int32", "rounding": rounding, "out_of_range": "clamp"}}, {"name": "bytes", "configuration": {"endian": "little"}}]
    meta = zarr.parse_v3(zarr.make_document((4,), "float64", (4,), codecs_=codecs))
    x = np.array([2.7, -2.5, 3e10, 0.5])
    data = zarr.encode(meta.pipeline, x, meta.kind, meta.fill)
    assert zarr.decode(meta.pipeline, data, (4,), meta.kind, meta.fill).tolist() == [wanted(v, "int32", rounding, "clamp") for v in x]
    del codecs[0]["configuration"]["out_of_range"]
    meta = zarr.parse_v3(zarr.make_document((4,), "float64", (4,), codecs_=codecs))
    with pytest.raises(OverflowError):
        zarr.encode(meta.pipeline, x, meta.kind, meta.fill)


def vector(spark, n, value="id"):
    return ArrayFrame(spark.range(n).select(F.col("id").alias("i0"), F.expr(value).cast("double").alias("v")), ("i0",), (n,))


def files(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names}


def test_a_failed_write_leaves_the_array(spark, tmp_path):
    path = str(tmp_path)
    zarr.write_array(vector(spark, 100), path, "a", data_type="float64", chunks=(10,))
    before = files(path)
    bad = vector(spark, 100, "CASE WHEN id = 55 THEN raise_error('no') ELSE 7 END")
    for overwrite in (True, False):
        with pytest.raises(PySparkException):
            zarr.write_array(bad, path, "a", data_type="float64", chunks=(10,), overwrite=overwrite)
        assert files(path) == before
    zarr.write_array(vector(spark, 30, "-1"), path, "a", data_type="float64", chunks=(10,))
    assert sorted((r.i0, r.v) for r in zarr.read_array(spark, path, "a").df.collect()) == [(i, -1.0) for i in range(30)]
    assert len(files(path)) == 5 and not any("staged" in k for k in files(path))


def test_growing_writes_metadata_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    zarr.write_array(vector(spark, 100), path, "a", data_type="float64", chunks=(10,))
    monkeypatch.setattr(zarr.ArrayMeta, "cells", lambda self: pytest.fail("chunks were listed"))
    catalog.resize(path, "a", (1000,))
    monkeypatch.undo()
    assert append.append_rows(vector(spark, 5), path, "a") == 1005
    assert zarr.read_array(spark, path, "a").shape == (1005,)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_overlays_and_boxes_move_nothing(spark):
    rng = np.random.default_rng(2)
    grid = lambda h, w, v: ArrayFrame(spark.range(h * w).select(F.expr(f"id div {w}").alias("i0"), F.expr(f"id % {w}").alias("i1"), (F.col("id") + v).alias("v")), ("i0", "i1"), (h, w))
    parts, want = [], np.full((12, 12), -1)
    for k in range(6):
        h, w, i, j = (int(x) for x in rng.integers(2, 9, 4))
        parts.append((grid(h, w, 1000 * k), (i, j)))
        block = np.arange(h * w).reshape(h, w) + 1000 * k
        cut = want[i : i + h, j : j + w]
        cut[:] = block[: cut.shape[0], : cut.shape[1]]
    out = assemble.overlay(parts, (12, 12))
    assert not exchanges(out.df)
    assert {(r.i0, r.i1): r.v for r in out.df.collect()} == {(i, j): v for (i, j), v in np.ndenumerate(want) if v >= 0}
    new = assemble.write_box(grid(8, 8, 0), (2, 3), grid(2, 2, 500))
    want = np.arange(64).reshape(8, 8)
    want[2:4, 3:5] = 500 + np.arange(4).reshape(2, 2)
    assert not exchanges(new.df) and {(r.i0, r.i1): r.v for r in new.df.collect()} == dict(np.ndenumerate(want))


def test_points_narrow_the_scan(spark, tmp_path):
    zarr.write_array(vector(spark, 1000), str(tmp_path), "a", data_type="float64", chunks=(10,))
    a = zarr.read_array(spark, str(tmp_path), "a", partitionBytes=80)
    got = selection.points(a, [(503,), (500,), (503,)])
    assert sorted((r.k, r.v) for r in got.collect()) == [(0, 503.0), (1, 500.0), (2, 503.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "i0" in plan and "500" in plan
    assert a.df.filter("i0 >= 500 and i0 <= 503").rdd.getNumPartitions() == 1


def test_integer_means_beyond_doubles(spark):
    big = 2**53 + 1
    a = ArrayFrame(spark.createDataFrame([(0, big), (1, big), (2, -3), (3, 0)], "i0 bigint, v bigint"), ("i0",), (4,))
    assert sorted(r.v for r in reduce.block_mean(a, (2,), "int").df.collect()) == [-1, big]


@pytest.fixture
def served(tmp_path):
    asked = []

    class Ranges(http.server.SimpleHTTPRequestHandler):
        def do_GET(self):
            data = open(self.translate_path(self.path), "rb").read() if os.path.isfile(self.translate_path(self.path)) else None
            if data is None:
                return self.send_error(404)
            low, high = self.headers["Range"].removeprefix("bytes=").split("-")
            part = data[int(low) : int(high) + 1]
            asked.append(len(part))
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {low}-{int(low) + len(part) - 1}/{len(data)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Ranges, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_hdf5_by_ranges(spark, tmp_path, served):
    url, asked = served
    a = ArrayFrame(spark.range(200_000).select(F.expr("id div 1000").alias("i0"), F.expr("id % 1000").alias("i1"), (F.col("id") + F.pmod(F.hash("id"), F.lit(1 << 30)) * 2.0**-31).alias("v")), ("i0", "i1"), (200, 1000))
    h5.write_dataset(a, str(tmp_path / "a.h5"), "/x", dtype="<f8", chunks=(20, 100))
    box = selection.box(h5.read_dataset(spark, f"{url}/a.h5", "/x"), (100, 500), (3, 4)).df
    assert sorted(float(int(r.v)) for r in box.collect()) == [1000.0 * i + j for i in range(100, 103) for j in range(500, 504)]
    assert 0 < sum(asked) < os.path.getsize(tmp_path / "a.h5")
    whole = h5.read_dataset(spark, f"{url}/a.h5", "/x").df
    assert whole.agg(F.sum(F.floor("v"))).first()[0] == sum(range(200_000))


def test_pages():
    data = bytes(range(256)) * 40
    store = stores.MemoryStore({"k": data})
    calls = []
    get = store.get
    store.get = lambda *a: calls.append(a) or get(*a)
    store.size = lambda key: len(data)
    pages = stores.Pages(store, "k", page=100, most=8)
    for low, high in ((0, 10), (95, 105), (0, 10_240), (10_200, 20_000), (500, 500), (350, 420)):
        assert pages[low:high] == data[low:high]
    assert pages[777] == data[777] and len(pages) == len(data)
    assert len(calls) < 9
