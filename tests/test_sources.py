"""Writers into readers, partial reads, pruning, damage."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.array import ArrayFrame
from gridspan.operators import selection
from gridspan.sources import h5, stores, zarr
from gridspan.sources.h5format import FormatError, H5File, open_dataset

X = np.arange(50 * 30).reshape(50, 30) * 3


@pytest.fixture(scope="module")
def a(spark):
    df = spark.range(1500).select(F.expr("id div 30").alias("i0"), F.expr("id % 30").alias("i1"), (F.col("id") * 3).cast("int").alias("v"))
    return ArrayFrame(df, ("i0", "i1"), (50, 30))


def dense(a):
    out = np.full(a.shape, -1)
    p = a.df.toPandas()
    out[tuple(p[d] for d in a.dims)] = p["v"]
    return out


LITTLE = {"name": "bytes", "configuration": {"endian": "little"}}
PIPELINES = {
    "default": {},
    "sharded": {"shards": (32, 14)},
    "transposed": {"codecs_": [{"name": "transpose", "configuration": {"order": [1, 0]}}, {"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 5}}, {"name": "crc32c"}]},
    "blosc": {"codecs_": [LITTLE, {"name": "blosc", "configuration": {"typesize": 4}}]},
    "delta": {"codecs_": [{"name": "numcodecs.delta", "configuration": {"dtype": "<i4"}}, LITTLE, {"name": "numcodecs.zlib", "configuration": {"level": 1}}]},
}


@pytest.mark.parametrize("name", PIPELINES)
def test_zarr_round_trip(spark, a, tmp_path, name):
    zarr.write_array(a, str(tmp_path), "x", data_type="int32", chunks=(16, 7), **PIPELINES[name])
    back = zarr.read_array(spark, str(tmp_path), "x")
    assert (dense(back) == X).all()
    assert (dense(selection.box(back, (13, 5), (9, 11))) == X[13:22, 5:16]).all()


def test_zarr_pruning(spark, a, tmp_path):
    zarr.write_array(a, str(tmp_path), "x", data_type="int32", chunks=(10, 10))
    reader = zarr.ZarrReader(str(tmp_path), "x", "element", True, 1)
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    list(reader.pushFilters([GreaterThanOrEqual(("i0",), 20), LessThan(("i0",), 30), LessThan(("i1",), 10)]))
    assert [list(p.cells) for p in reader.partitions()] == [[(2, 0)]]


def test_chunk_plans():
    meta = zarr.ArrayMeta((20, 7), zarr.kind_of("int32"), (6, [3, 2, 2]), [], 0)
    assert meta.cell_box() == [range(4), range(3)] and meta.cell_box([6, 3], [12, 5]) == [range(1, 2), range(1, 2)]
    assert meta.cell_box([5, 2], [7, 6]) == [range(2), range(3)] and list(meta.cells([20, 0], [20, 7])) == []
    from gridspan.sources.box import cell_ranges

    parts = cell_ranges((1, 2), (2, 3), 4)
    assert [list(p.cells) for p in parts] == [[(1, 2), (1, 3), (1, 4), (2, 2)], [(2, 3), (2, 4)]]
    assert len(cell_ranges((0,), (10**12,), 1)) <= 100_000


def test_zarr_fill(spark, tmp_path):
    df = spark.createDataFrame([(3, 7), (4, 0)], "i0 bigint, v int")
    zarr.write_array(ArrayFrame(df, ("i0",), (20,)), str(tmp_path), "x", data_type="int32", chunks=(5,), fill=0)
    files = [k for k in stores.open_store(str(tmp_path)).keys() if "/c/" in k]
    assert files == ["x/c/0"]
    assert dense(zarr.read_array(spark, str(tmp_path), "x")).tolist() == [0, 0, 0, 7] + [0] * 16
    assert zarr.read_array(spark, str(tmp_path), "x", fill="drop").df.count() == 5


def test_zarr_v2_and_kinds(spark, tmp_path):
    store = stores.open_store(str(tmp_path))
    store.put("a/.zarray", json.dumps({"zarr_format": 2, "shape": [4, 3], "chunks": [2, 3], "dtype": ">i2", "compressor": {"id": "zlib", "level": 1}, "fill_value": 5, "order": "F", "filters": None}).encode())
    x = np.arange(12, dtype=">i2").reshape(4, 3)
    import zlib

    store.put("a/0.0", zlib.compress(np.asfortranarray(x[:2]).tobytes(order="F")))
    got = dense(zarr.read_array(spark, str(tmp_path), "a"))
    assert got.tolist() == [[0, 1, 2], [3, 4, 5], [5, 5, 5], [5, 5, 5]]
    words = ArrayFrame(spark.createDataFrame([(0, "é"), (2, "xyz")], "i0 bigint, v string"), ("i0",), (3,))
    zarr.write_array(words, str(tmp_path), "s", data_type="string", chunks=(2,), fill="")
    assert [r.v for r in zarr.read_array(spark, str(tmp_path), "s").sorted().collect()] == ["é", "", "xyz"]


def test_zip_store(spark, a, tmp_path):
    zarr.write_array(a, str(tmp_path / "d"), "x", data_type="int32", chunks=(16, 7))
    stores.pack_zip(stores.open_store(str(tmp_path / "d")), str(tmp_path / "d.zip"))
    assert (dense(zarr.read_array(spark, str(tmp_path / "d.zip"), "x")) == X).all()
    assert stores.sniff(str(tmp_path / "d.zip")) == "zip" and stores.sniff(str(tmp_path / "d" / "x")) == "zarr"


def test_store_ranges(tmp_path):
    for store in (stores.MemoryStore(), stores.FileStore(str(tmp_path))):
        store.put("a/b", b"0123456789")
        assert store.get("a/b", 2, 3) == b"234" and store.get("a/b", -3) == b"789" and store.get("a/b", -4, 2) == b"67"
        assert store.get("a/c") is None and store.keys() == ["a/b"]
    with pytest.raises(ValueError):
        stores.FileStore(str(tmp_path)).get("../x")


def test_h5_values(tmp_path):
    path = str(tmp_path / "a.h5")
    arrays = {
        "/x": np.arange(12, dtype=">i4").reshape(3, 4), "/g/f": np.array([1.5, -0.0], "f2"), "/g/s": np.array([b"abc", b""]),
        "/g/c": np.array([(1, 2.5), (3, 4.5)], [("a", "i4"), ("b", "f8")]), "/b": np.array([True, False]), "/u": np.array([0, 2**64 - 1], "u8"), "/one": np.array(42.0),
    }
    h5.write_arrays(path, arrays, {"/x": {"units": "K", "n": np.int32(3)}})
    f = H5File(path)
    got = {}
    for name in arrays:
        ds = open_dataset(f, name)
        got[name] = f.values(h5.row_block(f, ds, 0, ds.shape[0] if ds.shape else 1), ds.type).to_pylist()
    assert got["/x"] == list(range(12)) and got["/g/f"] == [1.5, 0.0] and got["/g/s"] == ["abc", ""] and got["/b"] == [True, False]
    assert got["/g/c"] == [{"a": 1, "b": 2.5}, {"a": 3, "b": 4.5}] and [int(v) for v in got["/u"]] == [0, 2**64 - 1] and got["/one"] == [42.0]
    assert f.attributes(f.resolve("/x"))["units"][2].to_pylist() == ["K"]
    assert stores.sniff(path) == "hdf5"


def test_h5_round_trip(spark, a, tmp_path):
    path = str(tmp_path / "c.h5")
    for filters in ((), ("shuffle", "deflate", "fletcher32"), ("zstd",), ("lz4",), ("bzip2",)):
        h5.write_dataset(a, path, "/run/t", dtype="<i4", chunks=(16, 7), filters=filters, attributes={"k": "v"})
        back = h5.read_dataset(spark, path, "/run/t")
        assert (dense(back) == X).all()
        assert (dense(selection.box(back, (13, 5), (9, 11))) == X[13:22, 5:16]).all()
    assert sorted(os.listdir(tmp_path)) == ["c.h5"]
    parts = h5.catalog(spark, path)
    assert [r.path for r in parts["nodes"].orderBy("path").collect()] == ["/", "/run", "/run/t"]
    assert parts["chunks"].count() == 20 and parts["attributes"].first()["value"] == '["v"]'


def test_h5_damage(tmp_path):
    path = str(tmp_path / "a.h5")
    h5.write_arrays(path, {"/g/x": np.arange(100)})
    whole = open(path, "rb").read()
    for cut in (0, 7, 40, 60, len(whole) // 2, len(whole) - 1):
        with open(path, "wb") as f:
            f.write(whole[:cut])
        with pytest.raises((FormatError, ValueError, FileNotFoundError, IndexError)):
            f = H5File(path)
            open_dataset(f, "/g/x")
            h5.row_block(f, open_dataset(f, "/g/x"), 0, 100)


def test_external_names_stay_in_their_folder(tmp_path):
    with pytest.raises(PermissionError):
        h5.external_path(str(tmp_path / "a.h5"), "../../etc/passwd")
