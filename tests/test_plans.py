"""Catalogs, images, validation, conversion, growing arrays."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.__main__ import run
from gridspan.array import ArrayFrame
from gridspan.plans import catalog, convert, images, validate
from gridspan.sources import h5, stores, zarr
from gridspan.streaming import append

X = np.arange(40 * 24).reshape(40, 24)


@pytest.fixture(scope="module")
def a(spark):
    df = spark.range(960).select(F.expr("id div 24").alias("i0"), F.expr("id % 24").alias("i1"), F.col("id").cast("int").alias("v"))
    return ArrayFrame(df, ("i0", "i1"), (40, 24))


def dense(a, fill=-1):
    out = np.full(a.shape, fill)
    p = a.df.toPandas()
    out[tuple(p[d] for d in a.dims)] = p["v"]
    return out


def test_pyramid_and_validation(spark, a, tmp_path):
    path = str(tmp_path)
    shapes = images.write_pyramid(a, path, "img", axes="yx", factors=(2, 2), method="mean", kind="int", data_type="int32", chunks=(16, 16), pixel=(0.5, 0.5), levels=3, name="i", units={"y": "micrometer", "x": "micrometer"})
    assert shapes == [(40, 24), (20, 12), (10, 6)]
    two, t = images.level(spark, path, "img", 1)
    s = X.reshape(20, 2, 12, 2).sum(axis=(1, 3))
    assert (dense(two) == (2 * s + 4) // 8).all()
    point = spark.createDataFrame([(3.0, 4.0)], "y double, x double")
    from gridspan.functions.transforms import transform_points

    assert tuple(transform_points(point, ["y", "x"], t).first()) == (3.25, 4.25)
    assert images.all_levels(spark, path, "img").groupBy("level").count().count() == 3
    assert validate.tally(validate.validate(spark, path), strict=True) == {"errors": 0, "warnings": 0, "valid": True}
    stores.open_store(path).delete("img/1")
    doc = json.loads(stores.open_store(path).get("img/zarr.json"))
    doc["attributes"]["ome"]["multiscales"][0]["axes"].reverse()
    doc["attributes"]["ome"]["multiscales"][0]["datasets"][0]["coordinateTransformations"][0]["scale"] = [1]
    doc["attributes"]["ome"]["omero"] = {"channels": [{"color": "red"}]}
    stores.open_store(path).put("img/zarr.json", json.dumps(doc).encode())
    found = {(r.severity, r.pointer) for r in validate.validate(spark, path).collect()}
    assert ("ERROR", "/multiscales/0/datasets/1") in found and ("ERROR", "/omero/channels/0/color") in found
    assert ("ERROR", "/multiscales/0/datasets/0/coordinateTransformations/0") in found
    assert not validate.tally(validate.validate(spark, path))["valid"]


def test_rules():
    good = [{"name": "y", "type": "space", "unit": "m"}, {"name": "x", "type": "space", "unit": "m"}]
    assert list(validate.axes_rules(good, "")) == []
    assert [i[0] for i in validate.axes_rules([*good, {"name": "t", "type": "time", "unit": "s"}], "")] == ["ERROR"]
    plate = {"plate": {"rows": [{"name": "A"}], "columns": [{"name": "1"}], "wells": [{"path": "A/2", "rowIndex": 0, "columnIndex": 0}, {"path": "B/1", "rowIndex": 1, "columnIndex": 0}]}}
    assert len(list(validate.plate_rules(plate))) == 2
    apart = {"coordinateTransformations": [{"input": "a", "output": "b"}, {"input": "c", "output": "d"}]}
    assert [i[0] for i in validate.scene_rules(apart)] == ["ERROR"]
    assert len(list(validate.label_rules({"image-label": {"colors": [{"label-value": 1}, {"label-value": 1, "rgba": [1, 2, 3]}]}}))) == 2


def test_plate(spark, tmp_path):
    path = str(tmp_path)
    catalog.create_group(path, "A/1", {"ome": {"well": {"images": [{"path": "0"}, {"path": "1", "acquisition": 2}]}}})
    catalog.set_attributes(path, "", {"ome": {"plate": {"rows": [{"name": "A"}], "columns": [{"name": "1"}], "wells": [{"path": "A/1", "rowIndex": 0, "columnIndex": 0}]}}})
    assert [tuple(r) for r in images.wells(spark, path).orderBy("image").collect()] == [("A", "1", "A/1", "A/1/0", None), ("A", "1", "A/1", "A/1/1", 2)]


def test_catalog(spark, a, tmp_path, capsys):
    path = str(tmp_path)
    catalog.create_group(path, "g/Sub", {"k": 1})
    zarr.write_array(a, path, "g/x", data_type="int32", chunks=(16, 16))
    assert [r.path for r in catalog.nodes(spark, path).collect()] == ["/", "/g", "/g/Sub", "/g/x"]
    assert catalog.consolidate(path) == 3
    assert [r.path for r in catalog.nodes(spark, path).collect()] == ["/", "/g", "/g/Sub", "/g/x"]
    assert catalog.set_attributes(path, "g/Sub", {"z": 2}, merge=True) == {"k": 1, "z": 2}
    assert catalog.chunks(spark, path, "g/x").count() == 6
    assert run(["ls", "-r", path]) == 0 and "g/x" in capsys.readouterr().out
    catalog.delete_node(path, "g/x")
    with pytest.raises(FileNotFoundError):
        zarr.open_array(stores.open_store(path), "g/x")


def test_resize(spark, a, tmp_path):
    path = str(tmp_path)
    zarr.write_array(a, path, "x", data_type="int32", chunks=(16, 16), fill=9)
    catalog.resize(path, "x", (20, 10))
    assert (dense(zarr.read_array(spark, path, "x")) == X[:20, :10]).all()
    catalog.resize(path, "x", (40, 24))
    back = dense(zarr.read_array(spark, path, "x"))
    assert (back[:20, :10] == X[:20, :10]).all() and (back[20:] == 9).all() and (back[:, 10:] == 9).all()


def test_conversion(spark, a, tmp_path):
    source, target, again = str(tmp_path / "a.h5"), str(tmp_path / "z"), str(tmp_path / "b.h5")
    h5.write_dataset(a, source, "/run/t", dtype="<i4", chunks=(16, 16), attributes={"units": "K"})
    assert convert.h5_to_zarr(spark, source, target) == []
    assert (dense(zarr.read_array(spark, target, "run/t")) == X).all()
    assert zarr.open_array(stores.open_store(target), "run/t").attributes == {"units": "K"}
    convert.zarr_to_h5(spark, target, "run/t", again, "/back")
    assert (dense(h5.read_dataset(spark, again, "/back")) == X).all()
    assert convert.copy_keys(spark, target, str(tmp_path / "copy")) == len(stores.open_store(target).keys())
    convert.copy_array(spark, target, "run/t", str(tmp_path / "copy"), "y", chunks=(5, 6), shards=(20, 12))
    assert (dense(zarr.read_array(spark, str(tmp_path / "copy"), "y")) == X).all()


def test_append_is_repeatable(spark, tmp_path):
    path = str(tmp_path)
    rows = lambda n, first: ArrayFrame(spark.range(n).select(F.col("id").alias("i0"), (F.col("id") + first).cast("int").alias("v")), ("i0",), (n,))
    zarr.write_array(rows(5, 0), path, "x", data_type="int32", chunks=(4,))
    assert append.append_rows(rows(7, 5), path, "x", 0) == 12
    assert append.append_rows(rows(7, 5), path, "x", 0) == 12
    assert append.append_rows(rows(3, 12), path, "x", 1) == 15
    assert dense(zarr.read_array(spark, path, "x")).tolist() == list(range(15))


def test_streams(spark, tmp_path):
    path = str(tmp_path / "s")
    empty = ArrayFrame(spark.range(0).select(F.col("id").alias("i0"), F.col("id").cast("int").alias("v")), ("i0",), (0,))
    zarr.write_array(empty, path, "x", data_type="int32", chunks=(4,))
    for k in range(2):
        spark.range(k * 6, k * 6 + 6).select(F.col("id").alias("i0"), F.col("id").cast("int").alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i0 bigint, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append.append_stream(stream, path, "x", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(dense(zarr.read_array(spark, path, "x")).tolist()) == list(range(12))
    out = append.read_growing(spark, path, "x").writeStream.format("memory").queryName("grown").trigger(availableNow=True)
    out.start().awaitTermination()
    assert spark.table("grown").count() == 12


def test_virtual(spark, tmp_path):
    from gridspan.sources.h5format import H5Dataset, H5File, open_dataset

    for k in range(2):
        h5.write_arrays(str(tmp_path / f"s{k}.h5"), {"/data": np.arange(4, dtype="i4") + 10 * k})
    f = H5File(str(tmp_path / "s0.h5"))
    t = open_dataset(f, "/data").type
    one = lambda k: ("slab", (k, 0), (1, 1), (1, 1), (1, 4))
    rows = [("s0.h5", "data", ("all",), one(0)), ("gone.h5", "data", ("all",), one(1)), ("s1.h5", "data", ("all",), one(2))]
    ds = H5Dataset(f.path, "/v", t, (3, 4), (3, 4), "virtual", 0, (), [], (-1).to_bytes(4, "little", signed=True), mappings=rows)
    assert dense(h5.read_virtual(spark, f, ds)).tolist() == [[0, 1, 2, 3], [-1] * 4, [10, 11, 12, 13]]
    series = [("s%b.h5", "data", ("all",), ("slab", (0, 0), (1, 4), (None, 1), (1, 4)))]
    ds = H5Dataset(f.path, "/v", t, (2, 4), (None, 4), "virtual", 0, (), [], b"\0" * 4, mappings=series)
    assert dense(h5.read_virtual(spark, f, ds)).tolist() == [[0, 1, 2, 3], [10, 11, 12, 13]]


def test_commands(spark, a, tmp_path, capsys):
    path = str(tmp_path)
    zarr.write_array(a, path, "x", data_type="int32", chunks=(16, 16))
    assert run(["dump", path, "x", "--slice", "1:3,::8", "--form", "csv"]) == 0
    assert capsys.readouterr().out.split() == ["24,32,40", "48,56,64"]
    assert run(["info", path]) == 0 and "/x" in capsys.readouterr().out
