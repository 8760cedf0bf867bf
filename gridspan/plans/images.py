"""Multi-resolution images: writing pyramids with their metadata, reading levels, plates and collections, coordinate lookups."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..array import ArrayFrame
from ..functions import transforms as tf
from ..operators import reduce
from ..sources import zarr
from ..sources.stores import open_store
from . import catalog

AXIS_KINDS = {"t": "time", "c": "channel", "z": "space", "y": "space", "x": "space"}


def write_pyramid(a: ArrayFrame, path: str, group: str = "", *, axes: str, factors: tuple[int, ...], method: str = "mean", kind: str = "float", data_type: str, chunks, pixel: tuple[float, ...] | None = None, units: dict[str, str] | None = None, smallest: int = 64, levels: int | None = None, name: str = "", shards=None, attributes: dict | None = None) -> list[tuple[int, ...]]:
    """Level arrays ``0``, ``1``, ... below a group, each reduced from the one before it as written, and their metadata.

    Reading a level back cuts the plan: every level is one scan, one aggregation and one write.
    """
    if len(axes) != a.rank:
        raise ValueError(f"{axes} are no axes for {a.rank} dimensions")
    spark, pixel = a.df.sparkSession, pixel or (1.0,) * a.rank
    catalog.create_group(path, group)
    shapes = reduce.pyramid_shapes(a.shape, factors, smallest, levels)
    datasets, now = [], a
    for level, shape in enumerate(shapes):
        at = f"{group.strip('/')}/{level}".strip("/")
        if level:
            options = {"kind": kind} if method == "mean" else {}
            now = reduce.REDUCTIONS[method](now, factors, **options)
            if kind == "float" and method == "mean":
                now = now.with_value(F.col(now.value).cast(zarr.casts.spark_type(data_type)))
        zarr.write_array(now, path, at, data_type=data_type, chunks=tuple(min(c, max(1, n)) for c, n in zip(chunks, shape, strict=True)), shards=shards, names=list(axes))
        now = zarr.read_array(spark, path, at)
        scale, shift = reduce.level_transform(pixel, factors, level, method)
        steps = [{"type": "scale", "scale": scale}] + ([{"type": "translation", "translation": shift}] if any(shift) else [])
        datasets.append({"path": str(level), "coordinateTransformations": steps})
    described = [{"name": x} | ({"type": AXIS_KINDS[x]} if x in AXIS_KINDS else {}) | ({"unit": units[x]} if units and x in units else {}) for x in axes]
    image = {"version": "0.5", "multiscales": [{"name": name or group.rpartition("/")[2], "axes": described, "datasets": datasets, "type": method}]}
    catalog.set_attributes(path, group, {**(attributes or {}), "ome": image}, merge=True)
    return shapes


def image_metadata(path: str, group: str = "") -> dict:
    """The image part of a group's attributes, of either place that versions keep it in."""
    doc = catalog.documents(open_store(path)).get(group.strip("/"))
    if doc is None:
        raise FileNotFoundError(f"no group at {group or '/'}")
    attributes = doc.get("attributes") or {}
    return attributes.get("ome", attributes)


def transform_of(spec: dict) -> tf.Transform:
    """A transform from its description."""
    kind = spec["type"]
    if kind == "identity":
        return tf.Identity()
    if kind == "scale":
        return tf.Scale(tuple(spec["scale"]))
    if kind == "translation":
        return tf.Translation(tuple(spec["translation"]))
    if kind == "affine":
        return tf.Affine(tuple(map(tuple, spec["affine"])))
    if kind == "rotation":
        return tf.rotation(spec["rotation"])
    if kind == "mapAxis":
        return tf.MapAxis(tuple(spec["mapAxis"]))
    if kind == "sequence":
        return tf.Sequence(tuple(map(transform_of, spec["transformations"])))
    if kind == "bijection":
        return tf.Bijection(transform_of(spec["forward"]), transform_of(spec["inverse"]))
    if kind == "byDimension":
        return tf.ByDimension(tuple((tuple(p["input_axes"]), tuple(p["output_axes"]), transform_of(p["transformation"] if "transformation" in p else p)) for p in spec["transformations"]))
    raise ValueError(f"no transform {kind!r}")


def level(spark: SparkSession, path: str, group: str = "", number: int = 0) -> tuple[ArrayFrame, tf.Sequence]:
    """A level's array and its transform to physical space: its own steps, then those of the whole image."""
    scales = image_metadata(path, group)["multiscales"][0]
    data = scales["datasets"][number]
    own = [transform_of(s) for s in data.get("coordinateTransformations", [])]
    whole = [transform_of(s) for s in scales.get("coordinateTransformations", [])]
    return zarr.read_array(spark, path, f"{group.strip('/')}/{data['path']}".strip("/")), tf.compose_levels(own, whole)


def all_levels(spark: SparkSession, path: str, group: str = "") -> DataFrame:
    """Every level in one relation with a ``level`` column; a filter on it prunes the other levels' scans."""
    out = None
    for number, _ in enumerate(image_metadata(path, group)["multiscales"][0]["datasets"]):
        part = level(spark, path, group, number)[0].df.select(F.lit(number).alias("level"), "*")
        out = part if out is None else out.union(part)
    return out


def labels(spark: SparkSession, path: str, group: str = "") -> DataFrame:
    """Label images of an image, with the path of the image that each belongs to."""
    store = open_store(path)
    base = f"{group.strip('/')}/labels".strip("/")
    doc = catalog.documents(store).get(base)
    names = ((doc or {}).get("attributes") or {}).get("ome", (doc or {}).get("attributes") or {}).get("labels", [])
    rows = []
    for n in names:
        spec = image_metadata(path, f"{base}/{n}").get("image-label", {})
        rows.append((n, spec.get("source", {}).get("image", "../../"), json.dumps(spec.get("colors", []))))
    return spark.createDataFrame(rows, "label string, source string, colors string")


def wells(spark: SparkSession, path: str, group: str = "") -> DataFrame:
    """Wells and images of a plate: ``row``, ``column``, ``well`` and ``image`` paths."""
    plate = image_metadata(path, group)["plate"]
    rows = []
    for w in plate["wells"]:
        at = f"{group.strip('/')}/{w['path']}".strip("/")
        for image in image_metadata(path, at).get("well", {}).get("images", []):
            rows.append((plate["rows"][w["rowIndex"]]["name"], plate["columns"][w["columnIndex"]]["name"], w["path"], f"{at}/{image['path']}", image.get("acquisition")))
    return spark.createDataFrame(rows, "row string, column string, well string, image string, acquisition bigint")
