"""Rules over image metadata. Each gives issues: severity, node, JSON pointer, message."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import open_store
from . import catalog

ISSUES = "severity string, node string, pointer string, message string"


def _issue(severity: str, pointer: str, message: str) -> tuple[str, str, str]:
    return severity, pointer, message


def axes_rules(axes, at: str):
    if not isinstance(axes, list) or not 2 <= len(axes) <= 5:
        yield _issue("ERROR", at, "an image has two to five axes")
        return
    names = [a.get("name") if isinstance(a, dict) else None for a in axes]
    if None in names or len(set(names)) != len(names):
        yield _issue("ERROR", at, "every axis needs a name of its own")
    kinds = [a.get("type") for a in axes if isinstance(a, dict)]
    if kinds.count("space") not in (2, 3):
        yield _issue("ERROR", at, "an image has two or three axes of space")
    if kinds.count("time") > 1 or kinds.count("channel") > 1:
        yield _issue("ERROR", at, "there is one axis of time and one of channels at most")
    order = [{"time": 0, "channel": 1, None: 1, "space": 2}.get(k, 1) for k in kinds]
    if order != sorted(order):
        yield _issue("ERROR", at, "axes come in the order time, channel, space")
    for k, a in enumerate(axes):
        if isinstance(a, dict) and a.get("type") in ("space", "time") and "unit" not in a:
            yield _issue("WARNING", f"{at}/{k}", "the axis has no unit")


def transform_rules(steps, rank: int, at: str):
    if not isinstance(steps, list) or not steps:
        yield _issue("ERROR", at, "transforms are missing")
        return
    kinds = [s.get("type") for s in steps if isinstance(s, dict)]
    if kinds.count("scale") != 1 or kinds[:1] != ["scale"]:
        yield _issue("ERROR", at, "one scale comes first")
    if kinds.count("translation") > 1:
        yield _issue("ERROR", at, "there is one translation at most")
    for k, s in enumerate(steps):
        kind = s.get("type") if isinstance(s, dict) else None
        if kind not in ("identity", "scale", "translation", "affine", "rotation", "mapAxis", "sequence", "byDimension", "bijection", "displacements", "coordinates"):
            yield _issue("ERROR", f"{at}/{k}", f"no transform {kind!r}")
        elif kind in ("scale", "translation") and "path" not in s:
            values = s.get(kind)
            if not isinstance(values, list) or len(values) != rank or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
                yield _issue("ERROR", f"{at}/{k}", f"a {kind} needs {rank} numbers")
            elif kind == "scale" and any(v <= 0 for v in values):
                yield _issue("WARNING", f"{at}/{k}", "a scale that isn't positive")
        elif kind == "rotation":
            m = np.array(s.get("rotation", []), float)
            if m.ndim != 2 or m.shape != (rank, rank) or not np.allclose(m @ m.T, np.eye(rank), atol=1e-6):
                yield _issue("ERROR", f"{at}/{k}", "a rotation needs an orthogonal matrix")


def multiscale_rules(image: dict):
    for k, m in enumerate(image.get("multiscales", [])):
        at = f"/multiscales/{k}"
        if not isinstance(m, dict):
            yield _issue("ERROR", at, "a multiscale is an object")
            continue
        yield from axes_rules(m.get("axes"), f"{at}/axes")
        data = m.get("datasets")
        if not isinstance(data, list) or not data:
            yield _issue("ERROR", f"{at}/datasets", "there are no levels")
            continue
        rank = len(m.get("axes") or [])
        paths = [d.get("path") for d in data if isinstance(d, dict)]
        if len(set(paths)) != len(data) or None in paths:
            yield _issue("ERROR", f"{at}/datasets", "every level needs a path of its own")
        for i, d in enumerate(data):
            yield from transform_rules(d.get("coordinateTransformations") if isinstance(d, dict) else None, rank, f"{at}/datasets/{i}/coordinateTransformations")
        if "name" not in m:
            yield _issue("WARNING", at, "the multiscale has no name")


def omero_rules(image: dict):
    for k, c in enumerate((image.get("omero") or {}).get("channels", [])):
        at = f"/omero/channels/{k}"
        color = c.get("color")
        if not isinstance(color, str) or len(color) != 6 or any(x not in "0123456789abcdefABCDEF" for x in color):
            yield _issue("ERROR", f"{at}/color", "a color has six hexadecimal digits")
        window = c.get("window")
        if not isinstance(window, dict) or not {"min", "max", "start", "end"} <= window.keys():
            yield _issue("ERROR", f"{at}/window", "a window has min, max, start and end")


def label_rules(image: dict):
    spec = image.get("image-label")
    if spec is not None:
        values = [c.get("label-value") for c in spec.get("colors", [])]
        if len(set(values)) != len(values):
            yield _issue("ERROR", "/image-label/colors", "a label value has two colors")
        for k, c in enumerate(spec.get("colors", [])):
            rgba = c.get("rgba")
            if rgba is not None and (len(rgba) != 4 or any(not 0 <= v <= 255 for v in rgba)):
                yield _issue("ERROR", f"/image-label/colors/{k}/rgba", "a color has four values from 0 to 255")


def plate_rules(image: dict):
    plate = image.get("plate")
    if plate is not None:
        for part in ("rows", "columns"):
            names = [x.get("name") for x in plate.get(part, [])]
            if not names or len(set(names)) != len(names) or not all(isinstance(n, str) and n.isalnum() for n in names):
                yield _issue("ERROR", f"/plate/{part}", f"{part} need alphanumeric names of their own")
        for k, w in enumerate(plate.get("wells", [])):
            r, c = w.get("rowIndex", -1), w.get("columnIndex", -1)
            if not 0 <= r < len(plate.get("rows", [])) or not 0 <= c < len(plate.get("columns", [])):
                yield _issue("ERROR", f"/plate/wells/{k}", "a well lies outside of the plate")
            elif w.get("path") != f"{plate['rows'][r]['name']}/{plate['columns'][c]['name']}":
                yield _issue("ERROR", f"/plate/wells/{k}/path", "a well's path is its row and column")
    well = image.get("well")
    if well is not None and not well.get("images"):
        yield _issue("ERROR", "/well/images", "a well has no images")


def scene_rules(image: dict):
    systems = {s.get("name") for s in image.get("coordinateSystems", []) if isinstance(s, dict)}
    edges = [t for t in (image.get("scene") or image).get("coordinateTransformations", []) if isinstance(t, dict) and "input" in t]
    near: dict = {}
    for k, t in enumerate(edges):
        for end in ("input", "output"):
            if systems and t.get(end) not in systems and "/" not in str(t.get(end)):
                yield _issue("WARNING", f"/coordinateTransformations/{k}/{end}", f"no coordinate system {t.get(end)!r}")
        near.setdefault(t.get("input"), set()).add(t.get("output"))
        near.setdefault(t.get("output"), set()).add(t.get("input"))
    if near:
        seen, front = set(), [next(iter(near))]
        while front:
            x = front.pop()
            if x not in seen:
                seen.add(x)
                front += near[x]
        if seen != set(near):
            yield _issue("ERROR", "/coordinateTransformations", "the coordinate systems aren't connected")


RULES = (multiscale_rules, omero_rules, label_rules, plate_rules, scene_rules)


def issues_of(attributes: dict) -> list[tuple[str, str, str]]:
    image = attributes.get("ome", attributes)
    return [i for rule in RULES for i in rule(image)]


def validate(spark: SparkSession, path: str, metadata_only: bool = False) -> DataFrame:
    """Issues of all groups of a hierarchy: rules run as tasks over the catalog, hierarchy checks are joins on it."""
    nodes = catalog.nodes(spark, path)

    def run(batches):
        for batch in batches:
            rows = [(s, n, p, m) for n, a in zip(batch["path"], batch["attributes"], strict=True) for s, p, m in issues_of(json.loads(a))]
            yield pd.DataFrame(rows, columns=["severity", "node", "pointer", "message"])

    out = nodes.filter("kind = 'group'").select("path", "attributes").mapInPandas(run, ISSUES)
    if metadata_only:
        return out
    wanted = []
    for name, doc in catalog.documents(open_store(path)).items():
        image = (doc.get("attributes") or {}).get("ome", doc.get("attributes") or {})
        for m in image.get("multiscales", []) if isinstance(image, dict) else []:
            for k, d in enumerate(m.get("datasets", [])):
                wanted.append((f"/{name}".rstrip("/") or "/", k, f"/{name}/{d.get('path')}".replace("//", "/"), len(m.get("axes", []))))
    levels = spark.createDataFrame(wanted, "node string, k int, path string, axes int").join(nodes.filter("kind = 'array'").select("path", "shape", "type"), "path", "left")
    absent = levels.filter("shape is null").select(F.lit("ERROR"), "node", F.concat(F.lit("/multiscales/0/datasets/"), "k"), F.lit("the level's array isn't there"))
    rank = levels.filter("size(shape) <> axes").select(F.lit("ERROR"), "node", F.concat(F.lit("/multiscales/0/datasets/"), "k"), F.lit("the level's array has another number of dimensions"))
    mixed = levels.filter("shape is not null").groupBy("node").agg(F.count_distinct("type").alias("n")).filter("n > 1").select(F.lit("ERROR"), "node", F.lit("/multiscales/0/datasets"), F.lit("the levels have different types"))
    return out.union(absent).union(rank).union(mixed)


def tally(issues: DataFrame, strict: bool = False) -> dict[str, int | bool]:
    """Errors and warnings; a hierarchy is valid without errors, in strict mode also without warnings."""
    row = issues.agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings")).first()
    return {"errors": row["errors"], "warnings": row["warnings"], "valid": not row["errors"] and not (strict and row["warnings"])}
