"""Conversions between formats, and copies that keep or change chunks and codecs."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import guess_chunks
from ..sources import h5, zarr
from ..sources.h5format import H5File, H5Type, open_dataset
from ..sources.stores import open_store
from . import catalog


def zarr_type(t: H5Type) -> tuple[str, object] | None:
    """The element type and fill value for a datatype; None if there is none."""
    if t.cls in ("int", "bits"):
        return f"{'int' if t.signed else 'uint'}{8 * t.size}", 0
    if t.cls == "float" and t.size in (2, 4, 8):
        return f"float{8 * t.size}", 0.0
    if t.cls == "enum":
        return ("bool", False) if t.is_bool() else ("string", "")
    if t.cls in ("string", "vstring", "reference"):
        return "string", ""
    if t.cls == "complex":
        return f"complex{8 * t.size}", 0j
    if t.cls == "opaque":
        return "bytes", ""
    return None


def h5_to_zarr(spark: SparkSession, source: str, target: str, *, chunk_bytes: int = 1 << 20) -> list[str]:
    """A file's groups, datasets and attributes as a hierarchy; what can't be told in it is left out and named."""
    f, warnings = H5File(source), []
    for path, kind, at in f.nodes():
        if kind == "group":
            attributes = {k: _plain(v) for k, v in f.attributes(at).items()}
            catalog.create_group(target, path, attributes)
        elif kind == "dataset":
            ds = open_dataset(f, path)
            a, kind_ = h5.read_dataset(spark, source, path), zarr_type(ds.type)
            if ds.type.cls == "array":
                base = zarr_type(ds.type.base)
                if base and len(ds.type.shape) == 1:
                    from ..operators.projection import array_dimension

                    a, kind_ = array_dimension(a, ds.type.shape[0], f"i{len(ds.shape)}"), base
            if kind_ is None:
                warnings.append(f"{path}: no element type for {ds.type.cls}")
                continue
            name, empty = kind_
            fill = a.fill if isinstance(a.fill, type(empty)) and not isinstance(a.fill, (list, dict)) else empty
            chunks = tuple(min(c, max(1, n)) for c, n in zip(ds.chunks, a.shape, strict=False)) if len(ds.chunks) == a.rank else guess_chunks(a.shape, max(1, ds.type.size), chunk_bytes)
            if name in ("string", "bytes"):
                a = a.with_value(F.coalesce(a.v, F.lit(empty if name == "string" else b"")))
            zarr.write_array(a, target, path, data_type=name, chunks=chunks, fill=fill, attributes={k: _plain(v) for k, v in f.attributes(at).items()})
        else:
            warnings.append(f"{path}: a {kind} link stays behind")
    return warnings


def _plain(value):
    """An attribute as JSON."""
    _, shape, values = value
    flat = json.loads(json.dumps(values.to_pylist(), default=str))
    if shape is None:
        return None
    if shape == ():
        return flat[0]
    for n in reversed(shape[1:]):
        flat = [flat[i : i + n] for i in range(0, len(flat), n)] if n else []
    return flat


def zarr_to_h5(spark: SparkSession, source: str, array: str, target: str, dataset: str, filters: tuple[str, ...] = ("shuffle", "deflate")) -> None:
    """A numeric array as a chunked dataset; absent chunks stay absent."""
    meta = zarr.open_array(open_store(source), array)
    if meta.kind.dtype is None or meta.kind.dtype.kind not in "iuf":
        raise ValueError(f"no dataset for elements of {meta.kind.name}")
    a = zarr.read_array(spark, source, array, fill="drop")
    chunks = tuple(c if isinstance(c, int) else max(c) for c in meta.chunks)
    attributes = {k: v for k, v in meta.attributes.items() if isinstance(v, (str, int, float))}
    h5.write_dataset(a, target, dataset, dtype=meta.kind.dtype.str, chunks=chunks, filters=filters, fill=np.asarray(meta.fill if meta.fill is not None else 0).item(), attributes=attributes)


def copy_keys(spark: SparkSession, source: str, target: str) -> int:
    """Every key as it is, byte for byte; tasks copy."""
    keys = open_store(source).keys()

    def run(part):
        a, b = open_store(source), open_store(target)
        n = 0
        for key in part:
            b.put(key, a.get(key))
            n += 1
        yield n

    return sum(spark.sparkContext.parallelize(keys, max(1, min(256, len(keys) // 64 + 1))).mapPartitions(run).collect()) if keys else 0


def copy_array(spark: SparkSession, source: str, array: str, target: str, to: str, *, chunks=None, shards=None, codecs_: list[dict] | None = None) -> None:
    """An array in other chunks, shards or codecs, as version 3."""
    meta = zarr.open_array(open_store(source), array)
    a = zarr.read_array(spark, source, array, fill="drop")
    name = meta.kind.name if meta.kind.dtype is None else meta.kind.dtype.name
    fill = meta.fill if meta.kind.dtype is None else np.asarray(meta.fill if meta.fill is not None else 0).item()
    same = tuple(c if isinstance(c, int) else max(c) for c in meta.chunks)
    zarr.write_array(a, target, to, data_type=name, chunks=chunks or same, shards=shards, codecs_=codecs_, fill=fill, attributes=meta.attributes, names=meta.names)
