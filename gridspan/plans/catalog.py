"""Catalogs of Zarr hierarchies: nodes as relations, groups, attributes, consolidation, resizing and deletion.

These are metadata operations. They run on the driver, or as rows where there may be many.
"""

from __future__ import annotations

import json
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from ..sources import zarr
from ..sources.stores import Store, open_store

META = ("zarr.json", ".zarray", ".zgroup", ".zattrs")


def _at(path: str) -> str:
    return f"{path.strip('/')}/" if path.strip("/") else ""


def documents(store: Store) -> dict[str, dict]:
    """Metadata by node path, as version 3 has it, in consolidated order; from one snapshot if the store has one."""
    found: dict[str, dict] = {}
    root = json.loads(store.get("zarr.json") or b"null")
    if root and root.get("consolidated_metadata"):
        found = {"": {k: v for k, v in root.items() if k != "consolidated_metadata"}, **root["consolidated_metadata"]["metadata"]}
    elif (raw := store.get(".zmetadata")) is not None:
        parts = json.loads(raw)["metadata"]
        for key, doc in parts.items():
            path, _, name = key.rpartition("/")
            if name in (".zarray", ".zgroup"):
                found[path] = _old(doc, parts.get(f"{path}/.zattrs" if path else ".zattrs", {}), name == ".zarray")
    else:
        for key in store.keys():
            path, _, name = key.rpartition("/")
            if name == "zarr.json":
                found[path] = json.loads(store.get(key))
            elif name in (".zarray", ".zgroup"):
                found.setdefault(path, _old(json.loads(store.get(key)), json.loads(store.get(f"{_at(path)}.zattrs") or b"{}"), name == ".zarray"))
    return dict(sorted(found.items(), key=lambda x: consolidated_key(x[0])))


def _old(doc: dict, attributes: dict, array: bool) -> dict:
    return {"zarr_format": 2, "node_type": "array" if array else "group", "attributes": attributes, **({"old": doc, "shape": doc["shape"]} if array else {})}


def consolidated_key(path: str) -> tuple:
    """Depth, then case-folded, then by code points."""
    return (len([p for p in path.split("/") if p]), path.lower(), path)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``kind``, ``format``, ``shape``, ``type``, ``chunks`` and ``attributes`` (JSON) of every node."""
    out = []
    for name, doc in documents(open_store(path)).items():
        array = doc["node_type"] == "array"
        meta = None
        if array:
            meta = zarr.parse_v2(doc["old"], doc["attributes"]) if doc["zarr_format"] == 2 else zarr.parse_v3(doc)
        out.append((f"/{name}", doc["node_type"], doc["zarr_format"], list(meta.shape) if meta else None, meta.kind.dtype.str if meta and meta.kind.dtype is not None else meta.kind.name if meta else None, json.dumps(meta.chunks) if meta else None, json.dumps(doc.get("attributes") or {})))
    return spark.createDataFrame(out, "path string, kind string, format int, shape array<bigint>, type string, chunks string, attributes string")


def chunks(spark: SparkSession, path: str, array: str = "") -> DataFrame:
    """``key``, the cell and the stored ``bytes`` of an array's chunks. Cells are dealt out, sizes are asked for by tasks."""
    meta = zarr.open_array(open_store(path), array)
    base = _at(array)
    cells = spark.sparkContext.parallelize([list(c) for c in meta.cells()], max(1, min(64, sum(1 for _ in meta.cells()) // 256 + 1)))

    def sizes(part):
        store = open_store(path)
        for cell in part:
            n = store.size(f"{base}{meta.key(tuple(cell))}")
            if n is not None:
                yield (f"{base}{meta.key(tuple(cell))}", cell, n)

    return spark.createDataFrame(cells.mapPartitions(sizes), "key string, cell array<bigint>, bytes bigint")


def create_group(path: str, group: str = "", attributes: dict | None = None, overwrite: bool = False) -> None:
    """A group and the groups above it."""
    store = open_store(path)
    if overwrite:
        delete_node(path, group)
    parts = [p for p in group.split("/") if p]
    for k in range(len(parts) + 1):
        key = f"{_at('/'.join(parts[:k]))}zarr.json"
        if store.get(key) is None:
            store.put(key, json.dumps({"zarr_format": 3, "node_type": "group", "attributes": (attributes or {}) if k == len(parts) else {}}).encode())


def delete_node(path: str, node: str) -> None:
    """A node with all that is below it."""
    store = open_store(path)
    for key in store.keys(_at(node)):
        store.delete(key)


def set_attributes(path: str, node: str, attributes: dict, merge: bool = False) -> dict:
    """A node's attributes, replaced, or merged with the given ones winning."""
    store = open_store(path)
    key = f"{_at(node)}zarr.json"
    raw = store.get(key)
    if raw is not None:
        doc = json.loads(raw)
        doc["attributes"] = ({**(doc.get("attributes") or {}), **attributes}) if merge else attributes
        store.put(key, json.dumps(doc).encode())
        return doc["attributes"]
    if store.get(f"{_at(node)}.zarray") is None and store.get(f"{_at(node)}.zgroup") is None:
        raise FileNotFoundError(f"no node at {node or '/'}")
    key = f"{_at(node)}.zattrs"
    made = {**json.loads(store.get(key) or b"{}"), **attributes} if merge else attributes
    store.put(key, json.dumps(made).encode())
    return made


def consolidate(path: str) -> int:
    """A snapshot of all descendants' metadata in the root group; the number of nodes in it."""
    store = open_store(path)
    root = json.loads(store.get("zarr.json") or b"null")
    if root is not None:
        root.pop("consolidated_metadata", None)
        store.put("zarr.json", json.dumps(root).encode())
        found = {p: d for p, d in documents(store).items() if p}
        root["consolidated_metadata"] = {"kind": "inline", "must_understand": False, "metadata": found}
        store.put("zarr.json", json.dumps(root).encode())
        return len(found)
    metadata = {k: json.loads(store.get(k)) for k in store.keys() if k.rpartition("/")[2] in META[1:]}
    if not metadata:
        raise FileNotFoundError(f"no hierarchy at {path}")
    store.put(".zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": metadata}).encode())
    return len(metadata)


def resize(path: str, array: str, shape: tuple[int, ...]) -> None:
    """A new shape: chunks wholly outside go, cells of edge chunks that a later growth would show again become fill.

    Growing writes metadata alone.
    """
    store = open_store(path)
    meta = zarr.open_array(store, array)
    if meta.version != 3 or len(shape) != len(meta.shape):
        raise ValueError("resizing needs a version 3 array and a shape of its rank")
    base = _at(array)
    shrinks = any(n < old for n, old in zip(shape, meta.shape, strict=True))
    for cell in list(meta.cells()) if shrinks else ():
        origin = meta.origin(cell)
        size = tuple(meta.chunk_size(k, c) for k, c in enumerate(cell))
        key = f"{base}{meta.key(cell)}"
        if any(o >= n for o, n in zip(origin, shape, strict=True)):
            store.delete(key)
        elif any(n < o + s and n < old for o, s, n, old in zip(origin, size, shape, meta.shape, strict=True)):
            x = zarr.read_chunk(store, base, meta, cell)
            if x is not None:
                keep = tuple(slice(0, max(0, min(s, n - o))) for o, s, n in zip(origin, size, shape, strict=True))
                clean = zarr.full(size, meta.kind, meta.fill)
                clean[keep] = x[keep]
                store.put(key, zarr.encode(meta.pipeline, clean, meta.kind, meta.fill))
    doc = {**meta.document, "shape": list(shape)}
    store.put(f"{base}zarr.json", json.dumps(doc).encode())


def ls(path: str, recursive: bool = False) -> list[str]:
    """One line a node."""
    out = []
    for name, doc in documents(open_store(path)).items():
        if name and (recursive or "/" not in name):
            detail = f" {tuple(doc['shape'])}" if doc["node_type"] == "array" else ""
            out.append(f"{doc['node_type']:5} /{name}{detail}")
    return out


def cells_of(meta: zarr.ArrayMeta):
    return product(*[range(len(meta.starts(k))) for k in range(len(meta.shape))])
