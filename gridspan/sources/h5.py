"""The ``h5array`` data source: HDF5 datasets as DataFrames, and writing them.

The driver walks metadata and the chunk index; tasks read and decode chunks, or row ranges of contiguous data.
"""

from __future__ import annotations

import json
import os
import struct
from dataclasses import dataclass, replace
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..array import ArrayFrame
from ..functions import codecs
from ..functions.checksums import lookup3
from ..operators import assemble
from ..operators.selection import Axis
from .box import BoxReader, grouped
from .h5format import FormatError, H5Dataset, H5File, open_dataset, unfiltered
from .zarr import PARTITION_BYTES


def external_path(file: str, name: str, folders: tuple[str, ...] = ()) -> str:
    """Where another file named in metadata may lie: beside the file, or in a folder that the caller allows."""
    base = os.path.dirname(os.path.abspath(file))
    for folder in (base, *map(os.path.abspath, folders)):
        path = os.path.realpath(os.path.join(folder, name))
        if os.path.commonpath([path, os.path.realpath(folder)]) == os.path.realpath(folder):
            return path
    raise PermissionError(f"{name} lies outside of the allowed folders")


def chunk_block(f: H5File, ds: H5Dataset, cell: tuple[int, ...]) -> tuple[tuple[int, ...], np.ndarray]:
    """A chunk's shape and its elements as rows of bytes; an absent chunk holds the fill value."""
    raw = prod(ds.chunks) * ds.type.size
    entry = ds.index.get(cell)
    if entry is None:
        return ds.chunks, np.broadcast_to(np.frombuffer(ds.fill, np.uint8), (prod(ds.chunks), ds.type.size))
    data = f.read(entry[0], entry[1])
    data = unfiltered(data, ds.filters, entry[2], ds.type, raw)
    if len(data) < raw:
        raise FormatError(f"a chunk of {len(data)} bytes instead of {raw}")
    return ds.chunks, np.frombuffer(data[:raw], np.uint8).reshape(prod(ds.chunks), ds.type.size)


def row_block(f: H5File, ds: H5Dataset, low: int, high: int) -> np.ndarray:
    """Rows ``low`` to ``high`` of the first dimension of unchunked data."""
    per = prod(ds.shape[1:]) * ds.type.size if ds.shape else ds.type.size
    start, n = low * per, (high - low) * per
    if ds.layout == "compact":
        data = ds.inline[start : start + n]
    elif ds.layout == "external":
        parts, at = [], 0
        for name, offset, size in ds.external:
            a, b = max(start, at), min(start + n, at + size)
            if a < b:
                with open(external_path(f.path, name), "rb") as g:
                    g.seek(offset + a - at)
                    parts.append(g.read(b - a).ljust(b - a, b"\0"))
            at += size
        data = b"".join(parts)
    elif ds.address == f.none:
        data = b""
    else:
        data = f.read(ds.address + start, n)
    have = len(data) // ds.type.size
    out = np.frombuffer(data[: have * ds.type.size], np.uint8).reshape(have, ds.type.size)
    want = n // ds.type.size
    if have < want:
        out = np.concatenate([out, np.broadcast_to(np.frombuffer(ds.fill, np.uint8), (want - have, ds.type.size))])
    return out


def box_batch(f: H5File, ds: H5Dataset, block: np.ndarray, shape, origin, low, high) -> pa.RecordBatch | None:
    """The part of a block inside the array and the box, in element form."""
    cut, starts = [], []
    for o, n, s, a, b in zip(origin, shape, ds.shape, low, high, strict=True):
        begin, stop = max(0, a - o), min(n, s - o, b - o)
        if begin >= stop:
            return None
        cut.append(slice(begin, stop))
        starts.append(o + begin)
    part = block.reshape(*shape, ds.type.size)[tuple(cut)]
    sizes = part.shape[:-1]
    columns = []
    for k, (s, n) in enumerate(zip(starts, sizes, strict=True)):
        columns.append(pa.array(np.tile(np.repeat(np.arange(s, s + n, dtype=np.int64), prod(sizes[k + 1 :])), prod(sizes[:k]))))
    rows = np.ascontiguousarray(part).reshape(prod(sizes), ds.type.size)
    return pa.RecordBatch.from_arrays([*columns, f.values(rows, ds.type)], names=[*ds.dims, "v"])


class H5Reader(BoxReader):
    def __init__(self, path: str, dataset: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes
        self.ds = open_dataset(H5File(path), dataset)
        if self.ds.layout == "virtual":
            raise ValueError(f"{dataset} is virtual: read it with read_virtual")
        self.bound(self.ds.dims, self.ds.shape)

    def partitions(self):
        ds = self.ds
        if ds.layout == "chunked":
            ranges = [range(a // c, -(-b // c)) if b > a else range(0) for a, b, c in zip(self.low, self.high, ds.chunks, strict=True)]
            each = self.partition_bytes // max(1, prod(ds.chunks) * ds.type.size)
            cells = [(c, ds.index.get(c)) for c in product(*ranges)]
        else:
            per = max(1, prod(ds.shape[1:]) * ds.type.size) if ds.shape else 1
            step = max(1, self.partition_bytes // per)
            a, b = (self.low[0], self.high[0]) if ds.shape else (0, 1)
            cells, each = [((r, min(b, r + step)), None) for r in range(a, b, step)], 1
        self.ds = replace(ds, index={})  # each task gets the entries of its own chunks
        return grouped(cells, each)

    def read(self, partition):
        f, ds = H5File(self.path), self.ds
        for cell, entry in partition.cells:
            if ds.layout == "chunked":
                ds.index = {cell: entry} if entry else {}
                shape, block = chunk_block(f, ds, cell)
                origin = tuple(c * n for c, n in zip(cell, ds.chunks, strict=True))
            else:
                block = row_block(f, ds, *cell)
                shape = (cell[1] - cell[0], *ds.shape[1:]) if ds.shape else ()
                origin = (cell[0], *[0] * (len(ds.shape) - 1)) if ds.shape else ()
            batch = box_batch(f, ds, block, shape, origin, self.low, self.high)
            if batch is not None:
                yield batch


class H5Source(DataSource):
    """``spark.read.format("h5array").option("path", ...).option("dataset", "/a/b")``; also a sink, see ``write_dataset``."""

    @classmethod
    def name(cls):
        return "h5array"

    def schema(self):
        ds = open_dataset(H5File(self.options["path"]), self.options["dataset"])
        return T.StructType([*[T.StructField(d, T.LongType()) for d in ds.dims], T.StructField("v", ds.type.spark())])

    def reader(self, schema):
        return H5Reader(self.options["path"], self.options["dataset"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite):
        return H5Writer(self.options["path"], json.loads(self.options["layout"]))


def register(spark) -> None:
    spark.dataSource.register(H5Source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_dataset(spark, path: str, dataset: str, **options) -> ArrayFrame:
    """A dataset in element form; a virtual one is assembled from its sources."""
    register(spark)
    f = H5File(path)
    ds = open_dataset(f, dataset)
    if ds.layout == "virtual":
        return read_virtual(spark, f, ds, **options)
    reader = spark.read.format("h5array").option("path", path).option("dataset", dataset)
    for k, v in options.items():
        reader = reader.option(k, v)
    fill = f.values(np.frombuffer(ds.fill, np.uint8).reshape(1, -1), ds.type)[0].as_py() if ds.type.cls not in ("vlen", "vstring", "reference") else None
    return ArrayFrame(reader.load(), ds.dims, ds.shape, "v", fill)


def _axes(selection, shape) -> list[list[Axis]]:
    if selection[0] == "all":
        return [[Axis(0, 1, n, n) if n else Axis(0, 0) for n in shape]]
    if selection[0] == "slab":
        _, start, stride, count, block = selection
        whole = [c if c is not None else max(0, (n - s - b) // t + 1) for s, t, c, b, n in zip(start, stride, count, block, shape, strict=True)]
        return [[Axis(s, c, t, b) for s, t, c, b in zip(start, stride, whole, block, strict=True)]]
    if selection[0] == "blocks":
        return [[Axis(a, 1, b - a, b - a) for a, b in zip(low, high, strict=True)] for low, high in selection[1]]
    return []


def read_virtual(spark, f: H5File, ds: H5Dataset, folders: tuple[str, ...] = (), **options) -> ArrayFrame:
    """A virtual dataset: each mapping's elements move by arithmetic on their ordinals, a later mapping wins, what no
    source has is fill. A source that isn't there counts as missing; a name with ``%b`` is a numbered series."""
    parts: list[ArrayFrame] = []
    for file, name, source, target in ds.mappings:
        for path, number in _sources(f, file, name, folders):
            try:
                a = read_dataset(spark, path[0], path[1], **options)
            except FileNotFoundError:
                continue
            places = _axes(target if number is None else _numbered(target, number), ds.shape)
            taken = _axes(source, a.shape)
            for from_axes, to_axes in zip(taken, places, strict=False):
                parts.append(assemble.map_positions(a, from_axes, to_axes, ds.dims, ds.shape))
    fill = f.values(np.frombuffer(ds.fill, np.uint8).reshape(1, -1), ds.type)[0].as_py()
    if not parts:
        empty = spark.createDataFrame([], T.StructType([*[T.StructField(d, T.LongType()) for d in ds.dims], T.StructField("v", ds.type.spark())]))
        return assemble.filled(ArrayFrame(empty, ds.dims, ds.shape), fill)
    return assemble.filled(assemble.stacked(parts), fill)


def _sources(f: H5File, file: str, name: str, folders):
    place = lambda n: f.path if n == "." else external_path(f.path, n, folders)
    if "%b" in file.replace("%%", "") or "%b" in name.replace("%%", ""):
        if "%b" in file.replace("%%", ""):
            return [((place(n), name), i) for i, n in enumerate(assemble.numbered_sources(file, lambda n: os.path.exists(place(n))))]

        def there(n):
            try:
                H5File(place(file)).resolve(n)
                return True
            except FileNotFoundError:
                return False

        return [((place(file), n), i) for i, n in enumerate(assemble.numbered_sources(name, there))]
    path = place(file.replace("%%", "%"))
    return [((path, name.replace("%%", "%")), None)] if os.path.exists(path) else []


def _numbered(target, number: int):
    """The place of the n-th source of a series: the selection's n-th block along its unlimited dimension."""
    kind, start, stride, count, block = target
    at = tuple(s + number * t if c is None else s for s, t, c in zip(start, stride, count, strict=True))
    return kind, at, stride, tuple(1 if c is None else c for c in count), block


# Catalog


def catalog(spark, path: str) -> dict[str, DataFrame]:
    """``nodes``, ``links``, ``attributes`` and ``chunks`` of a file; metadata only."""
    f = H5File(path)
    nodes, links, attributes, chunks = [], [], [], []
    for name, kind, at in f.nodes():
        parent = name.rpartition("/")[0] or "/"
        if name != "/":
            links.append((parent, name.rpartition("/")[2], "hard" if kind in ("group", "dataset", "datatype") else kind, None if isinstance(at, int) else json.dumps(at if not isinstance(at, bytes) else None)))
        if not isinstance(at, int):
            continue
        shape = type_name = layout = None
        if kind == "dataset":
            ds = open_dataset(f, name)
            shape, type_name, layout = list(ds.shape), ds.type.cls, ds.layout
            chunks += [(name, list(c), e[1]) for c, e in sorted((ds.index or {}).items())]
            if ds.layout in ("contiguous", "compact"):
                stored = len(ds.inline) if ds.layout == "compact" else 0 if ds.address == f.none else prod(ds.shape) * ds.type.size
                chunks.append((name, [0] * len(ds.shape), stored))
        nodes.append((name, kind, shape, type_name, layout))
        for key, (t, dims, values) in f.attributes(at).items():
            attributes.append((name, key, t.cls, None if dims is None else list(dims), json.dumps(values.to_pylist(), default=str)))
    return {
        "nodes": spark.createDataFrame(nodes, "path string, kind string, shape array<bigint>, type string, layout string"),
        "links": spark.createDataFrame(links, "parent string, name string, kind string, target string"),
        "attributes": spark.createDataFrame(attributes, "path string, name string, type string, shape array<bigint>, value string"),
        "chunks": spark.createDataFrame(chunks, "path string, cell array<bigint>, bytes bigint"),
    }


# Writing: superblock 2, version 2 object headers, compact groups, contiguous or fixed-array chunked data


def type_message(spec) -> bytes:
    """A datatype message: a numpy type, ``("enum", {name: code})`` over int8, or a list of (name, type) for a compound."""
    if isinstance(spec, tuple) and spec[0] == "enum":
        names = b"".join(n.encode() + b"\0" for n in spec[1])
        return struct.pack("<BBBBI", 0x38, len(spec[1]), 0, 0, 1) + type_message("i1") + names + np.array(list(spec[1].values()), "i1").tobytes()
    d = np.dtype(spec)
    if d.names:
        width = max(1, (d.itemsize.bit_length() + 7) // 8) if d.itemsize > 255 else 1
        body = b"".join(n.encode() + b"\0" + d.fields[n][1].to_bytes(width, "little") + type_message(d.fields[n][0]) for n in d.names)
        return struct.pack("<BHBI", 0x36, len(d.names), 0, d.itemsize) + body
    big = d.byteorder == ">"
    if d.kind in "iu":
        return struct.pack("<BBBBIHH", 0x10, int(big) | 8 * (d.kind == "i"), 0, 0, d.itemsize, 0, 8 * d.itemsize)
    if d.kind == "f":
        sign, e, en, mn, bias = {2: (15, 10, 5, 10, 15), 4: (31, 23, 8, 23, 127), 8: (63, 52, 11, 52, 1023)}[d.itemsize]
        return struct.pack("<BBBBIHHBBBBI", 0x11, int(big) | 0x20, sign, 0, d.itemsize, 0, 8 * d.itemsize, e, en, 0, mn, bias)
    if d.kind == "S":
        return struct.pack("<BBBBI", 0x13, 0x11, 0, 0, d.itemsize)
    if d.kind == "V":
        return struct.pack("<BBBBI", 0x15, 0, 0, 0, d.itemsize)
    raise ValueError(f"no datatype for {d}")


def space_message(shape) -> bytes:
    return struct.pack("<BBBB", 2, len(shape), 0, 1 if shape else 0) + b"".join(struct.pack("<Q", n) for n in shape)


def header(messages: list[tuple[int, bytes]]) -> bytes:
    body = b"".join(struct.pack("<BHB", k, len(d), 0) + d for k, d in messages)
    head = b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body
    return head + struct.pack("<I", lookup3(head))


def attribute_message(name: str, value) -> bytes:
    x = np.array(value.encode(), f"S{max(1, len(value.encode()))}") if isinstance(value, str) else np.asarray(value)
    t, s = type_message(x.dtype), space_message(x.shape)
    return struct.pack("<BBHHHB", 3, 0, len(name.encode()) + 1, len(t), len(s), 1) + name.encode() + b"\0" + t + s + x.tobytes()


def link_message(name: str, address: int) -> bytes:
    raw = name.encode()
    return struct.pack("<BBBH", 1, 0x11, 1, len(raw)) + raw + struct.pack("<Q", address)


def soft_link_message(name: str, target: str) -> bytes:
    raw, to = name.encode(), target.encode()
    return struct.pack("<BBBBH", 1, 0x19, 1, 1, len(raw)) + raw + struct.pack("<H", len(to)) + to


class Assembler:
    """A file written front to back: data first, then headers, then the superblock that points at the root."""

    def __init__(self, path: str):
        self.path, self.aside = path, f"{path}.tmp"
        self.out = open(self.aside, "wb")  # noqa: SIM115
        self.out.write(b"\0" * 48)
        self.tree: dict = {}

    def put(self, data: bytes) -> int:
        at = self.out.tell()
        pad = -at % 8
        self.out.write(b"\0" * pad + data)
        return at + pad

    def add(self, name: str, messages: list[tuple[int, bytes]]) -> None:
        *groups, last = name.strip("/").split("/")
        node = self.tree
        for g in groups:
            node = node.setdefault(g, {})
        node[last] = self.put(header(messages))

    def group(self, name: str) -> None:
        node = self.tree
        for g in name.strip("/").split("/"):
            node = node.setdefault(g, {})

    def soft_link(self, name: str, target: str) -> None:
        *groups, last = name.strip("/").split("/")
        node = self.tree
        for g in groups:
            node = node.setdefault(g, {})
        node[last] = target

    def contiguous(self, name: str, data: bytes, spec, shape, fill: bytes | None = None, attributes: dict | None = None) -> None:
        at = self.put(data) if data else (1 << 64) - 1
        layout = struct.pack("<BBQQ", 3, 1, at, len(data))
        self.add(name, [(1, space_message(shape)), (3, type_message(spec)), (5, fill_message(fill)), (8, layout), *[(12, attribute_message(k, v)) for k, v in (attributes or {}).items()]])

    def chunked(self, name: str, chunks, entries: dict, spec, shape, filters: list[tuple[int, tuple[int, ...]]], item: int, fill: bytes | None = None, attributes: dict | None = None) -> None:
        """entries: chunk place to (address, bytes)."""
        grid = [-(-n // c) for n, c in zip(shape, chunks, strict=True)]
        count, none = prod(grid), (1 << 64) - 1
        raw = prod(chunks) * item
        width = 8 + (min(8, (raw.bit_length() + 15) // 8) + 4 if filters else 0)
        page = 63
        body = bytearray()
        for cell in product(*map(range, grid)):
            at, n = entries.get(cell, (none, 0))
            body += struct.pack("<Q", at) + (n.to_bytes(width - 12, "little") + struct.pack("<I", 0) if filters else b"")
        head_at = self.out.tell() + -self.out.tell() % 8
        head_size = 4 + 4 + 8 + 8 + 4
        block_at = head_at + head_size + -head_size % 8
        head = b"FAHD" + struct.pack("<BBBBQQ", 0, int(bool(filters)), width, page, count, block_at)
        self.put(head + struct.pack("<I", lookup3(head)))
        block = b"FADB" + struct.pack("<BBQ", 0, int(bool(filters)), head_at) + bytes(body)
        assert self.put(block + struct.pack("<I", lookup3(block))) == block_at
        dims = b"".join(struct.pack("<Q", n) for n in (*chunks, item))
        layout = struct.pack("<BBBBB", 4, 2, 0, len(chunks) + 1, 8) + dims + struct.pack("<BBQ", 3, page, head_at)
        messages = [(1, space_message(shape)), (3, type_message(spec)), (5, fill_message(fill)), (8, layout)]
        if filters:
            messages.append((11, struct.pack("<BB", 2, len(filters)) + b"".join(struct.pack("<H", i) + (struct.pack("<H", 0) if i >= 256 else b"") + struct.pack("<HH", 0, len(v)) + struct.pack(f"<{len(v)}I", *v) for i, v in filters)))
        self.add(name, messages + [(12, attribute_message(k, v)) for k, v in (attributes or {}).items()])

    def close(self) -> None:
        def write(node) -> int:
            links = [(6, soft_link_message(n, c) if isinstance(c, str) else link_message(n, c if isinstance(c, int) else write(c))) for n, c in sorted(node.items())]
            return self.put(header([(2, struct.pack("<BBQQ", 0, 0, (1 << 64) - 1, (1 << 64) - 1)), (10, b"\0\0"), *links]))

        root = write(self.tree)
        end = self.out.tell()
        top = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBQQQQ", 2, 8, 8, 0, 0, (1 << 64) - 1, end, root)
        self.out.seek(0)
        self.out.write(top + struct.pack("<I", lookup3(top)))
        self.out.close()
        os.replace(self.aside, self.path)

    def abort(self) -> None:
        self.out.close()
        os.unlink(self.aside)


def fill_message(fill: bytes | None) -> bytes:
    return struct.pack("<BB", 3, 0x0A) if fill is None else struct.pack("<BBI", 3, 0x2A, len(fill)) + fill


FILTERS = {"deflate": (1, lambda d, item: codecs.zlib_encode(d, 4), (4,)), "shuffle": (2, codecs.shuffle, None), "fletcher32": (3, lambda d, item: codecs.CODECS["fletcher32"][0](d), ()), "zstd": (32015, lambda d, item: codecs.zstd_encode(d), ()), "bzip2": (307, lambda d, item: codecs.bzip2_encode(d), (9,)), "lz4": (32004, lambda d, item: codecs.lz4_filter_encode(d), (0,))}


@dataclass
class Parts(WriterCommitMessage):
    file: str
    chunks: list


class H5Writer(DataSourceArrowWriter):
    """Tasks encode chunks into part files beside the target; the commit strings them together behind one index."""

    def __init__(self, path: str, layout: dict):
        self.path, self.layout = path, layout

    def write(self, iterator):
        from pyspark import TaskContext

        lay = self.layout
        dtype, shape, chunks = np.dtype(lay["dtype"]), lay["shape"], lay["chunks"]
        dims, made = [f"i{k}" for k in range(len(shape))], []
        context = TaskContext.get()
        name = f"{self.path}.part-{context.partitionId()}-{context.taskAttemptId()}"
        now = held = None
        with open(name, "wb") as out:

            def flush():
                data = held.tobytes()
                for f in lay["filters"]:
                    data = FILTERS[f][1](data, dtype.itemsize)
                made.append((now, out.tell(), len(data)))
                out.write(data)

            for batch in iterator:
                at = [np.asarray(batch.column(d)) for d in dims]
                values = batch.column("v").to_numpy(zero_copy_only=False).astype(dtype)
                cells = np.stack([x // c for x, c in zip(at, chunks, strict=True)], axis=1)
                cuts = np.flatnonzero(np.any(cells[1:] != cells[:-1], axis=1)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                    if a == b:
                        continue
                    cell = tuple(int(c) for c in cells[a])
                    if cell != now:
                        if now is not None:
                            flush()
                        now, held = cell, np.full(chunks, lay["fill"], dtype)
                    held[tuple(x[a:b] - c * n for x, c, n in zip(at, cell, chunks, strict=True))] = values[a:b]
            if now is not None:
                flush()
        return Parts(name, made)

    def commit(self, messages):
        lay = self.layout
        dtype = np.dtype(lay["dtype"])
        file, entries = Assembler(self.path), {}
        for m in messages:
            if m is None:
                continue
            with open(m.file, "rb") as part:
                for cell, at, n in m.chunks:
                    part.seek(at)
                    entries[tuple(cell)] = (file.put(part.read(n)), n)
        filters = [(FILTERS[f][0], (dtype.itemsize,) if FILTERS[f][2] is None else FILTERS[f][2]) for f in lay["filters"]]
        file.chunked(lay["dataset"], lay["chunks"], entries, dtype, lay["shape"], filters, dtype.itemsize, np.array(lay["fill"], dtype).tobytes(), lay["attributes"])
        file.close()
        self._clean(messages)

    def abort(self, messages):
        self._clean(messages)

    def _clean(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.file):
                os.unlink(m.file)


def write_dataset(a: ArrayFrame, path: str, dataset: str, *, dtype: str, chunks, filters: tuple[str, ...] = ("shuffle", "deflate"), fill=0, attributes: dict | None = None, width: int | None = None) -> None:
    """A new file with one chunked dataset. Chunks are built by tasks; missing rows become the fill value."""
    spark = a.df.sparkSession
    register(spark)
    names = [f"i{k}" for k in range(a.rank)]
    rows = a.df.select(*[F.col(d).alias(n) for d, n in zip(a.dims, names, strict=True)], a.v.alias("v"))
    cells = [F.expr(f"{n} div {c}") for n, c in zip(names, chunks, strict=True)]
    rows = rows.repartition(width or int(spark.conf.get("spark.sql.shuffle.partitions")), *cells).sortWithinPartitions(*cells, *names)
    layout = {"dtype": np.dtype(dtype).str, "shape": list(a.shape), "chunks": list(chunks), "filters": list(filters), "fill": fill, "dataset": dataset, "attributes": attributes or {}}
    rows.write.format("h5array").option("path", path).option("layout", json.dumps(layout)).mode("append").save()


def write_arrays(path: str, arrays: dict[str, np.ndarray], attributes: dict[str, dict] | None = None) -> None:
    """A small file of contiguous datasets from memory."""
    file = Assembler(path)
    try:
        for name, x in arrays.items():
            file.contiguous(name, np.ascontiguousarray(x).tobytes(), ("enum", {"FALSE": 0, "TRUE": 1}) if x.dtype == bool else x.dtype, x.shape, attributes=(attributes or {}).get(name))
        file.close()
    except BaseException:
        file.abort()
        raise
