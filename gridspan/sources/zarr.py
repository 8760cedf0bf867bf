"""Zarr arrays, versions 2 and 3: metadata, codec pipelines, chunk reads and writes, and the ``zarrarray`` data source.

The driver reads metadata and plans chunks; executors fetch and decode them and hand over Arrow batches. Coordinate
filters prune chunks before any task is made.
"""

from __future__ import annotations

import base64
import json
import math
import uuid
from bisect import bisect_left, bisect_right
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from decimal import Decimal
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..array import ArrayFrame
from ..functions import casts, codecs
from ..functions.chunks import key_text, run_lengths
from ..functions.text import fill_from_json, fill_to_json
from .box import BoxReader, cell_ranges
from .stores import Store, open_store

ABSENT = 2**64 - 1
#: Bytes between two wanted ranges of a shard that are fetched with them, and decoded bytes of an input partition.
NEAR, PARTITION_BYTES = 8192, 32 << 20


SPARK_TYPES = {"tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "decimal(20,0)": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class Kind:
    """An element type: ``dtype`` for fixed-size elements, ``text`` or ``bytes`` for variable ones."""

    name: str
    dtype: np.dtype | None = None

    @property
    def item_bytes(self) -> int:
        return self.dtype.itemsize if self.dtype is not None else 16


def kind_of(spec) -> Kind:
    """The element type of a version 3 ``data_type``."""
    if isinstance(spec, str):
        if spec in ("string", "variable_length_utf8"):
            return Kind("string")
        if spec in ("bytes", "variable_length_bytes"):
            return Kind("bytes")
        if spec == "bool":
            return Kind("bool", np.dtype(bool))
        if spec.startswith("r") and spec[1:].isdigit():
            return Kind("raw", np.dtype(f"V{int(spec[1:]) // 8}"))
        return Kind(spec, np.dtype(spec).newbyteorder("<"))
    name, conf = spec["name"], spec.get("configuration", {})
    if name in ("numpy.datetime64", "numpy.timedelta64"):
        unit = conf["unit"] if conf.get("scale_factor", 1) == 1 else f"{conf['scale_factor']}{conf['unit']}"
        return Kind("time", np.dtype(f"<{'M' if 'date' in name else 'm'}8[{unit}]"))
    if name == "fixed_length_utf32":
        return Kind("fixed_text", np.dtype(f"<U{conf['length_bytes'] // 4}"))
    if name == "null_terminated_bytes":
        return Kind("fixed_bytes", np.dtype(f"S{conf['length_bytes']}"))
    if name == "raw_bytes":
        return Kind("raw", np.dtype(f"V{conf['length_bytes']}"))
    if name in ("struct", "structured"):
        fields = conf["fields"]
        pairs = [(f["name"], f["data_type"]) if isinstance(f, dict) else tuple(f) for f in fields]
        return Kind("struct", np.dtype([(n, kind_of(t).dtype) for n, t in pairs]))
    raise ValueError(f"no element type {name!r}")


def kind_of_v2(spec, filters) -> Kind:
    if spec == "|O":
        ids = {f["id"] for f in filters or ()}
        return Kind("string" if "vlen-utf8" in ids else "bytes")
    dtype = np.dtype([tuple(x) for x in spec] if isinstance(spec, list) else spec)
    return Kind({"b": "bool", "V": "struct" if dtype.names else "raw", "U": "fixed_text", "S": "fixed_bytes", "M": "time", "m": "time"}.get(dtype.kind, dtype.name), dtype)


def spark_kind(kind: Kind) -> T.DataType:
    if kind.name == "string" or kind.name == "fixed_text":
        return T.StringType()
    if kind.dtype is None or kind.name in ("raw", "fixed_bytes"):
        return T.BinaryType()
    if kind.dtype.names:
        return T.StructType([T.StructField(n, spark_kind(kind_of_v2(kind.dtype[n].str if not kind.dtype[n].names else kind.dtype[n].descr, None))) for n in kind.dtype.names])
    if kind.dtype.kind == "c":
        part = T.FloatType() if kind.dtype.itemsize == 8 else T.DoubleType()
        return T.StructType([T.StructField("re", part), T.StructField("im", part)])
    if kind.name == "time":
        return T.LongType()
    return SPARK_TYPES[casts.spark_type(kind.dtype.name)]


def to_arrow(values: np.ndarray, kind: Kind) -> pa.Array:
    """Elements as an Arrow array of their Spark type."""
    if kind.name == "string":
        return pa.array(values.tolist(), pa.string())
    if kind.dtype is None:
        return pa.array(values.tolist(), pa.binary())
    values = np.ascontiguousarray(values)
    if kind.name == "fixed_text":
        return pa.array(values.tolist(), pa.string())
    if kind.name == "fixed_bytes":
        return pa.array(values.tolist(), pa.binary())
    if kind.dtype.names:
        parts = [(n, kind_of_v2(kind.dtype[n].str if not kind.dtype[n].names else kind.dtype[n].descr, None)) for n in kind.dtype.names]
        return pa.StructArray.from_arrays([to_arrow(values[n], k) for n, k in parts], [n for n, _ in parts])
    if kind.name == "raw":
        return pa.array([bytes(x.tobytes()) for x in values], pa.binary())
    if kind.dtype.kind == "c":
        return pa.StructArray.from_arrays([pa.array(values.real.astype(values.real.dtype.newbyteorder("="))), pa.array(values.imag.astype(values.imag.dtype.newbyteorder("=")))], ["re", "im"])
    if kind.name == "time":
        raw = values.view(values.dtype.str[0] + "i8").astype(np.int64)
        return pa.array(raw, pa.int64(), mask=raw == -(2**63))
    native = values.astype(values.dtype.newbyteorder("="))
    name = native.dtype.name
    if name == "uint64":
        return pa.array([Decimal(int(x)) for x in native], pa.decimal128(20, 0))
    wider = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64, "float16": np.float32}
    return pa.array(native.astype(wider.get(name, native.dtype)))


def from_arrow(column: pa.Array, kind: Kind, fill) -> np.ndarray:
    """An Arrow column as elements; null is the fill value."""
    if kind.dtype is None:
        return np.array([fill if x is None else x for x in column.to_pylist()], object)
    if kind.dtype.names:
        out = np.zeros(len(column), kind.dtype)
        for n in kind.dtype.names:
            sub = kind_of_v2(kind.dtype[n].str if not kind.dtype[n].names else kind.dtype[n].descr, None)
            out[n] = from_arrow(column.field(n), sub, np.zeros((), kind.dtype[n])[()])
        return out
    if kind.dtype.kind == "c":
        return np.array([fill if x is None else complex(x["re"], x["im"]) for x in column.to_pylist()], kind.dtype)
    if kind.dtype.kind in "USV" or kind.dtype.name == "uint64":
        return np.array([fill if x is None else int(x) if kind.dtype.name == "uint64" else x for x in column.to_pylist()], kind.dtype)
    if kind.name == "time":
        return np.array([-(2**63) if x is None else x for x in column.to_pylist()], np.int64).astype("<i8").view(kind.dtype.newbyteorder("<")).astype(kind.dtype)
    values = column.fill_null(pa.scalar(fill, column.type)) if column.null_count else column
    raw = values.to_numpy(zero_copy_only=False)
    if kind.dtype.kind in "iu" and len(raw):
        limit = np.iinfo(kind.dtype)
        if raw.min() < limit.min or raw.max() > limit.max:
            raise OverflowError(f"a value is out of the range of {kind.dtype.name}")
    return raw.astype(kind.dtype)


# Codec pipelines


def _split(pipeline: list[dict]) -> tuple[list[dict], dict, list[dict]]:
    """Array filters, the codec that makes bytes, and byte codecs."""
    array_like = {"transpose", "reshape", "cast_value", "delta", "fixedscaleoffset", "quantize", "astype", "bitround"}
    makers = {"bytes", "sharding_indexed", "vlen-utf8", "vlen-bytes", "packbits"}
    names = [c["name"].removeprefix("numcodecs.") for c in pipeline]
    k = next((i for i, n in enumerate(names) if n in makers), None)
    if k is None:
        k = sum(n in array_like for n in names)
        pipeline = [*pipeline[:k], {"name": "bytes", "configuration": {"endian": "little"}}, *pipeline[k:]]
    return pipeline[:k], pipeline[k], pipeline[k + 1 :]


def _conf(codec: dict) -> tuple[str, dict]:
    return codec["name"].removeprefix("numcodecs."), codec.get("configuration", {}) or {}


def _byte_encode(codec: dict, data: bytes, item: int) -> bytes:
    name, conf = _conf(codec)
    if name in ("gzip", "zlib", "bz2"):
        return codecs.CODECS[name][0](data, max(1, int(conf.get("level", 5))))
    if name == "zstd":
        return codecs.zstd_encode(data, int(conf.get("level", 3)))
    if name == "blosc":
        return codecs.blosc_encode(data, int(conf.get("typesize") or item), int(conf.get("clevel", 5)) or 1, conf.get("shuffle", "shuffle") not in ("noshuffle", 0))
    if name == "shuffle":
        return codecs.shuffle(data, int(conf.get("elementsize", item)))
    if name == "bitshuffle":
        return codecs.bitshuffle_encode(data, item)
    if name in ("lz4", "crc32c", "crc32", "adler32", "fletcher32"):
        return codecs.CODECS[name][0](data)
    raise ValueError(f"no encoder {name!r}")


def _byte_decode(codec: dict, data: bytes, item: int, limit: int) -> bytes:
    name, conf = _conf(codec)
    if name == "shuffle":
        return codecs.unshuffle(data, int(conf.get("elementsize", item)))
    if name == "bitshuffle":
        return codecs.bitshuffle_decode(data, item)
    if name in codecs.CODECS:
        return codecs.CODECS[name][1](data, limit)
    raise ValueError(f"no decoder {name!r}")


def _filter_encode(codec: dict, x: np.ndarray) -> np.ndarray:
    name, conf = _conf(codec)
    if name == "transpose":
        return x.transpose(_order(conf["order"], x.ndim))
    if name == "delta":
        flat = x.ravel().astype(conf.get("dtype", x.dtype))
        out = np.concatenate([flat[:1], np.diff(flat)]).astype(conf.get("astype", flat.dtype))
        return out.reshape(x.shape)
    if name == "fixedscaleoffset":
        return np.around((x - conf["offset"]) * conf["scale"]).astype(conf.get("astype", conf["dtype"]))
    if name == "quantize":
        step = 2.0 ** math.ceil(math.log2(10.0 ** conf["digits"]))
        return (np.rint(x * step) / step).astype(conf.get("astype", conf["dtype"]))
    if name == "astype":
        return x.astype(conf["encode_dtype"])
    if name == "bitround":
        return casts.round_bits(x, int(conf["keepbits"])).astype(x.dtype)
    if name == "cast_value":
        return _cast(conf, x, conf["data_type"], "encode")
    if name == "reshape":
        return x.reshape(_reshaped(conf["shape"], x.shape))
    raise ValueError(f"no filter {name!r}")


def _filter_decode(codec: dict, x: np.ndarray, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
    name, conf = _conf(codec)
    if name == "transpose":
        return x.transpose(np.argsort(_order(conf["order"], x.ndim)))
    if name == "delta":
        return np.cumsum(x.ravel(), dtype=conf.get("dtype", dtype)).reshape(shape).astype(dtype)
    if name == "fixedscaleoffset":
        return (x / conf["scale"] + conf["offset"]).astype(conf.get("dtype", dtype))
    if name in ("quantize", "bitround"):
        return x.astype(dtype)
    if name == "cast_value":
        return _cast(conf, x, dtype.name, "decode")
    if name == "astype":
        return x.astype(conf.get("decode_dtype", dtype))
    return x.reshape(shape)


def _cast(conf: dict, x: np.ndarray, target: str, way: str) -> np.ndarray:
    return casts.cast_array(x, target, conf.get("rounding", "nearest-even"), conf.get("out_of_range") or "error", (conf.get("scalar_map") or {}).get(way, ()))


def _order(order, rank: int) -> list[int]:
    return list(range(rank)) if order == "C" else list(reversed(range(rank))) if order == "F" else list(order)


def _reshaped(spec, shape) -> list[int]:
    return [prod(shape[k] for k in s) if isinstance(s, list) else s for s in spec]


def _after(codec: dict, shape: tuple[int, ...], dtype: np.dtype | None):
    """Shape and element type behind a filter."""
    name, conf = _conf(codec)
    if name == "transpose":
        return tuple(shape[k] for k in _order(conf["order"], len(shape))), dtype
    if name == "reshape":
        sizes = _reshaped(conf["shape"], shape)
        return tuple(prod(shape) // max(1, -prod(sizes)) if s == -1 else s for s in sizes), dtype
    kinds = {"delta": "astype", "fixedscaleoffset": "astype", "quantize": "astype", "astype": "encode_dtype", "cast_value": "data_type"}
    return shape, np.dtype(conf.get(kinds.get(name, ""), dtype)) if dtype is not None else None


def encode(pipeline: list[dict], x: np.ndarray, kind: Kind, fill) -> bytes:
    filters, maker, tail = _split(pipeline)
    for c in filters:
        x = _filter_encode(c, x)
    name, conf = _conf(maker)
    if name == "sharding_indexed":
        data = _shard_encode(conf, x, kind, fill)
    elif name in ("vlen-utf8", "vlen-bytes"):
        data = codecs.vlen_encode([v.encode() if isinstance(v, str) else bytes(v) for v in x.ravel().tolist()])
    elif name == "packbits":
        data = codecs.pack_bits(x.ravel())
    else:
        order = ">" if conf.get("endian") == "big" else "<"
        data = np.ascontiguousarray(x).astype(x.dtype.newbyteorder(order)).tobytes()
    for c in tail:
        data = _byte_encode(c, data, x.dtype.itemsize)
    return data


def decode(pipeline: list[dict], data: bytes, shape: tuple[int, ...], kind: Kind, fill) -> np.ndarray:
    filters, maker, tail = _split(pipeline)
    steps = [(tuple(shape), kind.dtype)]
    for c in filters:
        steps.append(_after(c, *steps[-1]))
    now, dtype = steps[-1]
    item = dtype.itemsize if dtype is not None else 1
    limit = 1 << 31 if dtype is None else 2 * prod(now) * item + (1 << 20)
    for c in reversed(tail):
        data = _byte_decode(c, data, item, limit)
    name, conf = _conf(maker)
    if name == "sharding_indexed":
        x = _shard_decode(conf, data, now, kind, fill)
    elif name in ("vlen-utf8", "vlen-bytes"):
        values = codecs.vlen_decode(data)
        x = np.empty(len(values), object)
        x[:] = [v.decode() for v in values] if kind.name == "string" else values
    elif name == "packbits":
        x = codecs.unpack_bits(data)
    else:
        order = {"big": ">", "little": "<"}.get(conf.get("endian"))
        if len(data) != prod(now) * item:
            raise codecs.CodecError(f"a chunk of {len(data)} bytes instead of {prod(now) * item}")
        x = np.frombuffer(data, dtype.newbyteorder(order) if order else dtype).astype(dtype.newbyteorder("<") if order else dtype)
    if x.size != prod(now):
        raise codecs.CodecError(f"a chunk of {x.size} elements instead of {prod(now)}")
    x = x.reshape(now)
    for c, (s, d) in zip(reversed(filters), reversed(steps[:-1]), strict=True):
        x = _filter_decode(c, x, s, d)
    return x


def _index_bytes(conf: dict, cells: int) -> int:
    return 16 * cells + 4 * sum(_conf(c)[0] == "crc32c" for c in conf["index_codecs"])


def _shard_encode(conf: dict, x: np.ndarray, kind: Kind, fill) -> bytes:
    inner = tuple(conf["chunk_shape"])
    grid = tuple(-(-n // c) for n, c in zip(x.shape, inner, strict=True))
    index = np.full((*grid, 2), ABSENT, np.uint64)
    head = _index_bytes(conf, prod(grid)) if conf.get("index_location", "end") == "start" else 0
    body, at = [], head
    for cell in np.ndindex(grid):
        part = x[tuple(slice(k * c, (k + 1) * c) for k, c in zip(cell, inner, strict=True))]
        if is_fill(part, fill):
            continue
        data = encode(conf["codecs"], part, kind, fill)
        index[cell] = (at, len(data))
        body.append(data)
        at += len(data)
    tail = encode(conf["index_codecs"], index, Kind("uint64", np.dtype("<u8")), 0)
    return b"".join([tail, *body] if head else [*body, tail])


def _shard_index(conf: dict, data: bytes, grid: tuple[int, ...]) -> np.ndarray:
    return decode(conf["index_codecs"], data, (*grid, 2), Kind("uint64", np.dtype("<u8")), 0)


def _shard_decode(conf: dict, data: bytes, shape, kind: Kind, fill) -> np.ndarray:
    inner = tuple(conf["chunk_shape"])
    grid = tuple(-(-n // c) for n, c in zip(shape, inner, strict=True))
    size = _index_bytes(conf, prod(grid))
    index = _shard_index(conf, data[:size] if conf.get("index_location", "end") == "start" else data[len(data) - size :], grid)
    out = full(shape, kind, fill)
    for cell in np.ndindex(grid):
        at, n = (int(v) for v in index[cell])
        if at != ABSENT:
            if at + n > len(data):
                raise codecs.CodecError("a sub-chunk lies beyond its shard")
            out[tuple(slice(k * c, (k + 1) * c) for k, c in zip(cell, inner, strict=True))] = decode(conf["codecs"], data[at : at + n], inner, kind, fill)
    return out


def full(shape, kind: Kind, fill) -> np.ndarray:
    if kind.dtype is None:
        out = np.empty(shape, object)
        out[...] = fill
        return out
    out = np.empty(shape, kind.dtype)
    out[...] = np.zeros((), kind.dtype) if fill is None else fill
    return out


def is_fill(x: np.ndarray, fill) -> bool:
    if fill is None:
        return False
    if x.dtype.kind in "fc":
        same = np.frombuffer(np.ascontiguousarray(x).tobytes(), np.uint8).reshape(x.size, -1) == np.frombuffer(np.array(fill, x.dtype).tobytes(), np.uint8)
        return bool(same.all())
    return bool(np.all(x == np.array(fill, x.dtype) if x.dtype != object else x == fill))


# Metadata


@dataclass
class ArrayMeta:
    shape: tuple[int, ...]
    kind: Kind
    chunks: tuple[list[int] | int, ...]  # a size for each dimension, or all sizes of a rectilinear one
    pipeline: list[dict]
    fill: object
    version: int = 3
    encoding: str = "default"
    separator: str = "/"
    attributes: dict = field(default_factory=dict)
    names: list[str] | None = None
    document: dict = field(default_factory=dict)

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(f"i{k}" for k in range(len(self.shape)))

    def starts(self, k: int) -> list[int]:
        size, n = self.chunks[k], self.shape[k]
        if isinstance(size, int):
            return list(range(0, n, size)) if n else []
        out, at = [], 0
        for s in size:
            if at < n:
                out.append(at)
            at += s
        return out

    def chunk_size(self, k: int, cell: int) -> int:
        return self.chunks[k] if isinstance(self.chunks[k], int) else self.chunks[k][cell]

    def origin(self, cell) -> tuple[int, ...]:
        return tuple(c * s if isinstance(s := self.chunks[k], int) else sum(s[:c]) for k, c in enumerate(cell))

    def key(self, cell) -> str:
        return key_text(cell, self.encoding, self.separator)

    def cell_box(self, low=None, high=None) -> list[range]:
        """In each dimension, the chunks that meet the box from ``low`` to ``high`` (exclusive)."""
        out = []
        for k, n in enumerate(self.shape):
            a, b = (0 if low is None else max(0, low[k])), (n if high is None else min(n, high[k]))
            size = self.chunks[k]
            if a >= b:
                out.append(range(0))
            elif isinstance(size, int):
                out.append(range(a // size, -(-b // size)))
            else:
                starts = self.starts(k)
                out.append(range(bisect_right(starts, a) - 1, bisect_left(starts, b)))
        return out

    def cells(self, low=None, high=None):
        """The chunks that meet the box, in C order."""
        return product(*self.cell_box(low, high))

    def chunk_bytes(self) -> int:
        return prod(s if isinstance(s, int) else max(s) for s in self.chunks) * self.kind.item_bytes if self.chunks else self.kind.item_bytes


def parse_v3(doc: dict) -> ArrayMeta:
    if doc.get("node_type") != "array":
        raise ValueError("the metadata isn't of an array")
    for part in doc:
        if isinstance(doc[part], dict) and doc[part].get("must_understand") is True and part not in ("chunk_grid", "chunk_key_encoding", "data_type"):
            raise ValueError(f"the extension {part!r} must be understood")
    kind, shape = kind_of(doc["data_type"]), tuple(doc["shape"])
    grid, conf = doc["chunk_grid"]["name"], doc["chunk_grid"].get("configuration", {})
    if grid == "regular":
        chunks = tuple(conf["chunk_shape"])
    elif grid == "rectilinear":
        chunks = tuple(c if isinstance(c, int) else run_lengths(c) for c in conf.get("chunk_shapes", conf.get("chunk_shape")))
    else:
        raise ValueError(f"no chunk grid {grid!r}")
    keys = doc.get("chunk_key_encoding", {"name": "default"})
    encoding = keys["name"]
    separator = keys.get("configuration", {}).get("separator", "/" if encoding == "default" else ".")
    return ArrayMeta(shape, kind, chunks, doc["codecs"], fill_value(doc.get("fill_value"), kind), 3, encoding, separator, doc.get("attributes") or {}, doc.get("dimension_names"), doc)


def parse_v2(doc: dict, attributes: dict | None = None) -> ArrayMeta:
    filters = doc.get("filters") or []
    kind = kind_of_v2(doc["dtype"], filters)
    pipeline = []
    if doc.get("order") == "F":
        pipeline.append({"name": "transpose", "configuration": {"order": "F"}})
    late = {"shuffle", "crc32", "crc32c", "adler32", "fletcher32", "zlib", "gzip", "bz2", "zstd", "lz4", "blosc"}
    as_codec = lambda c: {"name": c["id"], "configuration": {k: v for k, v in c.items() if k != "id"}}
    pipeline += [as_codec(f) for f in filters if f["id"] not in late]
    if not any(f["id"] in ("vlen-utf8", "vlen-bytes", "packbits") for f in filters):
        big = kind.dtype is not None and kind.dtype.byteorder == ">"
        pipeline.append({"name": "bytes", "configuration": {"endian": "big" if big else "little"} if kind.dtype is not None and not kind.dtype.names else {}})
    pipeline += [as_codec(f) for f in filters if f["id"] in late]
    if doc.get("compressor"):
        pipeline.append(as_codec(doc["compressor"]))
    fill = doc.get("fill_value")
    if kind.name in ("fixed_bytes", "raw", "struct") and isinstance(fill, str):
        fill = np.frombuffer(base64.b64decode(fill).ljust(kind.dtype.itemsize, b"\0"), kind.dtype)[0]
    else:
        fill = fill_value(fill, kind)
    return ArrayMeta(tuple(doc["shape"]), kind, tuple(doc["chunks"]), pipeline, fill, 2, "v2", doc.get("dimension_separator", "."), attributes or {}, None, doc)


def fill_value(value, kind: Kind):
    if kind.name == "string":
        return value or ""
    if kind.name == "bytes":
        return base64.b64decode(value) if isinstance(value, str) else bytes(value or ())
    if value is None:
        return None
    if kind.dtype.names or kind.name == "fixed_bytes" or kind.name == "raw":
        raw = base64.b64decode(value) if isinstance(value, str) else bytes(value) if isinstance(value, list) else b""
        return np.frombuffer(raw.ljust(kind.dtype.itemsize, b"\0"), kind.dtype)[0]
    if kind.name == "time":
        return np.array(-(2**63) if value == "NaT" else int(value), np.int64).view(f"{kind.dtype.kind}8[{np.datetime_data(kind.dtype)[0]}]")
    name = kind.dtype.name
    return np.array(fill_from_json(value, name), kind.dtype)[()]


def open_array(store: Store, path: str = "") -> ArrayMeta:
    """An array's metadata: version 3 first, then version 2."""
    at = f"{path.strip('/')}/" if path.strip("/") else ""
    if (raw := store.get(f"{at}zarr.json")) is not None:
        return parse_v3(json.loads(raw))
    if (raw := store.get(f"{at}.zarray")) is not None:
        return parse_v2(json.loads(raw), json.loads(store.get(f"{at}.zattrs") or b"{}"))
    raise FileNotFoundError(f"no array at {path or '/'}")


def make_document(shape, data_type: str, chunks, *, codecs_: list[dict] | None = None, fill=0, shards=None, attributes=None, names=None, separator="/") -> dict:
    """Version 3 metadata. ``shards`` puts the chunks into larger files with an index."""
    kind = kind_of(data_type)
    if codecs_ is None:
        maker = {"string": "vlen-utf8", "bytes": "vlen-bytes"}.get(kind.name)
        codecs_ = [{"name": maker} if maker else {"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 3, "checksum": False}}]
    if shards:
        inner = {"chunk_shape": list(chunks), "codecs": codecs_, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": "end"}
        codecs_ = [{"name": "sharding_indexed", "configuration": inner}]
    doc = {
        "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": data_type,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(shards or chunks)}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": separator}},
        "fill_value": fill if kind.dtype is None else fill_to_json(fill, kind.dtype.name), "codecs": codecs_, "attributes": attributes or {},
    }
    return doc | ({"dimension_names": list(names)} if names else {})


# Chunks


def read_chunk(store: Store, base: str, meta: ArrayMeta, cell, low=None, high=None) -> np.ndarray | None:
    """A decoded chunk, or None if it isn't stored. Of a shard only the sub-chunks that meet the box are fetched."""
    shape = tuple(meta.chunk_size(k, c) for k, c in enumerate(cell))
    key = f"{base}{meta.key(cell)}"
    if low is not None and meta.pipeline and _conf(meta.pipeline[0])[0] == "sharding_indexed" and len(meta.pipeline) == 1:
        return _read_part(store, key, meta, shape, meta.origin(cell), low, high)
    data = store.get(key)
    return None if data is None else decode(meta.pipeline, data, shape, meta.kind, meta.fill)


def _read_part(store: Store, key: str, meta: ArrayMeta, shape, origin, low, high) -> np.ndarray | None:
    conf = _conf(meta.pipeline[0])[1]
    inner = tuple(conf["chunk_shape"])
    grid = tuple(-(-n // c) for n, c in zip(shape, inner, strict=True))
    size = _index_bytes(conf, prod(grid))
    head = conf.get("index_location", "end") == "start"
    raw = store.get(key, 0 if head else -size, size)
    if raw is None:
        return None
    index = _shard_index(conf, raw, grid)
    wanted = []
    for cell in np.ndindex(grid):
        at, n = (int(v) for v in index[cell])
        if at != ABSENT and all(o + k * c < h and o + (k + 1) * c > b for o, k, c, b, h in zip(origin, cell, inner, low, high, strict=True)):
            wanted.append((at, n, cell))
    out, i = full(shape, meta.kind, meta.fill), 0
    wanted.sort()
    while i < len(wanted):
        j, end = i, wanted[i][0] + wanted[i][1]
        while j + 1 < len(wanted) and wanted[j + 1][0] <= end + NEAR:
            j += 1
            end = max(end, wanted[j][0] + wanted[j][1])
        data = store.get(key, wanted[i][0], end - wanted[i][0])
        for at, n, cell in wanted[i : j + 1]:
            start = at - wanted[i][0]
            out[tuple(slice(k * c, (k + 1) * c) for k, c in zip(cell, inner, strict=True))] = decode(conf["codecs"], data[start : start + n], inner, meta.kind, meta.fill)
        i = j + 1
    return out


def elements(x: np.ndarray, origin, meta: ArrayMeta, low, high) -> pa.RecordBatch | None:
    """The part of a chunk inside the array and the box, in element form."""
    cut, starts = [], []
    for o, n, s, a, b in zip(origin, x.shape, meta.shape, low, high, strict=True):
        begin, stop = max(0, a - o), min(n, s - o, b - o)
        if begin >= stop:
            return None
        cut.append(slice(begin, stop))
        starts.append(o + begin)
    part = x[tuple(cut)]
    columns = []
    for k, (s, n) in enumerate(zip(starts, part.shape, strict=True)):
        below, above = prod(part.shape[k + 1 :]), prod(part.shape[:k])
        columns.append(pa.array(np.tile(np.repeat(np.arange(s, s + n, dtype=np.int64), below), above)))
    return pa.RecordBatch.from_arrays([*columns, to_arrow(part.ravel(), meta.kind)], names=[*meta.dims, "v"])


class ZarrReader(BoxReader):
    def __init__(self, path: str, array: str, form: str, keep_absent: bool, partition_bytes: int):
        self.path, self.form, self.keep_absent, self.partition_bytes = path, form, keep_absent, partition_bytes
        self.base = f"{array.strip('/')}/" if array.strip("/") else ""
        self.meta = open_array(open_store(path), array)
        self.bound(self.meta.dims, self.meta.shape)

    def partitions(self):
        box = self.meta.cell_box(self.low, self.high)
        return cell_ranges(tuple(r.start for r in box), tuple(len(r) for r in box), self.partition_bytes // max(1, self.meta.chunk_bytes()))

    def read(self, partition):
        store = open_store(self.path)
        for cell in partition.cells:
            if self.form == "chunk":
                data = store.get(f"{self.base}{self.meta.key(cell)}")
                if data is not None:
                    shape = [self.meta.chunk_size(k, c) for k, c in enumerate(cell)]
                    yield pa.RecordBatch.from_arrays([*[pa.array([c], pa.int64()) for c in cell], pa.array([shape], pa.list_(pa.int32())), pa.array([data], pa.binary())], names=[*[f"c{k}" for k in range(len(cell))], "shape", "data"])
                continue
            x = read_chunk(store, self.base, self.meta, cell, self.low, self.high)
            if x is None:
                if not self.keep_absent:
                    continue
                x = full(tuple(self.meta.chunk_size(k, c) for k, c in enumerate(cell)), self.meta.kind, self.meta.fill)
            batch = elements(x, self.meta.origin(cell), self.meta, self.low, self.high)
            if batch is not None:
                yield batch


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]  # from the attempt's folder to the chunk's key
    gone: list[str]


class ZarrWriter(DataSourceArrowWriter):
    """Chunks of rows that arrive together, chunk by chunk (``write_array`` deals and sorts them so).

    An attempt writes its chunks below a folder of its own. They are moved into place, and chunks that became all fill
    deleted, when all tasks are done; a failed job leaves the array as it was. With ``document`` the array is created, or
    replaced, at that moment too.
    """

    def __init__(self, path: str, array: str, empty_chunks: bool, document: str | None = None):
        self.path, self.base, self.empty, self.document = path, f"{array.strip('/')}/" if array.strip("/") else "", empty_chunks, document
        self.meta = parse_v3(json.loads(document)) if document else open_array(open_store(path), array)
        self.staged = f"{self.base}.staged-{uuid.uuid4().hex}/"

    def write(self, iterator):
        store, meta, done = open_store(self.path), self.meta, Written([], [])
        now, held, attempt = None, None, f"{self.staged}{uuid.uuid4().hex}/"

        def flush():
            key = f"{self.base}{meta.key(now)}"
            if is_fill(held, meta.fill) and not self.empty:
                done.gone.append(key)
            else:
                aside = f"{attempt}{meta.key(now)}"
                store.put(aside, encode(meta.pipeline, held, meta.kind, meta.fill))
                done.moves.append((aside, key))

        for batch in iterator:
            if not batch.num_rows:
                continue
            at = [np.asarray(batch.column(d)) for d in meta.dims]
            values = from_arrow(batch.column("v"), meta.kind, meta.fill)
            cells = np.stack([np.searchsorted(meta.starts(k), x, side="right") - 1 for k, x in enumerate(at)], axis=1) if at else np.zeros((batch.num_rows, 0), np.int64)
            cuts = np.flatnonzero(np.any(cells[1:] != cells[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                cell = tuple(int(c) for c in cells[a])
                if cell != now:
                    if now is not None:
                        flush()
                    now = cell
                    old = None if self.document else read_chunk(store, self.base, meta, cell)
                    held = full(tuple(meta.chunk_size(k, c) for k, c in enumerate(cell)), meta.kind, meta.fill) if old is None else old.copy()
                origin = meta.origin(cell)
                held[tuple(x[a:b] - o for x, o in zip(at, origin, strict=True))] = values[a:b] if at else values[0]
        if now is not None:
            flush()
        return done

    def commit(self, messages):
        store, done = open_store(self.path), [m for m in messages if m]
        if self.document:
            for key in store.keys(self.base):
                if not key.startswith(self.staged):
                    store.delete(key)
            store.put(f"{self.base}zarr.json", self.document.encode())
        with ThreadPoolExecutor(16) as pool:  # each is a request to the store, not a copy through the driver
            list(pool.map(lambda move: store.move(*move), [move for m in done for move in m.moves]))
            list(pool.map(store.delete, [] if self.document else [key for m in done for key in m.gone]))
        self.abort(messages)

    def abort(self, messages):
        open_store(self.path).delete(self.staged.rstrip("/"))


class ZarrSource(DataSource):
    """``spark.read.format("zarrarray").option("path", ...).option("array", ...)``.

    Options: ``form`` (``element`` or ``chunk``), ``fill`` (``keep`` gives the fill value of absent chunks, ``drop`` leaves
    their rows out), ``partitionBytes``.
    """

    @classmethod
    def name(cls):
        return "zarrarray"

    def _options(self):
        if "path" not in self.options:
            raise ValueError("the option path is missing")
        return self.options["path"], self.options.get("array", "")

    def schema(self):
        meta = open_array(open_store(self._options()[0]), self._options()[1])
        if self.options.get("form", "element") == "chunk":
            fields = [T.StructField(f"c{k}", T.LongType()) for k in range(len(meta.shape))]
            return T.StructType([*fields, T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())])
        return T.StructType([*[T.StructField(d, T.LongType()) for d in meta.dims], T.StructField("v", spark_kind(meta.kind))])

    def reader(self, schema):
        path, array = self._options()
        return ZarrReader(path, array, self.options.get("form", "element"), self.options.get("fill", "keep") == "keep", int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite):
        path, array = self._options()
        return ZarrWriter(path, array, self.options.get("writeEmptyChunks", "false").lower() == "true", self.options.get("document"))


def register(spark) -> None:
    spark.dataSource.register(ZarrSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_array(spark, path: str, array: str = "", **options) -> ArrayFrame:
    register(spark)
    meta = open_array(open_store(path), array)
    reader = spark.read.format("zarrarray").option("path", path).option("array", array)
    for k, v in options.items():
        reader = reader.option(k, v)
    return ArrayFrame(reader.load(), meta.dims, meta.shape, "v", meta.fill)


def write_array(a: ArrayFrame, path: str, array: str = "", *, data_type: str, chunks, shards=None, width: int | None = None, overwrite: bool = True, **document) -> None:
    """An array written with one task a group of chunks; a shard is one chunk here. Missing rows become the fill value.

    With ``overwrite`` the array there before is replaced once all chunks are written; otherwise chunks join those there.
    """
    from pyspark.sql import functions as F

    spark = a.df.sparkSession
    register(spark)
    store, base = open_store(path), f"{array.strip('/')}/" if array.strip("/") else ""
    doc = make_document(a.shape, data_type, chunks, shards=shards, **document)
    parts = base.strip("/").split("/") if base else []
    for k in range(len(parts)):  # the groups above it
        key = "/".join([*parts[:k], "zarr.json"])
        if store.get(key) is None:
            store.put(key, json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {}}).encode())
    if not overwrite:
        store.put(f"{base}zarr.json", json.dumps(doc).encode())
    outer = shards or chunks
    names = [f"i{k}" for k in range(a.rank)]
    rows = a.df.select(*[F.col(d).alias(n) for d, n in zip(a.dims, names, strict=True)], a.v.alias("v"))
    cells = [F.expr(f"{n} div {c}") for n, c in zip(names, outer, strict=True)]
    if cells:
        rows = rows.repartition(width or int(spark.conf.get("spark.sql.shuffle.partitions")), *cells).sortWithinPartitions(*cells, *names)
    writer = rows.write.format("zarrarray").option("path", path).option("array", array)
    (writer.option("document", json.dumps(doc)) if overwrite else writer).mode("append").save()
