"""Per-chunk codecs, bytes to bytes, each bounded by the decoded size it is told, and columns of them.

Chunks travel as binary columns; a codec runs over Arrow batches on the executors.
"""

from __future__ import annotations

import bz2
import gzip
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import checksums


class CodecError(ValueError):
    """Bytes that a codec can't decode."""


def _inflate(data: bytes, limit: int | None, bits: int) -> bytes:
    d = zlib.decompressobj(bits)
    try:
        out = d.decompress(data, 0 if limit is None else limit + 1)
    except zlib.error as e:
        raise CodecError(str(e)) from None
    if limit is not None and len(out) > limit:
        raise CodecError(f"more than {limit} decoded bytes")
    if not d.eof:
        raise CodecError("the compressed bytes end early")
    return out


def zlib_encode(data: bytes, level: int = 5) -> bytes:
    return zlib.compress(data, level)


def zlib_decode(data: bytes, limit: int | None = None) -> bytes:
    return _inflate(data, limit, 15)


def gzip_encode(data: bytes, level: int = 5) -> bytes:
    return gzip.compress(data, level, mtime=0)


def gzip_decode(data: bytes, limit: int | None = None) -> bytes:
    return _inflate(data, limit, 31)


def bzip2_encode(data: bytes, level: int = 9) -> bytes:
    return bz2.compress(data, level)


def bzip2_decode(data: bytes, limit: int | None = None) -> bytes:
    d = bz2.BZ2Decompressor()
    try:
        out = d.decompress(data, -1 if limit is None else limit + 1)
    except OSError as e:
        raise CodecError(str(e)) from None
    if limit is not None and len(out) > limit or not d.eof:
        raise CodecError("not a whole bzip2 stream within the limit")
    return out


def zstd_encode(data: bytes, level: int = 3) -> bytes:
    return pa.Codec("zstd", compression_level=level or 3).compress(data, asbytes=True)


def zstd_decode(data: bytes, limit: int | None = None) -> bytes:
    import zstandard

    try:
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=limit or 0) if limit else zstandard.ZstdDecompressor().decompressobj().decompress(data)
    except zstandard.ZstdError as e:
        raise CodecError(str(e)) from None


def lz4_block_encode(data: bytes) -> bytes:
    """A size of four bytes, then a raw block."""
    return struct.pack("<I", len(data)) + pa.Codec("lz4_raw").compress(data, asbytes=True)


def lz4_block_decode(data: bytes, limit: int | None = None) -> bytes:
    if len(data) < 4:
        raise CodecError("no size before the block")
    size = struct.unpack_from("<I", data)[0]
    if limit is not None and size > limit:
        raise CodecError(f"more than {limit} decoded bytes")
    return lz4_raw_decode(data[4:], size)


def lz4_raw_decode(data: bytes, size: int) -> bytes:
    if not size:
        return b""
    try:
        out = pa.Codec("lz4_raw").decompress(data, decompressed_size=size, asbytes=True)
    except OSError as e:
        raise CodecError(str(e)) from None
    return out


def lz4_filter_encode(data: bytes, block: int = 1 << 30) -> bytes:
    """Big-endian total and block size, then each block after its size, raw where it would grow."""
    block = max(1, min(block, len(data) or 1))
    out = [struct.pack(">QI", len(data), block)]
    for at in range(0, len(data), block):
        part = data[at : at + block]
        packed = pa.Codec("lz4_raw").compress(part, asbytes=True)
        packed = packed if len(packed) < len(part) else part
        out += [struct.pack(">I", len(packed)), packed]
    return b"".join(out)


def lz4_filter_decode(data: bytes, limit: int | None = None) -> bytes:
    if len(data) < 12:
        raise CodecError("no header before the blocks")
    total, block = struct.unpack_from(">QI", data)
    if limit is not None and total > limit or total and not block:
        raise CodecError("the sizes of the header can't be right")
    at, out, left = 12, [], total
    while left:
        if at + 4 > len(data):
            raise CodecError("the blocks end early")
        size = struct.unpack_from(">I", data, at)[0]
        want = min(block, left)
        part = data[at + 4 : at + 4 + size]
        out.append(part if size == want else lz4_raw_decode(part, want))
        at, left = at + 4 + size, left - want
    return b"".join(out)


def lzf_decode(data: bytes, limit: int) -> bytes:
    """Literal runs and back references."""
    out, at = bytearray(), 0
    try:
        while at < len(data):
            control = data[at]
            at += 1
            if control < 32:
                out += data[at : at + control + 1]
                if at + control + 1 > len(data):
                    raise CodecError("a literal run ends early")
                at += control + 1
            else:
                length = control >> 5
                if length == 7:
                    length += data[at]
                    at += 1
                back = ((control & 31) << 8 | data[at]) + 1
                at += 1
                if back > len(out):
                    raise CodecError("a reference before the start")
                for _ in range(length + 2):
                    out.append(out[-back])
            if len(out) > limit:
                raise CodecError(f"more than {limit} decoded bytes")
    except IndexError:
        raise CodecError("the compressed bytes end early") from None
    return bytes(out)


def lzf_encode(data: bytes) -> bytes:
    """Literal runs alone: readable, not smaller."""
    return b"".join(bytes([len(data[i : i + 32]) - 1]) + data[i : i + 32] for i in range(0, len(data), 32))


def shuffle(data: bytes, size: int) -> bytes:
    """Bytes of elements by their place in the element; a rest stays at the end."""
    n = len(data) // size * size
    return np.frombuffer(data[:n], np.uint8).reshape(-1, size).T.tobytes() + data[n:]


def unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size * size
    return np.frombuffer(data[:n], np.uint8).reshape(size, -1).T.tobytes() + data[n:]


def bit_shuffle_block(data: bytes, size: int) -> bytes:
    """Bits of a multiple of eight elements by their place in the element, lowest first."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, size), axis=1, bitorder="little")
    return np.packbits(bits.T, bitorder="little").tobytes()


def bit_unshuffle_block(data: bytes, size: int) -> bytes:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").reshape(size * 8, -1)
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes()


def _bit_blocks(n: int, size: int, block: int) -> list[int]:
    """Elements of each block: whole blocks, then a last one of a multiple of eight."""
    block = block or max(128, 8192 // size // 8 * 8)
    out = [block] * (n // block)
    last = n % block // 8 * 8
    return out + [last] * bool(last)


def bitshuffle_encode(data: bytes, size: int, block: int = 0, compress: str | None = None) -> bytes:
    n, at = len(data) // size, 0
    block = block or max(128, 8192 // size // 8 * 8)
    out = [struct.pack(">QI", len(data), block * size)] if compress else []
    for count in _bit_blocks(n, size, block):
        part = bit_shuffle_block(data[at : at + count * size], size)
        if compress:
            part = {"lz4": lambda d: pa.Codec("lz4_raw").compress(d, asbytes=True), "zstd": zstd_encode}[compress](part)
            out.append(struct.pack(">I", len(part)))
        out.append(part)
        at += count * size
    return b"".join([*out, data[at:]])


def bitshuffle_decode(data: bytes, size: int, block: int = 0, compress: str | None = None, limit: int | None = None) -> bytes:
    total, at = len(data), 0
    if compress:
        if len(data) < 12:
            raise CodecError("no header before the blocks")
        total, width = struct.unpack_from(">QI", data)
        block, at = width // size, 12
        if limit is not None and total > limit or not block:
            raise CodecError("the sizes of the header can't be right")
    out, left = [], total
    for count in _bit_blocks(total // size, size, block):
        if compress:
            if at + 4 > len(data):
                raise CodecError("the blocks end early")
            packed = struct.unpack_from(">I", data, at)[0]
            raw = data[at + 4 : at + 4 + packed]
            part = lz4_raw_decode(raw, count * size) if compress == "lz4" else zstd_decode(raw, count * size)
            at += 4 + packed
        else:
            part = data[at : at + count * size]
            at += count * size
        if len(part) != count * size:
            raise CodecError("a block of another size")
        out.append(bit_unshuffle_block(part, size))
        left -= count * size
    return b"".join([*out, data[at : at + left]])


def blosc_encode(data: bytes, size: int = 1, level: int = 5, shuffled: bool = True) -> bytes:
    """A version-1 container of one zstd stream a block, after a byte shuffle; stored as it is where that is smaller."""
    size = size if 0 < size < 256 else 1
    block = max(size, min(len(data) or 1, 1 << 18) // size * size)
    body, starts = [], []
    count = -(-len(data) // block)
    at = 16 + 4 * count
    for i in range(count):
        part = data[i * block : (i + 1) * block]
        part = shuffle(part, size) if shuffled and size > 1 else part
        packed = zstd_encode(part, level)
        packed = packed if len(packed) < len(part) else part
        starts.append(at)
        body.append(struct.pack("<i", len(packed)) + packed)
        at += 4 + len(packed)
    flags = (4 << 5) | 0x10 | (1 if shuffled and size > 1 else 0)
    if at >= len(data) + 16:
        return struct.pack("<BBBBIII", 2, 1, 0x02, size, len(data), block, len(data) + 16) + data
    return struct.pack("<BBBBIII", 2, 1, flags, size, len(data), block, at) + struct.pack(f"<{count}I", *starts) + b"".join(body)


def blosc_decode(data: bytes, limit: int | None = None) -> bytes:
    """A version-1 container of lz4, zlib, zstd or snappy blocks, with byte or bit shuffle."""
    if len(data) < 16:
        raise CodecError("no container header")
    _, _, flags, size, total, block, packed = struct.unpack_from("<BBBBIII", data)
    size = size or 1
    if limit is not None and total > limit:
        raise CodecError(f"more than {limit} decoded bytes")
    if flags & 0x02:
        return data[16 : 16 + total]
    if total and not block or packed > len(data):
        raise CodecError("the sizes of the container can't be right")
    method = flags >> 5
    out = []
    for i in range(-(-total // block) if total else 0):
        want = min(block, total - i * block)
        at = struct.unpack_from("<I", data, 16 + 4 * i)[0]
        whole = flags & 0x10 or want < block or size < 2 or size > 16 or block // size < 128
        streams, parts = 1 if whole else size, []
        for _ in range(streams):
            n = struct.unpack_from("<i", data, at)[0]
            each, raw = want // streams, data[at + 4 : at + 4 + n]
            if n < 0 or len(raw) < n:
                raise CodecError("a block ends early")
            if n == each:
                parts.append(raw)
            elif method == 1:
                parts.append(lz4_raw_decode(raw, each))
            elif method == 2:
                parts.append(pa.Codec("snappy").decompress(raw, decompressed_size=each, asbytes=True))
            elif method == 3:
                parts.append(zlib_decode(raw, each))
            elif method == 4:
                parts.append(zstd_decode(raw, each))
            else:
                raise CodecError(f"no decoder for the container's method {method}")
            at += 4 + n
        part = b"".join(parts)
        if flags & 0x01 and size > 1:
            part = unshuffle(part, size)
        elif flags & 0x04:
            n = len(part) // size // 8 * 8 * size
            part = bit_unshuffle_block(part[:n], size) + part[n:] if n else part
        out.append(part)
    return b"".join(out)


def checked(name: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    """Encoder and decoder of a checksum of four little-endian bytes at the end."""
    compute = getattr(checksums, name)

    def decode(data: bytes) -> bytes:
        body, tail = data[:-4], data[-4:]
        if len(data) < 4 or int.from_bytes(tail, "little") != compute(body):
            raise CodecError(f"{name} of the chunk doesn't agree")
        return body

    return lambda data: data + compute(data).to_bytes(4, "little"), decode


def vlen_encode(values: list[bytes]) -> bytes:
    """A count, then each value after its length."""
    return struct.pack("<I", len(values)) + b"".join(struct.pack("<I", len(v)) + v for v in values)


def vlen_decode(data: bytes) -> list[bytes]:
    if len(data) < 4:
        raise CodecError("no count before the values")
    at, out = 4, []
    for _ in range(struct.unpack_from("<I", data)[0]):
        if at + 4 > len(data):
            raise CodecError("the values end early")
        n = struct.unpack_from("<I", data, at)[0]
        if at + 4 + n > len(data):
            raise CodecError("a value ends early")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def pack_bits(flags: np.ndarray) -> bytes:
    """A byte with the number of padding bits, then the flags, highest bit first."""
    return bytes([-len(flags) % 8]) + np.packbits(flags.astype(bool)).tobytes()


def unpack_bits(data: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data[1:], np.uint8))
    return bits[: len(bits) - data[0]].astype(bool)


def nbit_decode(data: bytes, width: int, precision: int, offset: int, count: int) -> np.ndarray:
    """Unsigned integers of ``precision`` bits, packed highest bit first, put at ``offset`` of ``width`` bytes."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))[: count * precision].reshape(count, precision)
    weight = (np.uint64(1) << np.arange(precision, dtype=np.uint64))[::-1]
    return ((bits * weight).sum(axis=1, dtype=np.uint64) << np.uint64(offset)).astype(f"<u{width}")


def nbit_encode(values: np.ndarray, precision: int, offset: int) -> bytes:
    v = values.astype(np.uint64) >> np.uint64(offset)
    bits = (v[:, None] >> np.arange(precision, dtype=np.uint64)[::-1]) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def scale_offset_decode(data: bytes, count: int, dtype: str, kind: str, factor: int = 0, fill: object | None = None) -> np.ndarray:
    """Values relative to their minimum: a bit count, the minimum, then packed differences; ``kind`` int or decimal float."""
    bits, width = int.from_bytes(data[:4], "little"), data[4]
    low = int.from_bytes(data[5 : 5 + width], "little")
    body = data[21:]
    out = np.dtype(dtype)
    if bits >= out.itemsize * 8:
        return np.frombuffer(body, out, count)
    raw = np.zeros(count, np.uint64) if not bits else nbit_decode(body, 8, bits, 0, count)
    if kind == "int":
        values = (raw + np.uint64(low & (2**64 - 1))).astype(np.uint64).view(np.int64).astype(out)
    else:
        least = np.frombuffer(low.to_bytes(8, "little"), "<f8" if out.itemsize == 8 else "<f4")[0]
        values = (raw.astype(np.int64) / 10.0**factor + float(least)).astype(out)
    if fill is not None and bits:
        values = np.where(raw == np.uint64((1 << bits) - 1), np.array(fill, out), values)
    return values


#: Codecs by name: encode(data, **options), decode(data, limit, **options).
CODECS: dict[str, tuple[Callable, Callable]] = {
    "zlib": (zlib_encode, zlib_decode),
    "gzip": (gzip_encode, gzip_decode),
    "bz2": (bzip2_encode, bzip2_decode),
    "zstd": (zstd_encode, zstd_decode),
    "lz4": (lz4_block_encode, lz4_block_decode),
    "lz4_filter": (lz4_filter_encode, lz4_filter_decode),
    "lzf": (lzf_encode, lzf_decode),
    "shuffle": (lambda d, size: shuffle(d, size), lambda d, limit, size: unshuffle(d, size)),
    "bitshuffle": (bitshuffle_encode, lambda d, limit, size, **o: bitshuffle_decode(d, size, limit=limit, **o)),
    "blosc": (blosc_encode, blosc_decode),
    "crc32c": (checked("crc32c")[0], lambda d, limit: checked("crc32c")[1](d)),
    "crc32": (checked("crc32")[0], lambda d, limit: checked("crc32")[1](d)),
    "adler32": (checked("adler32")[0], lambda d, limit: checked("adler32")[1](d)),
    "fletcher32": (checked("fletcher32")[0], lambda d, limit: checked("fletcher32")[1](d)),
}


def coded(df: DataFrame, steps: list[tuple[str, dict]], *, column: str = "data", decode: bool = False, limit: int = 1 << 31) -> DataFrame:
    """``df`` with a binary column sent through codecs in order (backwards to decode), in Arrow batches; null stays null."""
    return recoded(df, [(steps, decode)], column=column, limit=limit)


def recoded(df: DataFrame, passes: list[tuple[list[tuple[str, dict]], bool]], *, column: str = "data", limit: int = 1 << 31) -> DataFrame:
    """``coded`` for passes of (steps, decode), one after the other. A task has one Python worker for them all, as each call
    of ``coded`` adds another; batches are bounded in bytes both ways, and one value at a time is on its way."""
    checksums.bounded_batches(df.sparkSession)

    def apply(data: bytes) -> bytes:
        for steps, decode in passes:
            for name, options in reversed(steps) if decode else steps:
                data = CODECS[name][1](data, limit, **(options if "shuffle" in name else {})) if decode else CODECS[name][0](data, **options)
        return data

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(column)
            low, done, size = 0, [], 0
            for i, x in enumerate(batch.column(k)):
                done.append(apply(x.as_py()) if x.is_valid else None)
                size += len(done[-1] or b"")
                if size >= checksums.SLICE_BYTES or i + 1 == batch.num_rows:
                    yield batch.slice(low, len(done)).set_column(k, column, pa.array(done, pa.binary()))
                    low, done, size = i + 1, [], 0

    return df.mapInArrow(run, df.schema)
