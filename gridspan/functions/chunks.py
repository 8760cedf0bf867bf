"""Chunk arithmetic: which chunk holds an index, how far it reaches, what its key is, and shapes for new arrays."""

from __future__ import annotations

from itertools import accumulate
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def regular(i: Column, size: int) -> Column:
    return F.floor(i / F.lit(size)).cast("bigint")


def edge_extent(i: Column, size: int, extent: int) -> Column:
    """Elements of the chunk holding ``i`` that lie inside the array."""
    start = regular(i, size) * size
    return F.least(F.lit(size).cast("bigint"), F.lit(extent).cast("bigint") - start)


def run_lengths(spec: list[int | list[int]]) -> list[int]:
    """Chunk sizes from a list of sizes or [size, repeats]."""
    return [s for part in spec for s in ([part] if isinstance(part, int) else [part[0]] * part[1])]


def rectilinear(i: Column, sizes: list[int]) -> Column:
    """The chunk among chunks of the given sizes that holds ``i``."""
    starts = [0, *accumulate(sizes)][:-1]
    table = F.array(*[F.lit(s) for s in starts])
    return (F.size(F.filter(table, lambda s: s <= i)) - 1).cast("bigint")


def chunk_key(cells: list[Column], encoding: str = "default", separator: str = "/") -> Column:
    """``c/1/2`` or, for the second encoding, ``1.2``; a scalar array has ``c`` or ``0``."""
    if encoding == "default":
        return F.concat_ws(separator, F.lit("c"), *[c.cast("string") for c in cells])
    if encoding == "v2":
        return F.concat_ws(separator, *[c.cast("string") for c in cells]) if cells else F.lit("0")
    raise ValueError(f"no chunk key encoding {encoding!r}")


def key_text(cell: tuple[int, ...], encoding: str = "default", separator: str = "/") -> str:
    if encoding == "default":
        return separator.join(["c", *map(str, cell)])
    return separator.join(map(str, cell)) if cell else "0"


def overlapped(offset: tuple[int, ...], count: tuple[int, ...], chunks: tuple[int, ...]) -> list[range]:
    """The chunks of each dimension that a box meets."""
    return [range(o // c, -(-(o + n) // c)) if n else range(0) for o, n, c in zip(offset, count, chunks, strict=True)]


def guess_chunks(shape: tuple[int, ...], item_bytes: int, target: int = 1 << 20) -> tuple[int, ...]:
    """Chunk sizes near ``target`` bytes: the largest dimension is halved until they fit."""
    out = [max(1, n) for n in shape]
    while prod(out) * item_bytes > target and max(out) > 1:
        k = out.index(max(out))
        out[k] = -(-out[k] // 2)
    return tuple(out)


def block_shape(shape: tuple[int, ...], item_bytes: int, limit: int = 8 << 20) -> tuple[int, ...]:
    """A block of at most ``limit`` bytes, grown from the last dimension."""
    out, room = [1] * len(shape), max(1, limit // item_bytes)
    for k in reversed(range(len(shape))):
        out[k] = max(1, min(shape[k], room))
        room //= out[k]
        if out[k] < shape[k]:
            break
    return tuple(out)
