"""Arrays assembled from others: fill joins, overlays, positional pairing, resizing, writes into a selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import ArrayFrame, full_grid
from .selection import Axis, select


def filled(a: ArrayFrame, fill: object | None = None) -> ArrayFrame:
    """Every element present: what the rows lack becomes the fill value. One equi-join on the coordinates."""
    value = a.fill if fill is None else fill
    kind = a.df.schema[a.value].dataType
    grid = full_grid(a.df.sparkSession, a.dims, a.shape)
    out = grid.join(a.df, list(a.dims), "left").select(*a.dims, F.coalesce(a.v, F.lit(value).cast(kind)).alias(a.value))
    return a.with_df(out)


def resize(a: ArrayFrame, shape: tuple[int, ...]) -> ArrayFrame:
    """Shrinking filters; growing gives fill in the new cells, also where an earlier shrink had cut values off."""
    keep = F.lit(True)
    for d, old, new in zip(a.dims, a.shape, shape, strict=True):
        if new < old:
            keep = keep & (F.col(d) < new)
    cut = a.with_df(a.df.filter(keep), shape=tuple(shape))
    return filled(cut) if any(n > o for n, o in zip(shape, a.shape, strict=True)) else cut


def concat(parts: list[ArrayFrame], dim: str) -> ArrayFrame:
    """Arrays side by side along a dimension, without a shuffle."""
    first, offset, frames = parts[0], 0, []
    k = first.dims.index(dim)
    for p in parts:
        if p.shape[:k] + p.shape[k + 1 :] != first.shape[:k] + first.shape[k + 1 :]:
            raise ValueError(f"{p.shape} doesn't fit {first.shape} along {dim}")
        columns = [(F.col(d) + offset).alias(d) if d == dim else F.col(d) for d in p.dims]
        frames.append(p.df.select(*columns, p.value))
        offset += p.shape[k]
    shape = first.shape[:k] + (offset,) + first.shape[k + 1 :]
    return first.with_df(reduce(DataFrame.union, frames), shape=shape)


def overlay(parts: list[tuple[ArrayFrame, tuple[int, ...]]], shape: tuple[int, ...], fill: object | None = None) -> ArrayFrame:
    """A virtual array: each part lies at its offset, a later part over an earlier one, fill where none lies.

    A part loses what lies under the boxes of later parts, by comparisons of coordinates; then all are side by side, so
    nothing moves. Rows that a part lacks hold its fill, also over an earlier part.
    """
    first = parts[0][0]
    boxes = [[(o, min(o + n, s)) for o, n, s in zip(offset, p.shape, shape, strict=True)] for p, offset in parts]
    frames = []
    for number, (p, offset) in enumerate(parts):
        columns = [(F.col(d) + o).alias(e) for d, e, o in zip(p.dims, first.dims, offset, strict=True)]
        frame = p.df.select(*columns, p.v.alias(first.value))
        for d, o, n, s in zip(first.dims, offset, p.shape, shape, strict=True):
            if o + n > s:
                frame = frame.filter(F.col(d) < s)
        for later in boxes[number + 1 :]:
            if all(max(a, x) < min(b, y) for (a, b), (x, y) in zip(boxes[number], later, strict=True)):
                frame = frame.filter(~reduce(Column.__and__, [(F.col(d) >= a) & (F.col(d) < b) for d, (a, b) in zip(first.dims, later, strict=True)], F.lit(True)))
        frames.append(frame)
    out = first.with_df(reduce(DataFrame.union, frames), shape=tuple(shape))
    return out if fill is None else filled(out, fill)


def stacked(parts: list[ArrayFrame]) -> ArrayFrame:
    """Sparse arrays of one shape on top of each other: the last one that has a row for a place gives its value. One aggregation."""
    first = parts[0]
    rows = reduce(DataFrame.union, [p.df.select(*[F.col(d).alias(e) for d, e in zip(p.dims, first.dims, strict=True)], p.v.alias(first.value), F.lit(k).alias("__m")) for k, p in enumerate(parts)])
    return first.with_df(rows.groupBy(*first.dims).agg(F.max_by(first.v, F.col("__m")).alias(first.value)))


def ordinals(a: ArrayFrame, axes: list[Axis]) -> DataFrame:
    """``k`` (C order within the selection) and the value."""
    part = select(a, axes)
    return part.df.select(part.ordinal().alias("k"), part.value)


def map_positions(source: ArrayFrame, source_axes: list[Axis], target_axes: list[Axis], dims: tuple[str, ...], shape: tuple[int, ...]) -> ArrayFrame:
    """The k-th selected element of the source as the k-th selected place of the target, by arithmetic on k alone."""
    if _length(source_axes) != _length(target_axes):
        raise ValueError("the selections differ in size")
    rows = ordinals(source, source_axes)
    columns, below = [], 1
    for d, axis in reversed(list(zip(dims, target_axes, strict=True))):
        within = F.expr(f"(k div {below}) % {max(axis.length, 1)}")
        columns.append((F.call_function("div", within, F.lit(axis.block)) * axis.stride + within % axis.block + axis.start).cast("bigint").alias(d))
        below *= max(axis.length, 1)
    return source.with_df(rows.select(*reversed(columns), source.value), dims=dims, shape=tuple(shape))


def _length(axes: list[Axis]) -> int:
    out = 1
    for axis in axes:
        out *= axis.length
    return out


def write_box(a: ArrayFrame, offset: tuple[int, ...], values: ArrayFrame) -> ArrayFrame:
    """The array with a box of new values; coordinates must be inside. A filter and a union: nothing moves."""
    for o, n, s in zip(offset, values.shape, a.shape, strict=True):
        if o < 0 or o + n > s:
            raise IndexError("the box ends beyond the array")
    return overlay([(a, (0,) * a.rank), (values, offset)], a.shape)


def append(a: ArrayFrame, rows: ArrayFrame) -> ArrayFrame:
    """The array with further rows along its first dimension."""
    return concat([a, rows], a.dims[0])


def virtual_extent(extents: list[int], view: str = "last_available") -> int:
    """Extent of an unlimited virtual array: the furthest mapping, or the shortest."""
    if view not in ("last_available", "first_missing"):
        raise ValueError(f"no view {view!r}")
    return (max if view == "last_available" else min)(extents, default=0)


def numbered_sources(pattern: str, exists, gap: int = 0) -> list[str]:
    """Names from a pattern with ``%b`` (0, 1, 2, ...; ``%%`` is a percent sign): until more than ``gap`` in a row are missing."""
    out, missing, n = [], 0, 0
    numbered = "%b" in pattern.replace("%%", "")
    while missing <= gap:
        name = "".join(p.replace("%b", str(n)) if p != "%%" else "%" for p in _percent_parts(pattern))
        if exists(name):
            out.append(name)
            missing = 0
        else:
            missing += 1
        n += 1
        if not numbered:
            break
    return out


def _percent_parts(pattern: str) -> list[str]:
    out, rest = [], pattern
    while "%%" in rest:
        head, _, rest = rest.partition("%%")
        out += [head, "%%"]
    return [*out, rest]
