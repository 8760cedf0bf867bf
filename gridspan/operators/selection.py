"""Positional selections. All are row filters with re-based coordinates, so they reach the scan and never shuffle."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import ArrayFrame


@dataclass(frozen=True)
class Axis:
    """A regular selection along one dimension: ``count`` blocks of ``block``, ``stride`` apart, from ``start``."""

    start: int
    count: int
    stride: int = 1
    block: int = 1
    dropped: bool = False

    def check(self, extent: int, dim: str) -> None:
        if min(self.start, self.count) < 0 or self.stride < 1 or self.block < 1:
            raise ValueError(f"{dim}: a selection needs start, count >= 0 and stride, block >= 1")
        if self.count > 1 and self.block > self.stride:
            raise ValueError(f"{dim}: blocks of {self.block} overlap at stride {self.stride}")
        if self.count and self.start + (self.count - 1) * self.stride + self.block > extent:
            raise IndexError(f"{dim}: the selection ends beyond {extent}")

    @property
    def length(self) -> int:
        return self.count * self.block

    def inside(self, i: Column) -> Column:
        if not self.count:
            return F.lit(False)
        last = self.start + (self.count - 1) * self.stride + self.block
        out = (i >= self.start) & (i < last)
        return out & ((i - self.start) % self.stride < self.block) if self.stride > self.block else out

    def moved(self, i: Column) -> Column:
        at = i - self.start
        if self.stride == self.block or self.count <= 1:
            return at
        return (F.call_function("div", at, F.lit(self.stride)) * self.block + at % self.stride).cast("bigint")


def hyperslab(a: ArrayFrame, start, count, stride=None, block=None) -> ArrayFrame:
    """A regular hyperslab; a missing stride or block is 1 in every dimension."""
    ones = [1] * a.rank
    return select(a, [Axis(*x) for x in zip(start, count, stride or ones, block or ones, strict=True)])


def box(a: ArrayFrame, offset, count) -> ArrayFrame:
    """A dense box. The filter is two comparisons a dimension, which a source can push down to chunks."""
    return select(a, [Axis(o, 1 if c else 0, max(c, 1), max(c, 1)) for o, c in zip(offset, count, strict=True)])


def select(a: ArrayFrame, axes: list[Axis]) -> ArrayFrame:
    keep, columns, dims, shape = F.lit(True), [], [], []
    for d, n, axis in zip(a.dims, a.shape, axes, strict=True):
        axis.check(n, d)
        keep = keep & axis.inside(F.col(d))
        if not axis.dropped:
            columns.append(axis.moved(F.col(d)).alias(d))
            dims.append(d)
            shape.append(axis.length)
    return a.with_df(a.df.filter(keep).select(*columns, a.value), dims=tuple(dims), shape=tuple(shape))


SLICE = re.compile(r"\s*(?:(?P<at>-?\d+)|(?P<start>-?\d+)?\s*:\s*(?P<stop>-?\d+)?\s*(?::\s*(?P<step>-?\d+)?\s*)?)\s*")


def parse_slices(text: str, shape: tuple[int, ...]) -> list[Axis]:
    """Axes of a numpy-like text such as ``0,10:20,::4,-1``. Ends clamp, negatives count from the end, steps are positive;
    an index drops its dimension and must be inside; missing trailing dimensions are whole."""
    parts = text.split(",") if text.strip() else []
    if len(parts) > len(shape):
        raise ValueError(f"{len(parts)} slices for {len(shape)} dimensions")
    out = []
    for part, n in zip(parts + [":"] * (len(shape) - len(parts)), shape, strict=True):
        m = SLICE.fullmatch(part)
        if not m:
            raise ValueError(f"not a slice: {part!r}")
        if m["at"] is not None:
            at = int(m["at"])
            if not -n <= at < n:
                raise IndexError(f"index {at} is outside of {n}")
            out.append(Axis(at % n, 1, dropped=True))
            continue
        step = int(m["step"] or 1)
        if step < 1:
            raise ValueError("a slice needs a positive step")
        start, stop, _ = slice(*(int(m[k]) if m[k] is not None else None for k in ("start", "stop"))).indices(n)
        out.append(Axis(start, max(0, -(-(stop - start) // step)), step))
    return out


def slice_text(a: ArrayFrame, text: str) -> ArrayFrame:
    return select(a, parse_slices(text, a.shape))


def points(a: ArrayFrame, where: list[tuple[int, ...]] | DataFrame, *, broadcast_rows: int = 200_000) -> DataFrame:
    """``k`` and the value of each listed point, in the given order (``k``), repeats kept.

    A list goes as a small local table and is broadcast while it has ``broadcast_rows`` points at most; the box around its
    points narrows the scan first. A DataFrame with a ``k`` column and the dimensions joins as the planner decides.
    """
    spark, rows = a.df.sparkSession, a.df
    if isinstance(where, DataFrame):
        table = where
    else:
        for p in where:
            if len(p) != a.rank or any(not 0 <= x < n for x, n in zip(p, a.shape, strict=True)):
                raise IndexError(f"point {p} is outside of {a.shape}")
        columns = np.array([(k, *p) for k, p in enumerate(where)], np.int64).reshape(len(where), a.rank + 1).T
        table = spark.createDataFrame(pa.table(list(columns), names=["k", *a.dims]))  # a local relation, without a task
        if len(where) <= broadcast_rows:
            table = F.broadcast(table)
        for d, axis in zip(a.dims, zip(*where, strict=True), strict=False):
            rows = rows.filter((F.col(d) >= min(axis)) & (F.col(d) <= max(axis)))
    return rows.join(table, list(a.dims)).select("k", a.value)


def points_by_chunk(where: DataFrame, dims: tuple[str, ...], chunks: tuple[int, ...], width: int) -> DataFrame:
    """Points dealt and sorted by the chunk that holds them, so that each chunk is decoded once."""
    cell = [F.expr(f"{d} div {c}").alias(f"c_{d}") for d, c in zip(dims, chunks, strict=True)]
    out = where.select("*", *cell)
    names = [f"c_{d}" for d in dims]
    return out.repartition(width, *names).sortWithinPartitions(*names, "k")


def clip_unlimited(start: int, count: int | None, stride: int, block: int, extent: int) -> Axis:
    """An unlimited selection (count None) as far as ``extent`` allows whole blocks."""
    if count is None:
        room = extent - start - block
        count = room // stride + 1 if room >= 0 else 0
    return Axis(start, count, stride, block)


def box_difference(a: ArrayFrame, offset, count) -> ArrayFrame:
    """Everything outside a box; coordinates stay."""
    inside = F.lit(True)
    for d, o, c in zip(a.dims, offset, count, strict=True):
        inside = inside & (F.col(d) >= o) & (F.col(d) < o + c)
    return a.with_df(a.df.filter(~inside))


def box_intersection(offset, count, other_offset, other_count) -> tuple[list[int], list[int]]:
    low = [max(o, p) for o, p in zip(offset, other_offset, strict=True)]
    high = [min(o + c, p + d) for o, c, p, d in zip(offset, count, other_offset, other_count, strict=True)]
    return low, [max(0, h - x) for x, h in zip(low, high, strict=True)]


def capped(a: ArrayFrame, elements: int = 65_536, leading: int = 16, last: int = 4_096) -> ArrayFrame:
    """The whole of a small array; of a larger one its first ``leading`` of each dimension and ``last`` of the last."""
    if a.size <= elements:
        return a
    return box(a, [0] * a.rank, [min(n, leading) for n in a.shape[:-1]] + [min(a.shape[-1], last)])
