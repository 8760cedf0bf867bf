"""Sequential functions along one dimension, restarted in each chunk, and C-order visits.

Windows partition by chunk, so a long array spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..array import ArrayFrame


def _along(a: ArrayFrame, chunks: tuple[int, ...]):
    keys = [F.expr(f"`{d}` div {c}") for d, c in zip(a.dims, chunks, strict=True)]
    return Window.partitionBy(*keys).orderBy(*a.dims)


def wrapped(v: Column, bits: int, signed: bool = True) -> Column:
    """An integer taken modulo 2^bits into the type's range."""
    low = -(1 << (bits - 1)) if signed else 0
    if bits < 63:
        return F.pmod(v.cast("bigint") - low, F.lit(1 << bits)) + low
    span = F.lit(Decimal(1 << bits))
    return (F.pmod(v.cast("decimal(38,0)") - F.lit(Decimal(low)), span) + F.lit(Decimal(low))).cast("bigint" if signed else "decimal(20,0)")


def delta_encode(a: ArrayFrame, chunks: tuple[int, ...], bits: int | None = None) -> ArrayFrame:
    """The first element of each chunk, then differences (modulo 2^bits, if given)."""
    d = F.coalesce(a.v - F.lag(a.v).over(_along(a, chunks)), a.v)
    return a.with_value(wrapped(d, bits) if bits else d)


def delta_decode(a: ArrayFrame, chunks: tuple[int, ...], bits: int | None = None) -> ArrayFrame:
    """Running sums of each chunk (modulo 2^bits, if given)."""
    total = F.sum(a.v).over(_along(a, chunks).rowsBetween(Window.unboundedPreceding, 0))
    return a.with_value(wrapped(total, bits) if bits else total)


def with_ordinal(a: ArrayFrame, name: str = "k") -> DataFrame:
    return a.df.select("*", a.ordinal().alias(name))


def from_ordinal(df: DataFrame, name: str, dims: tuple[str, ...], shape: tuple[int, ...]) -> DataFrame:
    """Coordinates of C-order linear indexes."""
    columns, below = [], 1
    for d, n in reversed(list(zip(dims, shape, strict=True))):
        columns.append(F.expr(f"(`{name}` div {below}) % {max(n, 1)}").alias(d))
        below *= max(n, 1)
    return df.select("*", *reversed(columns))


def blocks(a: ArrayFrame, rows: int) -> DataFrame:
    """Elements with the number of their block of leading rows."""
    return a.df.select(F.expr(f"`{a.dims[0]}` div {rows}").alias("block"), "*")
