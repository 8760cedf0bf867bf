"""Projections: members, shapes and axes, all narrow."""

from __future__ import annotations

from decimal import Decimal
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import ArrayFrame


def member(a: ArrayFrame, path: str) -> ArrayFrame:
    """One member of a compound value; nested members by a dotted path. Only its column is read."""
    return a.with_df(a.df.select(*a.dims, F.col(f"{a.value}.{path}").alias(a.value)))


def columns_of(a: ArrayFrame) -> DataFrame:
    """A compound array as a table: coordinates, then one column a member."""
    return a.df.select(*a.dims, f"{a.value}.*")


def transpose(a: ArrayFrame, order: tuple[int, ...]) -> ArrayFrame:
    """Axis ``k`` of the result is axis ``order[k]``; dimension names stay with their place."""
    if sorted(order) != list(range(a.rank)):
        raise ValueError(f"{order} is no permutation of {a.rank} axes")
    columns = [F.col(a.dims[o]).alias(a.dims[k]) for k, o in enumerate(order)]
    return a.with_df(a.df.select(*columns, a.value), shape=tuple(a.shape[o] for o in order))


def reshape(a: ArrayFrame, shape: tuple[int, ...], dims: tuple[str, ...] | None = None) -> ArrayFrame:
    """The same elements in C order under another shape; one size may be -1."""
    sizes = list(shape)
    if sizes.count(-1) > 1:
        raise ValueError("only one size can be -1")
    if -1 in sizes:
        rest = prod(s for s in sizes if s != -1)
        if not rest or a.size % rest:
            raise ValueError(f"{a.size} elements don't fill {shape}")
        sizes[sizes.index(-1)] = a.size // rest
    if prod(sizes) != a.size:
        raise ValueError(f"{a.size} elements don't fill {shape}")
    names = dims or tuple(f"i{k}" for k in range(len(sizes)))
    flat = a.df.select(a.ordinal().alias("__at"), a.value)
    columns, below = [], 1
    for name, n in reversed(list(zip(names, sizes, strict=True))):
        columns.append(F.expr(f"(__at div {below}) % {max(n, 1)}").alias(name))
        below *= n
    return a.with_df(flat.select(*reversed(columns), a.value), dims=names, shape=tuple(sizes))


def squeeze(a: ArrayFrame, dim: str, at: int = 0) -> ArrayFrame:
    """The array at one index of a dimension, which goes."""
    k = a.dims.index(dim)
    if not 0 <= at < a.shape[k]:
        raise IndexError(f"{dim}: {at} is outside of {a.shape[k]}")
    rest = [i for i in range(a.rank) if i != k]
    return a.with_df(a.df.filter(F.col(dim) == at), dims=tuple(a.dims[i] for i in rest), shape=tuple(a.shape[i] for i in rest))


def array_dimension(a: ArrayFrame, n: int, dim: str) -> ArrayFrame:
    """Array-typed elements of ``n`` values as a further dimension."""
    out = a.df.select(*a.dims, F.posexplode(a.value).alias(dim, "__e"))
    out = out.select(*a.dims, F.col(dim).cast("bigint").alias(dim), F.col("__e").alias(a.value))
    return a.with_df(out, dims=(*a.dims, dim), shape=(*a.shape, n))


def names_of(a: ArrayFrame, members: dict[int, str]) -> ArrayFrame:
    """Names of enumeration values; a value without a name is null."""
    table = F.create_map(*[F.lit(x) for pair in members.items() for x in pair])
    return a.with_value(table[a.v])


def codes_of(a: ArrayFrame, members: dict[int, str]) -> ArrayFrame:
    return names_of(a, {name: code for code, name in members.items()})


def complex_of(v: Column) -> Column:
    """A real value as a complex one."""
    return F.struct(v.alias("re"), F.lit(0.0).alias("im"))


def exact_unsigned(v: Column, bits: int = 64) -> Column:
    """A value stored as a signed integer of so many bits, read as unsigned."""
    d = v.cast("decimal(20,0)")
    return F.when(d < 0, d + F.lit(Decimal(1 << bits))).otherwise(d).cast("decimal(20,0)")


def scalar(a: ArrayFrame) -> object:
    """The value of an array of one element."""
    if a.size != 1:
        raise ValueError(f"the array has {a.size} elements, not one")
    row = a.df.select(a.value).first()
    return a.fill if row is None else row[0]
