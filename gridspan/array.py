"""Arrays as DataFrames: one row an element, a coordinate column for each dimension, a value column."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ArrayFrame:
    """Element form of an n-dimensional array.

    ``df`` has the columns ``dims`` (bigint, from 0) and ``value``. ``shape`` is known, as in any array file; rows may be
    missing where the array holds ``fill``. Rows have no order: the coordinates carry it.
    """

    df: DataFrame
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    value: str = "v"
    fill: object = 0

    def __post_init__(self):
        if len(self.dims) != len(self.shape):
            raise ValueError(f"{len(self.dims)} dimensions, but a shape of {len(self.shape)}")

    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def v(self) -> Column:
        return F.col(self.value)

    def coordinates(self) -> list[Column]:
        return [F.col(d) for d in self.dims]

    def ordinal(self) -> Column:
        """The row-major (C order) linear index."""
        out = F.lit(0).cast("bigint")
        for d, n in zip(self.dims, self.shape, strict=True):
            out = out * n + F.col(d)
        return out

    def with_df(self, df: DataFrame, **changes) -> ArrayFrame:
        fields = {"dims": self.dims, "shape": self.shape, "value": self.value, "fill": self.fill} | changes
        return ArrayFrame(df.select(*fields["dims"], fields["value"]), **fields)

    def with_value(self, column: Column) -> ArrayFrame:
        return self.with_df(self.df.select(*self.dims, column.alias(self.value)))

    def sorted(self) -> DataFrame:
        """Rows in C order."""
        return self.df.orderBy(*self.dims)


def from_nested(df: DataFrame, row: str, vector: str, shape: tuple[int, int], dims: tuple[str, str] = ("i0", "i1")) -> ArrayFrame:
    """A matrix from a table with a row number and an array column."""
    exploded = df.select(F.col(row).cast("bigint").alias(dims[0]), F.posexplode(vector).alias(dims[1], "v"))
    return ArrayFrame(exploded.select(dims[0], F.col(dims[1]).cast("bigint").alias(dims[1]), "v"), dims, shape)


def from_rows(df: DataFrame, row: str, value: Column | str, n: int, dim: str = "i0") -> ArrayFrame:
    """A vector from a table with a dense row number."""
    column = F.col(value) if isinstance(value, str) else value
    return ArrayFrame(df.select(F.col(row).cast("bigint").alias(dim), column.alias("v")), (dim,), (n,))


def full_grid(spark: SparkSession, dims: tuple[str, ...], shape: tuple[int, ...]) -> DataFrame:
    """Every coordinate once, generated where it is used: a range split by arithmetic."""
    out, columns = spark.range(prod(shape)), []
    below = 1
    for d, n in reversed(list(zip(dims, shape, strict=True))):
        columns.append((F.floor(F.col("id") / F.lit(below)) if below > (1 << 52) else F.expr(f"id div {below}")).cast("bigint").alias(d) if n else F.col("id").alias(d))
        below *= max(n, 1)
    named = dict(zip(reversed(dims), columns, strict=True))
    picked = [F.pmod(named[d], F.lit(max(n, 1))).cast("bigint").alias(d) for d, n in zip(dims, shape, strict=True)]
    return out.select(*picked)
