"""Block reductions and pyramids. Each is one aggregation with map-side partial sums; edge blocks use what they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import ArrayFrame


def _block(a: ArrayFrame, factors: tuple[int, ...]) -> tuple[list[Column], tuple[int, ...]]:
    if len(factors) != a.rank or min(factors) < 1:
        raise ValueError(f"{factors} are no factors for {a.rank} dimensions")
    columns = [F.expr(f"`{d}` div {f}").alias(d) for d, f in zip(a.dims, factors, strict=True)]
    return columns, tuple(-(-n // f) for n, f in zip(a.shape, factors, strict=True))


def _reduced(a: ArrayFrame, factors, value: Column) -> ArrayFrame:
    keys, shape = _block(a, factors)
    source = a.df.select(*keys, a.ordinal().alias("__at"), a.value)
    return a.with_df(source.groupBy(*a.dims).agg(value.alias(a.value)), shape=shape)


def block_mean(a: ArrayFrame, factors: tuple[int, ...], kind: str = "float") -> ArrayFrame:
    """Mean of each block.

    ``int``: integers of 4 bytes or fewer, halves rounded up; ``wide``: 64-bit integers, exactly; ``bool``: true if at
    least half is; ``float``: the double mean.
    """
    n = F.count(F.lit(1))
    if kind == "float":
        out = F.sum(a.v.cast("double")) / n
    elif kind == "int":
        twice = F.lit(2) * F.sum(a.v.cast("bigint")) + n
        out = F.call_function("div", twice - F.pmod(twice, F.lit(2) * n), F.lit(2) * n)
    elif kind == "wide":
        two = F.lit(2).cast("decimal(2,0)")
        total = F.sum(a.v.cast("decimal(20,0)")).cast("decimal(31,0)") * two + n.cast("decimal(20,0)")
        below = n.cast("decimal(19,0)") * two
        # floor of a quotient of decimals, without a rounded division: the remainder decides
        rest = total.cast("decimal(35,0)") % below.cast("decimal(35,0)")
        rest = F.when(rest < 0, rest + below.cast("decimal(35,0)")).otherwise(rest)
        out = ((total.cast("decimal(35,0)") - rest) / below.cast("decimal(20,0)")).cast("decimal(20,0)")
    elif kind == "bool":
        out = F.lit(2) * F.count_if(a.v) >= n
    else:
        raise ValueError(f"no block mean of kind {kind!r}")
    return _reduced(a, factors, out)


def block_nearest(a: ArrayFrame, factors: tuple[int, ...]) -> ArrayFrame:
    """The first element of each block."""
    return _reduced(a, factors, F.min_by(a.v, F.col("__at")))


def block_mode(a: ArrayFrame, factors: tuple[int, ...]) -> ArrayFrame:
    """The most frequent value of each block, the one seen first on ties."""
    keys, shape = _block(a, factors)
    source = a.df.select(*keys, a.ordinal().alias("__at"), a.value)
    each = source.groupBy(*a.dims, a.value).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    best = each.groupBy(*a.dims).agg(F.min_by(a.v, F.struct(-F.col("__n"), F.col("__first"))).alias(a.value))
    return a.with_df(best, shape=shape)


REDUCTIONS = {"nearest": block_nearest, "mode": block_mode, "mean": block_mean}


def pyramid_shapes(shape: tuple[int, ...], factors: tuple[int, ...], smallest: int = 64, levels: int | None = None) -> list[tuple[int, ...]]:
    """Shapes of the levels, full size first: until no scaled dimension exceeds ``smallest``, or ``levels`` of them."""
    out = [tuple(shape)]
    while (levels is None and any(n > smallest for n, f in zip(out[-1], factors, strict=True) if f > 1)) or (levels is not None and len(out) < levels):
        below = tuple(-(-n // f) for n, f in zip(out[-1], factors, strict=True))
        if below == out[-1]:
            break
        out.append(below)
    return out


def pyramid(a: ArrayFrame, factors: tuple[int, ...], method: str = "mean", smallest: int = 64, levels: int | None = None, **options) -> list[ArrayFrame]:
    """The levels of an image, each reduced from the one before."""
    out = [a]
    for _ in pyramid_shapes(a.shape, factors, smallest, levels)[1:]:
        out.append(REDUCTIONS[method](out[-1], factors, **options))
    return out


def pyramid_nearest(a: ArrayFrame, factors: tuple[int, ...], levels: int) -> DataFrame:
    """All levels of a nearest pyramid at once, with a ``level`` column: the first element of a block of blocks is the
    first of the whole block, so levels don't depend on each other and the scan is read once."""
    steps = F.array(*[F.struct(F.lit(k).alias("level"), *[F.lit(f**k).alias(f"f{i}") for i, f in enumerate(factors)]) for k in range(levels)])
    rows = a.df.select(*a.dims, a.value, a.ordinal().alias("__at"), F.explode(steps).alias("s"))
    keys = [F.expr(f"`{d}` div s.f{i}").alias(d) for i, d in enumerate(a.dims)]
    on_grid = F.lit(True)
    for i, d in enumerate(a.dims):
        on_grid = on_grid & F.expr(f"`{d}` % s.f{i} = 0")
    return rows.filter(on_grid).select(F.col("s.level").alias("level"), *keys, a.value)


def level_transform(pixel: tuple[float, ...], factors: tuple[int, ...], level: int, method: str) -> tuple[list[float], list[float]]:
    """Scale and translation of a level. Mean and mode lie at the middle of their block, nearest at its first pixel."""
    grown = [f**level for f in factors]
    scale = [p * g for p, g in zip(pixel, grown, strict=True)]
    shift = [0.0 if method == "nearest" else (g - 1) / 2 * p for p, g in zip(pixel, grown, strict=True)]
    return scale, shift


def all_fill_chunks(a: ArrayFrame, chunks: tuple[int, ...], fill: Column) -> DataFrame:
    """For each chunk whether it holds nothing but ``fill``."""
    keys, _ = _block(a, chunks)
    return a.df.select(*keys, a.v.eqNullSafe(fill).alias("same")).groupBy(*a.dims).agg(F.bool_and("same").alias("all_fill"))


def counts(a: ArrayFrame, chunks: tuple[int, ...]) -> dict[str, int]:
    """Elements and chunks, from metadata alone."""
    cells = 1
    for n, c in zip(a.shape, chunks, strict=True):
        cells *= -(-n // c)
    return {"elements": a.size, "chunks": cells if a.size else 0}


def storage_size(a: ArrayFrame, chunks: tuple[int, ...], item_bytes: int) -> DataFrame:
    """Raw bytes of each chunk's present elements."""
    keys, _ = _block(a, chunks)
    return a.df.select(*keys).groupBy(*a.dims).agg((F.count(F.lit(1)) * item_bytes).alias("bytes"))
