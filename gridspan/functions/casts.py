"""Value casts with a rounding mode, an out-of-range rule and a scalar map, and numeric element filters.

The float64 and integer cases are expressions and stay in generated code. Narrow floats need arithmetic in the source
precision, so they go through Arrow batches of numpy.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doubles from here on are whole; the weight of a number's upper half.
WHOLE, HALF = 2.0**53, 2.0**32
ROUNDINGS = ("nearest-even", "towards-zero", "towards-positive", "towards-negative", "nearest-away")
RANGES = {f"int{b}": (-(1 << (b - 1)), (1 << (b - 1)) - 1) for b in (8, 16, 32, 64)} | {f"uint{b}": (0, (1 << b) - 1) for b in (8, 16, 32, 64)}


def spark_type(name: str) -> str:
    """The Spark type that holds every value of an element type."""
    return {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double", "bool": "boolean"}[name]


def rounded(v: Column, rounding: str = "nearest-even") -> Column:
    """A double rounded to a whole number, still a double."""
    v = v.cast("double")
    down = F.floor(F.abs(v)).cast("double")
    ways = {
        "nearest-even": F.rint(v),
        "towards-zero": F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double"),
        "towards-positive": F.ceil(v).cast("double"),
        "towards-negative": F.floor(v).cast("double"),
        "nearest-away": F.signum(v) * (down + F.when(F.abs(v) - down >= 0.5, 1.0).otherwise(0.0)),
    }
    if rounding not in ways:
        raise ValueError(f"no rounding {rounding!r}")
    return F.when(F.abs(v) >= WHOLE, v).otherwise(ways[rounding])


def whole_decimal(w: Column) -> Column:
    """A whole double below 2^95 as a decimal, exactly: its text has 17 digits only, its two halves are whole numbers."""
    high = F.floor(w / HALF)
    low = (w - high.cast("double") * HALF).cast("bigint")
    return (high.cast("decimal(20,0)") * F.lit(Decimal(int(HALF))).cast("decimal(10,0)") + low.cast("decimal(20,0)")).cast("decimal(38,0)")


def cast_value(v: Column, target: str, *, source: str = "float64", rounding: str = "nearest-even", out_of_range: str = "error", scalar_map: list[tuple[object, object]] | None = None) -> Column:
    """An integer or float64 value as an integer type.

    The scalar map comes first, its first entry for a value wins, and a NaN key takes any NaN. NaN can't be cast, and
    infinities can't be wrapped. ``out_of_range``: ``error``, ``clamp`` or ``wrap`` (the low bits).
    """
    if out_of_range not in ("error", "clamp", "wrap"):
        raise ValueError(f"no rule {out_of_range!r}")
    low, high = RANGES[target]
    kind = spark_type(target)
    least, most, span = (F.lit(Decimal(x)).cast("decimal(38,0)") for x in (low, high, high - low + 1))
    if source.startswith("float"):
        whole = rounded(v, rounding)
        bottom, top = F.lit(float(low)), F.lit(float(high) if int(float(high)) <= high else math.nextafter(float(high), 0))
        bad = F.isnan(v)
        if out_of_range == "clamp":
            out = F.when(whole > top, most).when(whole < bottom, least).otherwise(whole_decimal(F.least(F.greatest(whole, bottom), top)))
        elif out_of_range == "wrap":
            bad = bad | (F.abs(v) == math.inf)
            rest = whole_decimal(F.when(bad, 0.0).otherwise(whole) % F.lit(float(high - low + 1)))  # a remainder of doubles is exact
            low_bits = F.when(rest < 0, rest + span).otherwise(rest)
            out = F.when(low_bits > most, low_bits - span).otherwise(low_bits)
        else:
            bad = bad | (whole < bottom) | (whole > top)
            out = whole_decimal(F.when(bad, 0.0).otherwise(whole))
    else:
        exact, bad = v.cast("decimal(38,0)"), F.lit(False)
        if out_of_range == "clamp":
            out = F.least(F.greatest(exact, least), most)
        elif out_of_range == "wrap":
            out = F.pmod(exact - least, span) + least
        else:
            bad = (exact < least) | (exact > most)
            out = exact
    out = F.when(bad, F.raise_error(F.concat(F.lit(f"not a value of {target}: "), v.cast("string")))).otherwise(out).cast(kind)
    cases = None
    for key, value in scalar_map or ():
        hit = F.isnan(v) if isinstance(key, float) and math.isnan(key) else v == F.lit(key)
        cases = F.when(hit, F.lit(value).cast(kind)) if cases is None else cases.when(hit, F.lit(value).cast(kind))
    return out if cases is None else cases.otherwise(out)


def mapped(key: object) -> float | int:
    """A number of a scalar map; JSON has some as texts."""
    return float(key.replace("Infinity", "inf")) if isinstance(key, str) else key


def cast_array(x: np.ndarray, target: str, rounding: str = "nearest-even", out_of_range: str = "error", pairs=()) -> np.ndarray:
    """``cast_value`` and ``cast_float`` for numpy arrays of any numeric type."""
    if out_of_range not in ("error", "clamp", "wrap") or rounding not in ROUNDINGS:
        raise ValueError(f"no rule {out_of_range!r}, {rounding!r}")
    taken, given = np.zeros(x.shape, bool), np.zeros(x.shape, target)
    for key, value in ((mapped(k), mapped(v)) for k, v in pairs):
        hit = ~taken & (np.isnan(x) if key != key else x == key)
        given[hit], taken = value, taken | hit
    rest = np.where(taken, x.dtype.type(0), x)
    kind = np.dtype(target)
    if kind.kind == "f":
        narrower = rest.dtype.kind == "f" and rest.dtype.itemsize > kind.itemsize
        return np.where(taken, given, narrow_float(rest, target, rounding, out_of_range) if narrower else rest.astype(target))
    low, high = RANGES[target]
    if rest.dtype.kind == "f":
        v = rest.astype(np.float64)
        finite = np.where(np.isfinite(v), v, 0.0)
        t = np.trunc(finite)
        away = t + np.copysign(np.abs(finite - t) >= 0.5, finite)
        whole = {"nearest-even": np.rint(v), "towards-zero": np.trunc(v), "towards-positive": np.ceil(v), "towards-negative": np.floor(v), "nearest-away": np.where(np.isfinite(v), away, v)}[rounding]
        over, under = whole >= float(high + 1), whole < float(low)
        bad = np.isnan(v) | (np.isinf(v) if out_of_range == "wrap" else (over | under) & (out_of_range == "error"))
        inside = np.fmod(np.where(np.isfinite(whole), whole, 0.0), 2.0**64)
        upper = np.floor(inside / HALF)
        bits = (upper.astype(np.int64).astype(np.uint64) << np.uint64(32)) + (inside - upper * HALF).astype(np.uint64)
        out = bits.astype(target)
        if out_of_range == "clamp":
            out = np.where(over, np.array(high, target), np.where(under, np.array(low, target), out))
    else:
        own = RANGES.get(rest.dtype.name, (0, 1))
        clamped = np.clip(rest, max(low, own[0]), min(high, own[1]))
        bad = (clamped != rest) & (out_of_range == "error")
        out = (clamped if out_of_range == "clamp" else rest).astype(target)
    if (bad & ~taken).any():
        raise OverflowError(f"not a value of {target}: {x[bad & ~taken][0]}")
    return np.where(taken, given, out)


def narrow_float(x: np.ndarray, target: str, rounding: str = "nearest-even", out_of_range: str = "error") -> np.ndarray:
    """Floats in a narrower float type. NaN and signed zero stay; a finite value that becomes infinite is an error unless
    clamped; modes other than nearest step one unit where the nearest lies on the wrong side."""
    with np.errstate(over="ignore"):
        y = x.astype(target)
    back = y.astype(x.dtype)
    if rounding != "nearest-even":
        up, down = np.nextafter(y, np.array(np.inf, target)), np.nextafter(y, np.array(-np.inf, target))
        if rounding == "towards-positive":
            y = np.where(back < x, up, y)
        elif rounding == "towards-negative":
            y = np.where(back > x, down, y)
        elif rounding == "towards-zero":
            y = np.where((x > 0) & (back > x), down, np.where((x < 0) & (back < x), up, y))
        elif rounding == "nearest-away":
            other = np.where(x > 0, up, down)
            tie = np.abs(x - back) == np.abs(other.astype(x.dtype) - x)
            y = np.where(tie & (np.abs(back) < np.abs(x)), other, y)
        else:
            raise ValueError(f"no rounding {rounding!r}")
    lost = np.isfinite(x) & ~np.isfinite(y)
    if lost.any():
        if out_of_range != "clamp":
            raise OverflowError(f"{x[lost][0]} is out of the range of {target}")
        limit = np.finfo(target).max
        y = np.where(lost, np.copysign(limit, x), y)
    return y.astype(target)


def cast_float(v: Column, target: str, rounding: str = "nearest-even", out_of_range: str = "error") -> Column:
    """A float64 column as float32 or float16 values."""

    @F.pandas_udf("float")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(narrow_float(x.to_numpy(np.float64), target, rounding, out_of_range).astype(np.float32))

    return run(v)


def astype(v: Column, source: str, target: str) -> Column:
    """A numpy cast: integers wrap, floats truncate first, anything but zero is true."""
    if target == "bool":
        return v != 0
    if target.startswith("float"):
        return v.cast(spark_type(target))
    return cast_value(v, target, source=source, rounding="towards-zero", out_of_range="wrap")


def store_exactly(v: Column, target: str) -> Column:
    """A value that the type holds exactly, or an error; null stays null."""
    if target == "bool":
        return (v != 0) | F.isnan(v)
    low, high = RANGES[target]
    no = F.raise_error(F.concat(F.lit(f"{target} can't hold "), v.cast("string")))
    d = v.cast("double")
    inside = (d == rounded(d)) & (d >= float(low)) & (d < float(high + 1))  # both ends are powers of two, or zero
    of_float = F.when(inside, whole_decimal(F.when(inside, d).otherwise(0.0))).otherwise(no)
    exact = v.cast("decimal(38,0)")
    of_whole = F.when((exact == v) & exact.between(Decimal(low), Decimal(high)), exact).otherwise(no)
    return F.when(v.isNotNull(), F.when(F.typeof(v).isin("float", "double"), of_float).otherwise(of_whole)).cast(spark_type(target))


def promoted(a: str, b: str) -> str:
    """The common type of two element types, as numpy has it."""
    return np.promote_types(a, b).name


def unsigned_double(v: Column) -> Column:
    return v.cast("decimal(20,0)").cast("double")


def fixed_scale_encode(v: Column, offset: float, scale: float) -> Column:
    return F.rint((v - F.lit(float(offset))) * F.lit(float(scale)))


def fixed_scale_decode(v: Column, offset: float, scale: float) -> Column:
    return v / F.lit(float(scale)) + F.lit(float(offset))


def quantize(v: Column, digits: int) -> Column:
    """The value at a precision of so many decimal digits, in steps of a power of two."""
    step = F.lit(2.0 ** math.ceil(math.log2(10.0**digits)))
    return F.rint(v * step) / step


def round_bits(x: np.ndarray, keep: int) -> np.ndarray:
    """Floats with ``keep`` mantissa bits, ties to even; NaN and infinities stay."""
    bits = {2: 10, 4: 23, 8: 52}[x.itemsize]
    if not 0 <= keep <= bits:
        raise ValueError(f"{x.dtype} has {bits} mantissa bits, not {keep}")
    drop = bits - keep
    if not drop:
        return x.copy()
    kind = np.dtype(f"u{x.itemsize}").type
    raw = x.view(kind)
    half = kind((1 << (drop - 1)) - 1)
    even = (raw >> kind(drop)) & kind(1)
    out = ((raw + half + even) & ~kind((1 << drop) - 1)).view(x.dtype)
    return np.where(np.isfinite(x), out, x)


def bit_round(v: Column, keep: int, kind: str = "float64") -> Column:
    @F.pandas_udf("double" if kind == "float64" else "float")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(round_bits(x.to_numpy(kind), keep))

    return run(v)
