"""Text of values: strings of fixed width, times, numbers, CSV and JSON rows, and attribute JSON."""

from __future__ import annotations

import base64
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import ArrayFrame

#: Seconds of the time units that have a constant length.
UNIT_SECONDS = {"W": 604_800, "D": 86_400, "h": 3_600, "m": 60, "s": 1}
UNIT_PARTS = {"ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}
NAT = -(2**63)


def fixed_string(s: Column, padded_by_space: bool = False) -> Column:
    """A fixed-width string as far as its first NUL; with space padding also without blanks at the end."""
    out = F.substring_index(s, "\0", 1)
    return F.regexp_replace(out, " +$", "") if padded_by_space else out


def shape_text(shape: tuple[int, ...]) -> str:
    return f"({shape[0]},)" if len(shape) == 1 else f"({', '.join(map(str, shape))})"


def bytes_text(n: int) -> str:
    """A size in binary units with one decimal."""
    size, unit = float(n), "B"
    for unit in ("B", "KiB", "MiB", "GiB", "TiB", "PiB"):
        if size < 1024 or unit == "PiB":
            break
        size /= 1024
    return f"{n} B" if unit == "B" else f"{size:.1f} {unit}"


def number_text(v: Column) -> Column:
    return F.when(F.isnan(v.cast("double")), "NaN").when(v.cast("double") == math.inf, "Infinity").when(v.cast("double") == -math.inf, "-Infinity").otherwise(v.cast("string"))


def bytes_value_text(v: Column) -> Column:
    """Printable ASCII bytes as a quoted byte string, others as base64."""
    s = F.decode(v, "ISO-8859-1")
    quoted = F.concat(F.lit('b"'), F.regexp_replace(s, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.when(s.rlike(r"^[\x20-\x7e]*$"), quoted).otherwise(F.base64(v))


def csv_field(s: Column) -> Column:
    """Quoted where it holds a comma, a quote, a line end, or a blank at either end."""
    risky = s.rlike(r'[",\r\n]|^ | $')
    return F.when(risky, F.concat(F.lit('"'), F.regexp_replace(s, '"', '""'), F.lit('"'))).otherwise(s)


def time_text(v: Column, unit: str) -> Column:
    """ISO text of a count of a unit since 1970; not-a-time is null. Years and months count calendar steps."""
    epoch = F.lit("1970-01-01").cast("date")
    if unit == "Y":
        out = F.date_format(F.add_months(epoch, (v * 12).cast("int")), "yyyy")
    elif unit == "M":
        out = F.date_format(F.add_months(epoch, v.cast("int")), "yyyy-MM")
    elif unit in ("D", "W"):
        out = F.date_format(F.date_add(epoch, (v * (7 if unit == "W" else 1)).cast("int")), "yyyy-MM-dd")
    elif unit in UNIT_SECONDS:
        at = F.timestamp_seconds(v * UNIT_SECONDS[unit])
        out = F.date_format(at, {"h": "yyyy-MM-dd'T'HH", "m": "yyyy-MM-dd'T'HH:mm", "s": "yyyy-MM-dd'T'HH:mm:ss"}[unit])
    elif unit in UNIT_PARTS:
        part = UNIT_PARTS[unit]
        rest = F.pmod(v, F.lit(part).cast("bigint"))
        second = ((v - rest).cast("decimal(20,0)") / F.lit(part)).cast("bigint")
        rest = F.lpad(rest.cast("string"), len(str(part)) - 1, "0")
        out = F.concat(F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), rest)
    else:
        return v.cast("string")  # finer counts stay counts
    return F.when(v != NAT, out)


def unix_time(v: Column) -> Column:
    return F.timestamp_seconds(v)


def dump_lines(a: ArrayFrame, form: str = "csv") -> DataFrame:
    """One line for each row of the last dimension, labelled by the coordinates before it, in C order.

    ``csv``: fields; ``json``: arrays; ``text``: bracketed rows. A line is gathered by its own row, so a task holds rows,
    never the array.
    """
    keys, last = list(a.dims[:-1]), a.dims[-1]
    value = a.v.cast("string") if form != "json" else a.v
    row = F.transform(F.array_sort(F.collect_list(F.struct(F.col(last).alias("k"), value.alias("x")))), lambda s: s["x"])
    rows = a.df.groupBy(*keys).agg(row.alias("row")) if keys else a.df.agg(row.alias("row"))
    if form == "csv":
        line = F.array_join(F.transform("row", csv_field), ",")
    elif form == "json":
        line = F.to_json("row")
    elif form == "text":
        line = F.concat(F.lit("["), F.array_join("row", " "), F.lit("]"))
    else:
        raise ValueError(f"no form {form!r}")
    out = rows.select(*keys, line.alias("line"))
    return out.orderBy(*keys) if keys else out


def merge_attributes(left: Column, right: Column) -> Column:
    """Two JSON maps as one; the right one wins."""
    kind = "map<string,string>"
    a, b = (F.coalesce(F.from_json(c, kind), F.create_map().cast(kind)) for c in (left, right))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def fill_to_json(value, kind: str):
    """A fill value as its JSON form: tokens for NaN and infinities, pairs for complex numbers, base64 for bytes."""
    if kind.startswith("complex"):
        return [fill_to_json(float(value.real), "float64"), fill_to_json(float(value.imag), "float64")]
    if kind.startswith("float"):
        return "NaN" if math.isnan(value) else "Infinity" if value == math.inf else "-Infinity" if value == -math.inf else float(value)
    if kind == "bool":
        return bool(value)
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(bytes(value)).decode()
    return value if isinstance(value, str) else int(value)


def fill_from_json(value, kind: str):
    import numpy as np

    if kind.startswith("complex"):
        return complex(fill_from_json(value[0], "float64"), fill_from_json(value[1], "float64"))
    if kind.startswith("float"):
        if isinstance(value, str) and value.startswith("0x"):
            width = {"float16": 2, "float32": 4, "float64": 8}[kind]
            return float(np.frombuffer(int(value, 16).to_bytes(width, "little"), f"<f{width}")[0])
        return float({"Infinity": "inf", "-Infinity": "-inf"}.get(value, value))
    if kind == "bool":
        if not isinstance(value, bool):
            raise ValueError(f"no boolean fill value: {value!r}")
        return value
    if kind.startswith("r") and isinstance(value, list):
        return bytes(value)
    return value if isinstance(value, str) else int(value)


def pretty(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)
