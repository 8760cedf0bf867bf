"""Corpus-wide line deduplication with DataFrame functions alone.

Lines are normalised and hashed (128 bits), the documents of each hash are counted with map-side combining, and the
positions to drop go back to their documents; the text itself moves once, to meet its document's dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = " \t\n\x0b\x0c\r"
LEAST_LENGTH, LEAST_DOCS = 20, 3


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def dedup_lines(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``row`` (the input row as a struct), ``n_lines``, ``n_dropped`` and ``kept`` (the text that is left) of every row.

    A key of ``least_length`` code points or more that at least ``least_docs`` documents (distinct ids; all rows with a null
    id are one) hold loses its lines everywhere but in the rows with the largest id holding it (a null id is smaller than
    any). A null or empty text is one empty line. An empty table gives no rows; columns of any other name stay untouched in
    ``row``.
    """
    base = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.withColumn("digest", F.xxhash64("text"))
    lines = F.split(F.col("text"), "\n")
    long_enough = lambda h: h.isNotNull()
    hashes = F.transform(F.transform(lines, line_key), lambda k: F.when(F.char_length(k) >= least_length, key_hash(k)))

    each = base.select("id", F.explode(F.array_distinct(F.filter(hashes, long_enough))).alias("h"))
    n = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
    shared = each.groupBy("h.a", "h.b").agg(n.alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= least_docs).select("a", "b", "keeper")
    shared = checkpointed(shared)  # a side of its own exchange: adaptive execution can then split a hot key of the other side

    at = base.select("id", "digest", F.posexplode(hashes).alias("pos", "h")).filter(F.col("h").isNotNull()).select("id", "digest", "pos", "h.a", "h.b")
    dropped = at.join(shared, ["a", "b"]).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    dropped = dropped.groupBy(F.col("id").alias("of_id"), F.col("digest").alias("of_digest")).agg(F.collect_list("pos").alias("positions"))

    joined = base.join(dropped, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left")
    n = F.size(lines)
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce(F.col("positions"), F.array().cast("array<int>")))
    split = joined.select("row", lines.alias("lines"), left.alias("left"), F.col("positions").isNull().alias("whole"), "text")
    kept = F.when(F.col("whole"), F.col("text")).otherwise(F.array_join(F.transform("left", lambda i: F.col("lines")[i]), "\n"))
    return split.select("row", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"), kept.alias("kept"))
