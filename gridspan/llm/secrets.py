"""Secret scan with corpus-wide ownership frequency.

Patterns give candidates in every text. The hash of each candidate's value is aggregated over the corpus by distinct
repositories and owners: a value that many owners have is a copied example, one that few have looks live.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, tidy

KINDS = ("assign", "access", "hex", "vendor", "pem", "live")
#: Fixed patterns of the three base kinds and of the added ones.
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
VENDOR = re.compile(r"(?:gh[pousr]_|xox[abprs]-|sk_live_|sk-|AIza|glpat-)[A-Za-z0-9_-]{16,}")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
#: An owner count from which a value is a copied example.
COPIED_OWNERS = 3


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """Spans (start, kind, end), and the places and values of candidates (start, end, value)."""
    spans, values = [], []
    for m in ASSIGN.finditer(text):
        if len(m[1]) >= 8:
            spans.append((m.start(), 0, m.end()))
            values.append((m.start(1), m.end(1), m[1]))
    for kind, pattern in ((1, ACCESS), (2, HEX), (3, VENDOR)):
        for m in pattern.finditer(text):
            if kind != 1 or len(m[0]) >= 16:
                spans.append((m.start(), kind, m.end()))
                values.append((m.start(), m.end(), m[0]))
    spans += [(m.start(), 4, m.end()) for m in PEM.finditer(text)]
    return sorted(spans), sorted(set(values))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(docs: DataFrame, *, owner_col: str = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Spans of secrets in every whole text, with what the corpus says about their values.

    A document is a repository, ``owner_col`` its owner (null is an owner of its own). A value that ``copied_owners`` owners
    or more have is a copied example; the values of fewer owners are live-looking, and ``spans`` marks them with the added
    kind ``live``. ``n_live`` and ``n_copied`` count a document's distinct values, ``most_owners`` and ``most_repositories``
    are the largest counts among them. ``spans`` has further kinds ``vendor`` (prefixed tokens) and ``pem``. A null or empty
    text has none; a null id stays null; repeated rows are all kept, as one repository if their ids are equal; an empty
    table gives no rows. A value that a large part of all documents hold is combined before the shuffle.
    """
    owner = F.col(owner_col).cast("string") if owner_col in docs.columns else F.lit(None).cast("string")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in part.column("text").to_pylist():
                    spans, values = scan(text) if text else ([], [])
                    base = [s for s in spans if s[1] < 3]
                    marks = [{"a": xxhash.xxh64_intdigest(v, 1) - (1 << 63), "b": xxhash.xxh64_intdigest(v, 2) - (1 << 63), "span": f"{i}:{j}"} for i, j, v in values]
                    out.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), marks))
                kinds = [*[pa.int64()] * 3, pa.string(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("span", pa.string())]))]
                made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("owner"), *made], names=names)

    schema = "doc_id long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, marks array<struct<a: long, b: long, span: string>>"
    names = ["doc_id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "marks"]
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"), F.col("text")).mapInArrow(tidy(run), schema)
    scanned = checkpointed(scanned.withColumn("row", F.monotonically_increasing_id()))

    each = scanned.filter(F.size("marks") > 0).select("row", "doc_id", "owner", F.explode("marks").alias("m")).select("row", "doc_id", "owner", "m.a", "m.b", "m.span")
    owners = each.groupBy("a", "b", "owner").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("owners"))
    repositories = each.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("repositories"))
    known = owners.join(repositories, ["a", "b"])
    judged = each.join(checkpointed(known), ["a", "b"]).withColumn("value", F.when(F.col("owners") < copied_owners, F.struct("a", "b"))).withColumn("other", F.when(F.col("owners") >= copied_owners, F.struct("a", "b")))
    of_row = judged.groupBy("row").agg(
        F.size(F.collect_set("value")).cast("long").alias("n_live"), F.size(F.collect_set("other")).cast("long").alias("n_copied"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"), F.collect_set(F.when(F.col("owners") < copied_owners, F.col("span"))).alias("live")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    start = lambda s: F.split(s, ":")[1].cast("int")
    all_spans = F.array_union(F.filter(F.split("spans", ","), lambda s: s != ""), F.transform("live", lambda s: F.concat(F.lit("live:"), s)))
    ordinal = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    ordered = F.array_sort(F.transform(all_spans, lambda s: F.struct(start(s).alias("at"), ordinal[F.split(s, ":")[0]].alias("kind"), F.split(s, ":")[2].cast("int").alias("end"), s.alias("s"))))
    spans = F.when(F.size("live") > 0, F.array_join(F.transform(ordered, lambda x: x["s"]), ",")).otherwise(F.col("spans"))
    done = scanned.drop("marks").join(of_row, "row", "left")
    return done.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), *map(zero, ("n_live", "n_copied", "most_owners", "most_repositories")))
