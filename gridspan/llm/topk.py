"""Exact maximum inner product search by norm buckets.

Each worker sorts its vectors by length and cuts them into buckets. A query's k-th best score so far, divided by its own
length and a bucket's largest length, is the cosine that a bucket's vectors must reach. Above 1 the bucket is skipped;
when it is high, one strong coordinate of the query bounds the vectors that can reach it; else the shorter vectors of the
bucket are cut off by length. What is left is verified by exact integer products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Queries that are broadcast together (expected; they are dealt by a hash), vectors of a bucket.
BLOCK, BUCKET = 4096, 256
#: Local cosine from which a bucket is searched by coordinate.
BY_COORDINATE = 0.5
EXACT = 2.0**53
LONG = (-(2**63), 2**63 - 1)


def quantised(column: pa.Array) -> list[np.ndarray | None]:
    """floor(256 x) of each vector; None for vectors that take no part."""
    out = []
    for value in column:
        v = value.values if value.is_valid else None
        if v is None or v.null_count or not len(v):
            out.append(None)
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(np.asarray(v, np.float64) * 256)
        out.append(x if np.isfinite(x).all() else None)
    return out


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Infinite where a square is beyond a double; such vectors are always compared."""
    with np.errstate(over="ignore"):
        return np.sqrt((vectors**2).sum(axis=1))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits the nearest long."""
    with np.errstate(over="ignore"):
        small = len(q) == 0 or len(v) == 0 or np.abs(q).max() * np.abs(v).max() * q.shape[1] < EXACT
    if small:
        return (q @ v.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q) @ whole(v).T, *LONG).astype(np.int64)


class Best:
    """The k best of each query: higher score first, then the smaller id."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.marks, self.vectors, self.k = ids, marks, vectors, k
        self.length = lengths(vectors)
        self.score = np.full((len(ids), k), LONG[0], np.int64)
        self.of = np.full((len(ids), k), LONG[1], np.int64)
        self.found = np.zeros((len(ids), k), bool)
        self.least = np.full(len(ids), LONG[0], np.int64) if least is None else least.copy()

    def offer(self, rows: np.ndarray, ids: np.ndarray, marks: np.ndarray, score: np.ndarray, allowed: np.ndarray) -> None:
        """``score`` and ``allowed``: of queries ``rows`` and vectors ``ids``, the ids ascending. A query's own row is not taken."""
        own = (self.ids[rows][:, None] == ids[None]) & (self.marks[rows][:, None] == marks[None])
        allowed &= ~own & (score >= self.least[rows][:, None])
        some = allowed.any(axis=1)
        if not some.any():
            return
        rows, score, allowed = rows[some], score[some], allowed[some]
        rank = np.where(allowed, ~score, LONG[1])  # ~x orders as -x does, without overflow
        best = np.argsort(rank, axis=1, kind="stable")[:, : self.k]
        pick = np.take_along_axis
        found = np.concatenate([self.found[rows], pick(allowed, best, 1)], axis=1)
        score = np.concatenate([self.score[rows], pick(score, best, 1)], axis=1)
        of = np.concatenate([self.of[rows], ids[best]], axis=1)
        order = np.lexsort((of, ~score, ~found), axis=1)[:, : self.k]
        self.found[rows], self.score[rows], self.of[rows] = pick(found, order, 1), pick(score, order, 1), pick(of, order, 1)
        full = self.found[rows].all(axis=1)
        self.least[rows[full]] = np.maximum(self.least[rows[full]], self.score[rows[full], -1])

    def search(self, ids: np.ndarray, marks: np.ndarray, vectors: np.ndarray) -> None:
        length = lengths(vectors)
        order = np.argsort(-length, kind="stable")
        for low in range(0, len(order), BUCKET):
            at = order[low : low + BUCKET]
            longest = length[at[0]]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                local = np.nan_to_num(self.least / (self.length * longest), posinf=np.inf, neginf=-np.inf)
            zero = (self.length == 0) | (longest == 0)
            alive = np.flatnonzero(np.where(zero, self.least <= 0, local <= 1 + 1e-9))
            if not len(alive):
                continue
            at = at[np.argsort(ids[at], kind="stable")]
            by_coordinate = alive[(local[alive] >= BY_COORDINATE) & ~zero[alive]]
            by_length = np.setdiff1d(alive, by_coordinate, assume_unique=True)
            if len(by_length):
                q = self.vectors[by_length]
                with np.errstate(invalid="ignore", over="ignore"):
                    most = self.length[by_length][:, None] * length[at][None] * (1 + 1e-9)
                reach = ~(most < self.least[by_length][:, None])
                some = reach.any(axis=0)
                self.offer(by_length, ids[at[some]], marks[at[some]], products(q, vectors[at[some]]), reach[:, some])
            if len(by_coordinate):
                q = self.vectors[by_coordinate]
                focus = np.abs(q).argmax(axis=1)
                qf = q[np.arange(len(q)), focus] / self.length[by_coordinate]
                with np.errstate(divide="ignore", invalid="ignore"):
                    vf = np.nan_to_num(vectors[at][:, focus].T / length[at][None])
                rest = np.sqrt(np.clip(1 - qf**2, 0, 1))[:, None] * np.sqrt(np.clip(1 - vf**2, 0, 1))
                reach = (qf[:, None] * vf + rest) * (self.length[by_coordinate][:, None] * length[at][None]) * (1 + 1e-9) + 1e-6 >= self.least[by_coordinate][:, None]
                rows, columns = reach.any(axis=1), reach.any(axis=0)
                if rows.any():
                    self.offer(by_coordinate[rows], ids[at[columns]], marks[at[columns]], products(q[rows], vectors[at[columns]]), reach[rows][:, columns])


def top_k(vectors: DataFrame, *, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` best of every query, over all rows.

    Queries are the rows whose id is divisible by ``query_every``; a query is compared with every other row of its own
    number of components, so that rows which repeat an id are queries and candidates each. Null ids, and vectors that are
    null, empty or hold a null or non-finite component (or one that 256 times it is not finite), take no part. Ties go to the
    smaller id. An empty table, or one without queries, gives no rows. Queries are broadcast in blocks of about BLOCK.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    rows = rows.withColumn("mark", F.xxhash64("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256) < float("inf")))
    chosen = rows.filter((F.col("id") % query_every == 0) & finite & (F.size("v") > 0)).groupBy("id", "mark").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("times"))
    blocks = -(-chosen.count() // BLOCK)
    schema = "query_id long, mark long, times long, vec_id long, score long"
    found = None
    for block in range(blocks):
        got = chosen.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()
        sizes: dict[int, tuple] = {}
        copies = []
        for n in {len(r["v"]) for r in got}:
            own = sorted((r["id"], r["mark"], r["v"], r["times"]) for r in got if len(r["v"]) == n)
            ids, marks, times = (np.array([r[i] for r in own], np.int64) for i in (0, 1, 3))
            q = np.floor(np.array([r[2] for r in own], np.float64) * 256)
            warm = Best(ids, marks, q, k)  # the block's own vectors give a first bound
            warm.search(ids, marks, q)
            sizes[n] = (ids, marks, times, q, warm.least)
            for i in np.flatnonzero(times > 1).tolist():  # rows equal in id and vector are each other's candidates
                copies += [(*(int(x[i]) for x in (ids, marks, times, ids)), int(products(q[i : i + 1], q[i : i + 1])[0, 0]))] * min(int(times[i]) - 1, k)
        sent = spark.sparkContext.broadcast(sizes)

        def run(batches, sent=sent):
            best = {n: Best(ids, marks, q, k, least) for n, (ids, marks, _, q, least) in sent.value.items()}
            for batch in batches:
                ids, marks = np.asarray(batch.column("id")), np.asarray(batch.column("mark"))
                made = quantised(batch.column("v"))
                for n, b in best.items():
                    own = [i for i, x in enumerate(made) if x is not None and len(x) == n]
                    if own:
                        b.search(ids[own], marks[own], np.array([made[i] for i in own]))
            for n, b in best.items():
                q, j = np.nonzero(b.found)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.ids[q], b.marks[q], sent.value[n][2][q], b.of[q, j], b.score[q, j])], names=["query_id", "mark", "times", "vec_id", "score"])

        part = rows.mapInArrow(tidy(run), schema)
        if copies:
            part = part.union(spark.createDataFrame(copies, schema))
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    one = F.struct(F.bitwise_not("score").alias("minus"), F.col("vec_id"), F.col("score"))
    ranked = found.groupBy("query_id", "mark").agg(F.max("times").alias("times"), F.slice(F.sort_array(F.collect_list(one)), 1, k).alias("best"))
    each = ranked.select("query_id", "best", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return each.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
