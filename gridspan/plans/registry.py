"""The registered queries of the array engine over the given tables, with equivalent SQL.

``embeddings`` is a matrix (vector by component), ``part`` and ``events`` are vectors by their dense keys. Queries run
over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..array import ArrayFrame, from_nested, from_rows
from ..functions import casts, chunks, text
from ..functions import transforms as tf
from ..operators import assemble, order, projection, reduce, selection, sequence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WIDTH = 64


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    df = table(spark, sf_dir, "embeddings")
    return from_nested(df, "vec_id", "embedding", (df.count(), WIDTH))


def parts(spark: SparkSession, sf_dir: str, value="p_size") -> ArrayFrame:
    df = table(spark, sf_dir, "part")
    return from_rows(df, "p_partkey", value, df.count())


def events(spark: SparkSession, sf_dir: str, value="value") -> ArrayFrame:
    df = table(spark, sf_dir, "events")
    return from_rows(df, "event_id", value, df.count())


MATRIX = "(SELECT vec_id AS i0, unnest(range(len(embedding))) AS i1, unnest(embedding) AS v FROM embeddings)"


# Selections


@query(f"SELECT (i0 - 10) // 7 AS i0, (i1 - 3) // 5 AS i1, v FROM {MATRIX} WHERE i0 >= 10 AND (i0 - 10) % 7 = 0 AND (i0 - 10) // 7 < 60 AND i1 >= 3 AND (i1 - 3) % 5 = 0 AND (i1 - 3) // 5 < 12")
def hyperslab_strided(spark, sf_dir):
    return selection.hyperslab(matrix(spark, sf_dir), (10, 3), (60, 12), (7, 5)).df


@query(f"SELECT (i0 // 5) * 2 + i0 % 5 AS i0, ((i1 - 4) // 10) * 3 + (i1 - 4) % 10 AS i1, v FROM {MATRIX} WHERE i0 % 5 < 2 AND i0 // 5 < 90 AND i1 >= 4 AND (i1 - 4) % 10 < 3 AND (i1 - 4) // 10 < 6")
def hyperslab_blocks(spark, sf_dir):
    return selection.hyperslab(matrix(spark, sf_dir), (0, 4), (90, 6), (5, 10), (2, 3)).df


@query(f"SELECT i0 - 100 AS i0, i1 - 8 AS i1, v FROM {MATRIX} WHERE i0 >= 100 AND i0 < 300 AND i1 >= 8 AND i1 < 40")
def box(spark, sf_dir):
    return selection.box(matrix(spark, sf_dir), (100, 8), (200, 32)).df


@query(f"SELECT (i0 - 20) // 4 AS i0, v FROM {MATRIX} WHERE i0 >= 20 AND i0 < 480 AND (i0 - 20) % 4 = 0 AND i1 = 63")
def slice_numpy(spark, sf_dir):
    return selection.slice_text(matrix(spark, sf_dir), "20:480:4,-1").df


POINTS = [(3, 5), (499, 63), (0, 0), (3, 5), (250, 31)]


@query(f"SELECT k::BIGINT AS k, v FROM (VALUES (0, 3, 5), (1, 499, 63), (2, 0, 0), (3, 3, 5), (4, 250, 31)) AS p(k, i0, i1) JOIN {MATRIX} AS m USING (i0, i1)")
def points(spark, sf_dir):
    return selection.points(matrix(spark, sf_dir), POINTS)


@query(f"SELECT i0, i1, v FROM {MATRIX} WHERE NOT (i0 >= 50 AND i0 < 450 AND i1 >= 10 AND i1 < 60)")
def box_difference(spark, sf_dir):
    return selection.box_difference(matrix(spark, sf_dir), (50, 10), (400, 50)).df


@query(f"SELECT i0 - 120 AS i0, i1 - 16 AS i1, v FROM {MATRIX} WHERE i0 >= 120 AND i0 < 200 AND i1 >= 16 AND i1 < 40")
def box_intersection(spark, sf_dir):
    offset, count = selection.box_intersection((100, 16), (100, 48), (120, 0), (300, 40))
    return selection.box(matrix(spark, sf_dir), offset, count).df


@query(f"SELECT (i0 // 100) AS c0, (i1 // 16) AS c1, count(*)::BIGINT AS n FROM {MATRIX} WHERE i0 >= 130 AND i0 < 350 AND i1 >= 20 AND i1 < 50 GROUP BY ALL")
def chunk_pruning(spark, sf_dir):
    a = matrix(spark, sf_dir)
    near = chunks.overlapped((130, 20), (220, 30), (100, 16))
    cells = a.df.select("*", chunks.regular(F.col("i0"), 100).alias("c0"), chunks.regular(F.col("i1"), 16).alias("c1"))
    cells = cells.filter(F.col("c0").between(near[0].start, near[0].stop - 1) & F.col("c1").between(near[1].start, near[1].stop - 1))
    return cells.filter("i0 >= 130 and i0 < 350 and i1 >= 20 and i1 < 50").groupBy("c0", "c1").agg(F.count(F.lit(1)).alias("n"))


# Projections


@query(f"SELECT i1 AS i0, i0 AS i1, v FROM {MATRIX}")
def transpose(spark, sf_dir):
    return projection.transpose(matrix(spark, sf_dir), (1, 0)).df


@query(f"SELECT (i0 * 64 + i1) // 32 AS i0, (i0 * 64 + i1) % 32 AS i1, v FROM {MATRIX}")
def reshape(spark, sf_dir):
    return projection.reshape(matrix(spark, sf_dir), (-1, 32)).df


@query(f"SELECT i0, v FROM {MATRIX} WHERE i1 = 7")
def squeeze(spark, sf_dir):
    return projection.squeeze(matrix(spark, sf_dir), "i1", 7).df


@query("SELECT p_partkey AS i0, p_retailprice AS v FROM part")
def member(spark, sf_dir):
    return projection.member(parts(spark, sf_dir, F.struct("p_size", F.struct("p_retailprice").alias("money"))), "money.p_retailprice").df


@query("SELECT p_partkey AS i0, p_size, p_brand FROM part")
def compound_columns(spark, sf_dir):
    return projection.columns_of(parts(spark, sf_dir, F.struct("p_size", "p_brand")))


@query("SELECT p_partkey AS i0, unnest([0, 1])::BIGINT AS i1, unnest([p_size, p_size * 2])::INTEGER AS v FROM part")
def array_elements(spark, sf_dir):
    return projection.array_dimension(parts(spark, sf_dir, F.array(F.col("p_size"), F.col("p_size") * 2)), 2, "i1").df


@query("SELECT event_id AS i0, CASE user_id % 3 WHEN 0 THEN 'RED' WHEN 1 THEN 'GREEN' END AS v FROM events")
def enum_names(spark, sf_dir):
    return projection.names_of(events(spark, sf_dir, (F.col("user_id") % 3).cast("int")), {0: "RED", 1: "GREEN"}).df


@query("SELECT event_id AS i0, CASE WHEN user_id - 75 < 0 THEN (user_id - 75)::HUGEINT + 18446744073709551616 ELSE (user_id - 75)::HUGEINT END::VARCHAR AS v FROM events")
def exact_unsigned(spark, sf_dir):
    return events(spark, sf_dir, projection.exact_unsigned(F.col("user_id") - 75).cast("string")).df


# Reductions


@query(f"SELECT i0 // 2 AS i0, i1 // 2 AS i1, round(sum(v::DOUBLE) / count(*), 6) AS v FROM {MATRIX} GROUP BY i0 // 2, i1 // 2")
def block_mean_f32(spark, sf_dir):
    a = reduce.block_mean(matrix(spark, sf_dir), (2, 2))
    return a.with_value(F.round("v", 6)).df


@query("SELECT p_partkey // 3 AS i0, floor((2 * sum(p_size) + count(*)) / (2.0::DOUBLE * count(*)))::BIGINT AS v FROM part GROUP BY p_partkey // 3")
def block_mean_int(spark, sf_dir):
    return reduce.block_mean(parts(spark, sf_dir), (3,), "int").df


@query("SELECT event_id // 7 AS i0, floor((2 * sum(user_id) + count(*)) / (2.0::DOUBLE * count(*)))::BIGINT AS v FROM events GROUP BY event_id // 7")
def block_mean_i64(spark, sf_dir):
    a = reduce.block_mean(events(spark, sf_dir, "user_id"), (7,), "wide")
    return a.with_value(F.col("v").cast("bigint")).df


@query("SELECT event_id // 4 AS i0, 2 * count(*) FILTER (value > 50) >= count(*) AS v FROM events GROUP BY event_id // 4")
def block_mean_bool(spark, sf_dir):
    return reduce.block_mean(events(spark, sf_dir, F.col("value") > 50), (4,), "bool").df


@query("SELECT event_id // 5 AS i0, arg_min(value, event_id) AS v FROM events GROUP BY event_id // 5")
def block_nearest(spark, sf_dir):
    return reduce.block_nearest(events(spark, sf_dir), (5,)).df


@query("""WITH c AS (SELECT event_id // 6 AS i0, event_type AS v, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT i0, first(v ORDER BY n DESC, f) AS v FROM c GROUP BY i0""")
def block_mode(spark, sf_dir):
    return reduce.block_mode(events(spark, sf_dir, "event_type"), (6,)).df


@query(f"SELECT level::INTEGER AS level, i0 // f AS i0, i1 // f AS i1, arg_min(v, i0 * 64 + i1) AS v FROM {MATRIX}, (VALUES (0, 1), (1, 2), (2, 4)) AS s(level, f) GROUP BY level, i0 // f, i1 // f")
def pyramid_nearest(spark, sf_dir):
    return reduce.pyramid_nearest(matrix(spark, sf_dir), (2, 2), 3)


@query(f"""WITH a AS (SELECT i0 // 2 AS i0, i1 // 2 AS i1, sum(v::DOUBLE) / count(*) AS v FROM {MATRIX} GROUP BY i0 // 2, i1 // 2)
SELECT i0 // 2 AS i0, i1 // 2 AS i1, round(sum(v) / count(*), 6) AS v FROM a GROUP BY i0 // 2, i1 // 2""")
def pyramid_mean(spark, sf_dir):
    levels = reduce.pyramid(matrix(spark, sf_dir), (2, 2), "mean", levels=3)
    return levels[2].with_value(F.round("v", 6)).df


@query("SELECT event_id // 10 AS i0, bool_and(event_type IS NOT DISTINCT FROM 'click') AS all_fill FROM events GROUP BY event_id // 10")
def all_fill_chunks(spark, sf_dir):
    return reduce.all_fill_chunks(events(spark, sf_dir, "event_type"), (10,), F.lit("click"))


@query(f"SELECT i0 // 64 AS i0, i1 // 24 AS i1, (count(*) * 4)::BIGINT AS bytes FROM {MATRIX} GROUP BY i0 // 64, i1 // 24")
def storage_size(spark, sf_dir):
    return reduce.storage_size(matrix(spark, sf_dir), (64, 24), 4)


# Sequences and order


@query("SELECT event_id AS i0, coalesce(user_id - lag(user_id) OVER (PARTITION BY event_id // 100 ORDER BY event_id), user_id) AS v FROM events")
def delta_encode(spark, sf_dir):
    return sequence.delta_encode(events(spark, sf_dir, "user_id"), (100,)).df


@query("SELECT event_id AS i0, user_id AS v FROM events")
def delta_decode(spark, sf_dir):
    return sequence.delta_decode(sequence.delta_encode(events(spark, sf_dir, "user_id"), (100,)), (100,)).df


@query("SELECT event_id AS i0, ((user_id - coalesce(lag(user_id) OVER (PARTITION BY event_id // 50 ORDER BY event_id), 0) + 128) % 256 + 256) % 256 - 128 AS v FROM events")
def delta_encode_wrapping(spark, sf_dir):
    return sequence.delta_encode(events(spark, sf_dir, "user_id"), (50,), 8).df


@query(f"SELECT i0, i1, v, i0 * 64 + i1 AS k FROM {MATRIX}")
def row_major_ordinal(spark, sf_dir):
    return sequence.with_ordinal(matrix(spark, sf_dir))


@query("SELECT event_id // 250 AS block, event_id AS i0, value AS v FROM events")
def block_stream(spark, sf_dir):
    return sequence.blocks(events(spark, sf_dir), 250)


@query("SELECT path, (row_number() OVER (ORDER BY depth, lower(path), path))::INTEGER AS place FROM (SELECT DISTINCT p_brand || '/' || p_type AS path, 2 AS depth FROM part UNION ALL SELECT DISTINCT p_brand, 1 FROM part)")
def consolidated_order(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return order.consolidated_places(df.select(F.concat_ws("/", "p_brand", "p_type").alias("path")).union(df.select(F.col("p_brand").alias("path"))).distinct())


# Assembly and joins


@query("SELECT i0, coalesce(p_size, -1) AS v FROM (SELECT unnest(range(0, (SELECT count(*) + 100 FROM part))) AS i0) LEFT JOIN part ON i0 = p_partkey")
def resize_grow(spark, sf_dir):
    a = parts(spark, sf_dir)
    a = ArrayFrame(a.df, a.dims, a.shape, fill=-1)
    return assemble.resize(a, (a.shape[0] + 100,)).df


@query("SELECT p_partkey AS i0, p_size AS v FROM part WHERE p_partkey < 150")
def resize_shrink(spark, sf_dir):
    return assemble.resize(parts(spark, sf_dir), (150,)).df


@query("""WITH w AS (SELECT p_partkey AS i0, p_size AS v, 0 AS m FROM part
UNION ALL SELECT p_partkey + 80, p_size * 10, 1 FROM part)
SELECT i0, arg_max(v, m) AS v FROM w GROUP BY i0""")
def virtual_overlay(spark, sf_dir):
    a, b = parts(spark, sf_dir), parts(spark, sf_dir, F.col("p_size") * 10)
    return assemble.overlay([(a, (0,)), (b, (80,))], (a.shape[0] + 80,)).df


@query("SELECT i0, coalesce(v, -1) AS v FROM (SELECT unnest(range(0, (SELECT 2 * count(*) + 40 FROM part))) AS i0) LEFT JOIN (SELECT p_partkey * 2 AS i, p_size AS v FROM part) ON i = i0")
def virtual_gap_fill(spark, sf_dir):
    a = parts(spark, sf_dir)
    n = a.shape[0]
    whole = assemble.map_positions(a, [selection.Axis(0, n)], [selection.Axis(0, n, 2)], ("i0",), (2 * n + 40,))
    return assemble.filled(whole, -1).df


@query("SELECT p_partkey AS i0, p_size AS v FROM part UNION ALL SELECT (SELECT count(*) FROM part) + p_partkey, p_size FROM part")
def virtual_concat(spark, sf_dir):
    a = parts(spark, sf_dir)
    return assemble.concat([a, a], "i0").df


@query("SELECT k // 10 AS i0, 2 * (k % 10) + 1 AS i1, v FROM (SELECT (p_partkey - 3) // 2 AS k, p_size AS v FROM part WHERE p_partkey >= 3 AND (p_partkey - 3) % 2 = 0 AND (p_partkey - 3) // 2 < 80)")
def positional_mapping(spark, sf_dir):
    target = [selection.Axis(0, 8), selection.Axis(1, 10, 2)]
    return assemble.map_positions(parts(spark, sf_dir), [selection.Axis(3, 80, 2)], target, ("i0", "i1"), (8, 21)).df


@query("SELECT p_partkey AS i0, CASE WHEN p_partkey >= 20 AND p_partkey < 70 THEN 1000 + p_partkey - 20 ELSE p_size END::INTEGER AS v FROM part")
def write_selection(spark, sf_dir):
    a = parts(spark, sf_dir)
    new = ArrayFrame(spark.range(50).select(F.col("id").alias("i0"), (F.col("id") + 1000).cast("int").alias("v")), ("i0",), (50,))
    return assemble.write_box(a, (20,), new).df


@query("SELECT p_partkey // 16 AS c0, p_partkey AS i0, p_size AS v FROM part SEMI JOIN (SELECT DISTINCT event_id * 37 // 16 AS c FROM events) ON c = p_partkey // 16")
def chunk_overlap_join(spark, sf_dir):
    wanted = table(spark, sf_dir, "events").select(F.expr("event_id * 37 div 16").alias("c0")).distinct()
    cells = parts(spark, sf_dir).df.select(chunks.regular(F.col("i0"), 16).alias("c0"), "i0", "v")
    return cells.join(wanted, "c0", "left_semi")


# Casts and element filters


@query("SELECT event_id AS i0, ((user_id * 7 + 128) % 256 + 256) % 256 - 128 AS v FROM events")
def cast_wrap_i8(spark, sf_dir):
    return events(spark, sf_dir, casts.cast_value(F.col("user_id") * 7, "int8", source="int64", out_of_range="wrap").cast("bigint")).df


@query("SELECT event_id AS i0, least(greatest(round_even(value, 0), 0), 255)::BIGINT AS v FROM events")
def cast_clamp_u8(spark, sf_dir):
    return events(spark, sf_dir, casts.cast_value(F.col("value"), "uint8", out_of_range="clamp").cast("bigint")).df


@query("SELECT event_id AS i0, (sign(value - 50) * floor(abs(value - 50) + 0.5::DOUBLE))::BIGINT AS v FROM events")
def cast_nearest_away(spark, sf_dir):
    return events(spark, sf_dir, casts.cast_value(F.col("value") - 50, "int32", rounding="nearest-away").cast("bigint")).df


@query("SELECT event_id AS i0, trunc(value - 50)::BIGINT AS v FROM events")
def cast_toward_zero(spark, sf_dir):
    return events(spark, sf_dir, casts.cast_value(F.col("value") - 50, "int32", rounding="towards-zero").cast("bigint")).df


@query("SELECT event_id AS i0, ceil(value - 50)::BIGINT AS v FROM events")
def cast_towards_positive(spark, sf_dir):
    return events(spark, sf_dir, casts.cast_value(F.col("value") - 50, "int32", rounding="towards-positive").cast("bigint")).df


@query("SELECT event_id AS i0, floor(value - 50)::BIGINT AS v FROM events")
def cast_towards_negative(spark, sf_dir):
    return events(spark, sf_dir, casts.cast_value(F.col("value") - 50, "int32", rounding="towards-negative").cast("bigint")).df


@query("SELECT event_id AS i0, CASE user_id WHEN 8 THEN -1 WHEN 46 THEN 99 ELSE user_id END::BIGINT AS v FROM events")
def cast_scalar_map(spark, sf_dir):
    return events(spark, sf_dir, casts.cast_value(F.col("user_id"), "int64", source="int64", scalar_map=[(8, -1), (46, 99), (8, 5)]).cast("bigint")).df


@query("SELECT event_id AS i0, user_id <> 0 AS v FROM events")
def astype_bool(spark, sf_dir):
    return events(spark, sf_dir, casts.astype(F.col("user_id"), "int64", "bool")).df


@query("SELECT event_id AS i0, round_even((value - 10) * 4, 0) / 4 + 10 AS v FROM events")
def fixedscaleoffset(spark, sf_dir):
    return events(spark, sf_dir, casts.fixed_scale_decode(casts.fixed_scale_encode(F.col("value"), 10, 4), 10, 4)).df


@query("SELECT event_id AS i0, round_even(value * 128.0::DOUBLE, 0) / 128.0::DOUBLE AS v FROM events")
def quantize(spark, sf_dir):
    return events(spark, sf_dir, casts.quantize(F.col("value"), 2)).df


@query()
def bitround(spark, sf_dir):
    return events(spark, sf_dir, casts.bit_round(F.col("value"), 10)).df


@query("SELECT event_id AS i0, (user_id * 3)::BIGINT AS v FROM events")
def store_exactly(spark, sf_dir):
    return events(spark, sf_dir, casts.store_exactly(F.col("user_id") * 3.0, "int64")).df


# Coordinate transforms


@query("SELECT p_partkey, 5.0::DOUBLE + 2.0::DOUBLE * p_size + 0.5::DOUBLE * p_retailprice AS x, -1.0::DOUBLE + 0.25::DOUBLE * p_size + 3.0::DOUBLE * p_retailprice AS y FROM part")
def affine_points(spark, sf_dir):
    t = tf.Affine(((2.0, 0.5, 5.0), (0.25, 3.0, -1.0)))
    return tf.transform_points(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], t, ["x", "y"]).select("p_partkey", "x", "y")


@query("SELECT p_partkey, p_size * 0.5::DOUBLE + 10.0::DOUBLE AS x, p_retailprice * 2.0::DOUBLE + -3.0::DOUBLE AS y FROM part")
def scale_translate(spark, sf_dir):
    t = tf.Sequence((tf.Scale((0.5, 2.0)), tf.Translation((10.0, -3.0))))
    return tf.transform_points(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], t, ["x", "y"])


@query("SELECT p_partkey, p_retailprice AS x, p_size::DOUBLE AS y FROM part")
def map_axis(spark, sf_dir):
    return tf.transform_points(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], tf.MapAxis((1, 0)), ["x", "y"])


@query("SELECT p_partkey, 0.0::DOUBLE AS x, p_retailprice AS y FROM part")
def project_axis(spark, sf_dir):
    return tf.transform_points(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], tf.ProjectAxis(drop=(0,), zeros=(0,)), ["x", "y"])


@query("SELECT p_partkey, p_retailprice * 4.0::DOUBLE AS x, p_size + 1.5::DOUBLE AS y FROM part")
def by_dimension(spark, sf_dir):
    t = tf.ByDimension((((0,), (1,), tf.Translation((1.5,))), ((1,), (0,), tf.Scale((4.0,)))))
    return tf.transform_points(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], t, ["x", "y"])


@query("SELECT p_partkey, round(p_size::DOUBLE, 6) AS x, round(p_retailprice, 6) AS y FROM part")
def affine_inverse(spark, sf_dir):
    t = tf.Affine(((2.0, 0.5, 5.0), (0.25, 3.0, -1.0)))
    df = tf.transform_points(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], tf.Sequence((t, t.inverse())), ["x", "y"])
    return df.select("p_partkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH n AS (SELECT count(*) - 1 AS top FROM part), p AS (SELECT event_id, least(greatest(value, 0.0::DOUBLE), top::DOUBLE) AS x, top FROM events, n), c AS (
SELECT event_id, floor(x)::BIGINT AS i, 1.0::DOUBLE - (x - floor(x)) AS w FROM p UNION ALL SELECT event_id, least(floor(x)::BIGINT + 1, top), x - floor(x) FROM p)
SELECT event_id, round(sum(w * p_retailprice), 6) AS d FROM c JOIN part ON i = p_partkey WHERE w <> 0 GROUP BY event_id""")
def displacement_linear(spark, sf_dir):
    field = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i0"), F.col("p_retailprice").alias("d"))
    out = tf.field_at(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", ["value"], field, ["i0"], (field.count(),), ["d"])
    return out.select("event_id", F.round("d", 6).alias("d"))


@query("SELECT event_id, p_retailprice AS d FROM (SELECT event_id, floor(least(greatest(value, 0.0::DOUBLE), (SELECT count(*) - 1 FROM part)::DOUBLE) + 0.5::DOUBLE)::BIGINT AS i FROM events) JOIN part ON i = p_partkey")
def displacement_nearest(spark, sf_dir):
    field = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i0"), F.col("p_retailprice").alias("d"))
    return tf.field_at(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", ["value"], field, ["i0"], (field.count(),), ["d"], "nearest")


# Chunks and text


@query(f"SELECT DISTINCT 'c/' || (i0 // 64) || '/' || (i1 // 24) AS key, (i0 // 64) || '.' || (i1 // 24) AS old_key FROM {MATRIX}")
def chunk_keys(spark, sf_dir):
    cells = [chunks.regular(F.col("i0"), 64), chunks.regular(F.col("i1"), 24)]
    return matrix(spark, sf_dir).df.select(chunks.chunk_key(cells).alias("key"), chunks.chunk_key(cells, "v2", ".").alias("old_key")).distinct()


@query("SELECT p_partkey AS i0, (len(list_filter([0, 10, 25, 50, 90], lambda s: s <= p_partkey)) - 1)::BIGINT AS c FROM part")
def rectilinear_chunk(spark, sf_dir):
    return parts(spark, sf_dir).df.select("i0", chunks.rectilinear(F.col("i0"), [10, 15, 25, 40, 10**9]).alias("c"))


@query("SELECT p_partkey AS i0, least(64, (SELECT count(*) FROM part) - (p_partkey // 64) * 64)::BIGINT AS extent FROM part")
def edge_extent(spark, sf_dir):
    a = parts(spark, sf_dir)
    return a.df.select("i0", chunks.edge_extent(F.col("i0"), 64, a.shape[0]).alias("extent"))


@query("SELECT event_id, (props->>'$.k')::VARCHAR AS k FROM events")
def attribute_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, props->>'$.k' AS k, event_type AS t FROM events")
def attribute_merge(spark, sf_dir):
    merged = text.merge_attributes(F.lit('{"k": "old", "t": "old"}'), F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("t"))))
    return table(spark, sf_dir, "events").select("event_id", merged.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["t"].alias("t"))


@query("SELECT i0, string_agg(p_size::VARCHAR, ',' ORDER BY i1) AS line FROM (SELECT p_partkey // 20 AS i0, p_partkey % 20 AS i1, p_size FROM part) GROUP BY i0")
def dump_csv(spark, sf_dir):
    return text.dump_lines(projection.reshape(parts(spark, sf_dir), (-1, 20)))


@query("SELECT event_id, strftime(TIMESTAMP '1970-01-01' + to_seconds(user_id * 86400), '%Y-%m-%d') AS d, strftime(TIMESTAMP '1970-01-01' + to_milliseconds(user_id * 86399999), '%Y-%m-%dT%H:%M:%S.%g') AS ms FROM events")
def time_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.time_text(F.col("user_id"), "D").alias("d"), text.time_text(F.col("user_id") * 86_399_999, "ms").alias("ms"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%e%' THEN '\"' || replace(p_name || ',' , '\"', '\"\"') || '\"' ELSE p_name END AS f FROM part")
def csv_quoting(spark, sf_dir):
    name = F.when(F.col("p_name").contains("e"), F.concat("p_name", F.lit(","))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.csv_field(name).alias("f"))
