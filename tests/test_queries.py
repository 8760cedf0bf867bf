"""Every registered query against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from gridspan.plans import roundtrips  # noqa: F401  adds its queries
from gridspan.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in ("part", "events", "embeddings", "documents"):
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    text = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return [names[k] for k in order], sorted(tuple(text(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    found = df.collect()
    assert found
    if name in ORACLE_SQL:
        wanted = sql.execute(ORACLE_SQL[name])
        assert rows(df.columns, found) == rows([c[0] for c in wanted.description], wanted.fetchall())


@pytest.mark.parametrize("name", ["cast_scalar_map", "store_exactly"])
def test_ids_beyond_a_narrow_type(spark, tmp_path, name):
    ids = [0, 8, 46, 32_767, 32_768, 90_000, -40_000, 2**31, 3 * 2**31, None]
    spark.createDataFrame(list(enumerate(ids)), "event_id bigint, user_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    connection = duckdb.connect()
    connection.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    wanted = connection.execute(ORACLE_SQL[name])
    df = QUERIES[name](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == rows([c[0] for c in wanted.description], wanted.fetchall())
