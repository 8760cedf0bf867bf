"""Selections and assembly against numpy, partial against whole, with a fixed seed."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.array import ArrayFrame
from gridspan.operators import assemble, projection, reduce, selection, sequence

X = np.arange(18 * 12).reshape(18, 12) * 3 + 1


@pytest.fixture(scope="module")
def a(spark):
    df = spark.range(18 * 12).select(F.expr("id div 12").alias("i0"), F.expr("id % 12").alias("i1"), (F.col("id") * 3 + 1).alias("v"))
    return ArrayFrame(df.cache(), ("i0", "i1"), (18, 12))


def dense(a, fill=0):
    out = np.full(a.shape, fill, object)
    for row in a.df.collect():
        out[tuple(row[d] for d in a.dims)] = row["v"]
    return out.tolist()


def test_random_slices(a):
    rng = random.Random(5)
    for _ in range(8):
        s = [slice(rng.randint(-20, 20), rng.choice([None, rng.randint(-20, 20)]), rng.randint(1, 5)) for _ in range(2)]
        text = ",".join(f"{x.start}:{'' if x.stop is None else x.stop}:{x.step}" for x in s)
        assert dense(selection.slice_text(a, text)) == X[tuple(s)].tolist(), text
    assert dense(selection.slice_text(a, "-1")) == X[-1].tolist()
    assert dense(selection.slice_text(a, "3,::5")) == X[3, ::5].tolist()


@pytest.mark.parametrize("text, error", [("18", IndexError), ("::0", ValueError), ("::-1", ValueError), ("a", ValueError), ("1,2,3", ValueError)])
def test_bad_slices(a, text, error):
    with pytest.raises(error):
        selection.slice_text(a, text)


def test_hyperslab_blocks(a):
    got = dense(selection.hyperslab(a, (1, 0), (3, 2), (5, 6), (2, 3)))
    assert got == X[np.ix_([1, 2, 6, 7, 11, 12], [0, 1, 2, 6, 7, 8])].tolist()
    with pytest.raises(ValueError):
        selection.hyperslab(a, (0, 0), (2, 2), (2, 2), (3, 1))
    with pytest.raises(IndexError):
        selection.box(a, (10, 0), (9, 1))
    assert dense(selection.box(a, (3, 3), (0, 2))) == []


def test_points_keep_order_and_repeats(a):
    where = [(3, 4), (0, 0), (3, 4), (17, 11)]
    assert [r["v"] for r in selection.points(a, where).orderBy("k").collect()] == [int(X[p]) for p in where]
    with pytest.raises(IndexError):
        selection.points(a, [(18, 0)])


def test_shapes(a):
    assert dense(projection.transpose(a, (1, 0))) == X.T.tolist()
    assert dense(projection.reshape(a, (4, -1, 9))) == X.reshape(4, 6, 9).tolist()
    with pytest.raises(ValueError):
        projection.reshape(a, (5, -1))
    assert dense(projection.squeeze(a, "i0", 2)) == X[2].tolist()


def test_assembly(spark, a):
    small = selection.box(a, (0, 0), (4, 5))
    over = assemble.overlay([(small, (0, 0)), (small, (2, 3))], (8, 9), fill=-7)
    want = np.full((8, 9), -7)
    want[:4, :5] = X[:4, :5]
    want[2:6, 3:8] = X[:4, :5]
    assert dense(over) == want.tolist()
    assert dense(assemble.resize(small, (2, 3))) == X[:2, :3].tolist()
    grown = ArrayFrame(small.df, small.dims, small.shape, fill=9)
    assert dense(assemble.resize(grown, (5, 5)))[4] == [9] * 5
    assert dense(assemble.concat([small, small], "i1")) == np.hstack([X[:4, :5]] * 2).tolist()
    with pytest.raises(ValueError):
        assemble.concat([small, a], "i1")


def test_virtual_names():
    have = {"f0", "f1", "f3"}
    assert assemble.numbered_sources("f%b", have.__contains__) == ["f0", "f1"]
    assert assemble.numbered_sources("f%b", have.__contains__, gap=1) == ["f0", "f1", "f3"]
    assert assemble.numbered_sources("100%%", {"100%"}.__contains__) == ["100%"]
    assert assemble.virtual_extent([3, 9], "first_missing") == 3


def test_block_reductions(a):
    blocks = [[X[i : i + 4, j : j + 5] for j in range(0, 12, 5)] for i in range(0, 18, 4)]
    assert dense(reduce.block_mean(a, (4, 5), "int")) == [[int((2 * b.sum() + b.size) // (2 * b.size)) for b in row] for row in blocks]
    assert dense(reduce.block_mean(a, (4, 5), "wide")) == [[int((2 * b.sum() + b.size) // (2 * b.size)) for b in row] for row in blocks]
    assert dense(reduce.block_nearest(a, (4, 5))) == [[int(b[0, 0]) for b in row] for row in blocks]
    negative = a.with_value(-F.col("v"))
    assert dense(reduce.block_mean(negative, (4, 5), "wide")) == [[int((-2 * b.sum() + b.size) // (2 * b.size)) for b in row] for row in blocks]


def test_wide_mean_is_exact(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([(0, big), (1, big - 3)], "i0 bigint, v bigint")
    out = reduce.block_mean(ArrayFrame(df, ("i0",), (2,)), (2,), "wide").df.first()["v"]
    assert int(out) == (2 * (2 * big - 3) + 2) // 4


def test_mode_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, "c")], "i0 bigint, v string")
    out = reduce.block_mode(ArrayFrame(df, ("i0",), (5,)), (4,))
    assert [r["v"] for r in out.df.orderBy("i0").collect()] == ["b", "c"]


def test_pyramid_plan():
    assert reduce.pyramid_shapes((100, 7), (2, 1), smallest=30) == [(100, 7), (50, 7), (25, 7)]
    assert reduce.level_transform((0.5,), (2,), 2, "mean") == ([2.0], [0.75])
    assert reduce.level_transform((0.5,), (2,), 2, "nearest") == ([2.0], [0.0])


def test_delta_restarts_in_each_chunk(a):
    coded = sequence.delta_encode(a, (5, 4))
    assert dense(coded)[0][0] == 1 and dense(coded)[0][4] == X[0, 4]
    assert dense(sequence.delta_decode(coded, (5, 4))) == X.tolist()
