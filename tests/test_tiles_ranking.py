import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kpiframe.operators.ranking import running_sum
from kpiframe.operators.tiles import assign_tiles


def test_running_sum_matches_window(spark):
    rnd = random.Random(3)
    data = [(i, rnd.choice([1, 1, 1, 2, 3, 50]), float(rnd.randint(-5, 20))) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, g long, v double")
    got = running_sum(df, [F.col("g").asc(), F.col("id").asc()], F.col("v"), partitions=6)
    w = Window.orderBy("g", "id")
    want = df.withColumn("p", F.row_number().over(w)).withColumn(
        "c", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = {r["id"]: (r["__pos"], r["__cum"]) for r in got.collect()}
    b = {r["id"]: (r["p"], r["c"]) for r in want.collect()}
    assert a == b


@pytest.mark.parametrize("n", [1, 3, 7, 64])
def test_tiles_equal_ntile(spark, n):
    rnd = random.Random(n)
    # one hot value holding about a third of the rows, plus nulls and ties
    xs = [5.0 if rnd.random() < 0.33 else (None if rnd.random() < 0.05 else float(rnd.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, x double")
    got = assign_tiles(df, F.col("x"), n, ["id"])
    want = df.where(F.col("x").isNotNull()).withColumn("t", F.ntile(n).over(Window.orderBy("x", "id")))
    a = {r["id"]: r["__tile"] for r in got.collect()}
    b = {r["id"]: r["t"] for r in want.collect()}
    for i, x in enumerate(xs):
        if x is None:
            assert a[i] is None
    assert {k: v for k, v in a.items() if v is not None} == b


def test_tiles_more_tiles_than_rows(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(5)], "id long, x double")
    got = sorted((r["id"], r["__tile"]) for r in assign_tiles(df, F.col("x"), 9, ["id"]).collect())
    want = sorted((r["id"], r["t"]) for r in df.withColumn("t", F.ntile(9).over(Window.orderBy("x", "id"))).collect())
    assert got == want


def test_tile_sizes_differ_by_at_most_one(spark):
    df = spark.range(1003).select(F.col("id"), (F.col("id") % 17).cast("double").alias("x"))
    sizes = [r["count"] for r in assign_tiles(df, F.col("x"), 10, ["id"]).groupBy("__tile").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 1003


@pytest.mark.parametrize("n", [2, 5, 40])
def test_tiles_with_odd_values(spark, n):
    odd = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.5, -3.25, None]
    rnd = random.Random(n)
    df = spark.createDataFrame([(i, rnd.choice(odd)) for i in range(400)], "id long, x double")
    got = {r["id"]: r["__tile"] for r in assign_tiles(df, F.col("x"), n, ["id"]).collect() if r["__tile"] is not None}
    want = df.where("x IS NOT NULL").withColumn("t", F.ntile(n).over(Window.orderBy("x", "id")))
    assert got == {r["id"]: r["t"] for r in want.collect()}


def test_tiles_of_nothing(spark):
    empty = spark.createDataFrame([(1, None)], "id long, x double")
    assert assign_tiles(empty, F.col("x"), 4, ["id"]).first()["__tile"] is None
    nan = spark.createDataFrame([(i, float("nan")) for i in range(10)], "id long, x double")
    assert sorted(r["__tile"] for r in assign_tiles(nan, F.col("x"), 3, ["id"]).collect()) == [1] * 4 + [2] * 3 + [3] * 3


def test_running_sum_from_the_end(spark):
    df = spark.createDataFrame([(1, 1e16), (2, 1.0), (3, 1.0), (4, 1.0)], "id long, v double")
    got = running_sum(df, [F.col("id").asc()], F.col("v"), suffix_col="s", count_col="n")
    assert [(r["s"], r["n"]) for r in got.orderBy("id").collect()] == [(1e16 + 3.0, 4), (3.0, 4), (2.0, 4), (1.0, 4)]
