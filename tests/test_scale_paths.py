"""Charts over a hot key keep every row, and equal the single-task windows computed beside them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kpiframe.plans.chart import chart

@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(4000):
        hot = rnd.random() < 0.34  # one value holds about a third of the rows
        x = 42.0 if hot else float(rnd.randint(0, 400))
        rows.append((i, x, rnd.random() * 10, rnd.random() * 9, rnd.choice([1.0, 2.0, 0.5]), rnd.choice("abcde")))
    return spark.createDataFrame(rows, "id long, x double, a double, e double, w double, c string")


@pytest.mark.parametrize("n", [5, 9, 300])
def test_tiles_of_a_hot_value(spark, skewed, n):
    got = {r["x"]: (r["volume"], r["resp0"]) for r in chart(skewed, "x", "a", weight="w", quantiles=n, tie_by=["id"]).rows.collect()}
    tiles = skewed.withColumn("t", F.ntile(n).over(Window.orderBy("x", "id")))
    want = {f"Q{r['t']}": (r["v"], r["s"] / r["v"]) for r in tiles.groupBy("t").agg(F.sum("w").alias("v"), F.sum("a").alias("s")).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_hot_key_keeps_whole_weight(spark, skewed):
    for kwargs in ({"band": 25, "low_weight": "6%"}, {"quantiles": 5, "tie_by": ["id"]}, {"band": 10, "low_weight": "4%"}):
        res = chart(skewed, "x", "a", "e", weight="w", sigma=2, fold_by=["id"], **kwargs)
        assert res.rows.agg(F.sum("volume")).first()[0] == pytest.approx(skewed.agg(F.sum("w")).first()[0])


def test_positions_without_one_window(spark):
    df = spark.range(3000).select((F.col("id") % 2500).alias("x"), (F.col("id") % 7).cast("double").alias("v"))
    rows = chart(df, "x", "v", transform="zero").rows.select("x", "position").collect()
    assert sorted(r["position"] for r in rows) == list(range(1, 2501))
    assert all(int(r["x"]) + 1 == r["position"] for r in rows)


@pytest.mark.parametrize("name", [
    "tails_percent", "tails_quantile_missing", "sigma_tails", "other_group", "chart_quantile_ties", "group_cap", "transform_zero",
    "geo_boundary_join", "geo_legend_bins", "chart_first_seen",
])
def test_tables_in_many_partitions_give_the_same(spark, name):
    """Small group tables lie in one task; spread over several they are ranked by ranges, with the same results."""
    from kpiframe.plans import registry

    sf = "/root/testdata/sf0.001"
    plain = sorted(map(str, registry.QUERIES[name](spark, sf).collect()))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        assert sorted(map(str, registry.QUERIES[name](spark, sf).collect())) == plain
    finally:
        spark.conf.unset(key)
