"""Row numbers in file order: default folds, first-seen positions, ties; range splits that don't depend on input order."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kpiframe.operators.positions import with_row_number
from kpiframe.operators.ranking import range_split
from kpiframe.plans.chart import ROW_ORDER, chart, chart_from_request


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    """Four files; rows carry their number in file order."""
    path = str(tmp_path_factory.mktemp("order") / "t.parquet")
    rnd = random.Random(2)
    for part in range(4):
        rows = [(part * 1000 + i + 1, rnd.choice("abcd"), float(rnd.randint(0, 6)), rnd.random(), rnd.random()) for i in range(1000)]
        df = spark.createDataFrame(rows, "n long, k string, x double, a double, e double").coalesce(1)
        df.write.option("parquet.block.size", 8192).parquet(f"{path}/batch={part}")
    return path


@pytest.mark.parametrize("size", ["2k", "64m"])
def test_numbers_are_those_of_the_files(spark, filed, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = spark.read.parquet(filed)
        rows = with_row_number(df.where("a > 0.3").withColumn("more", F.lit(1)))
        assert rows.where("n <> __row").isEmpty() and rows.count() == df.where("a > 0.3").count()
        folds = {r["n"]: int(hashlib.md5(str(r["n"]).encode()).hexdigest()[:8], 16) % 20 for r in df.select("n").collect()}
        want = chart(df.withColumn("f", F.col("n")), "k", "a", "e", sigma=1, fold_by=["f"])
        got = chart(df, "k", "a", "e", sigma=1)
        pick = lambda res: [(r["x"], r["valid_folds"], round(r["sigma_se"], 12)) for r in res.rows.orderBy("x").collect()]
        assert pick(got) == pick(want) and set(folds.values()) == set(range(20))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_first_seen_through_tails(spark, filed):
    df = spark.read.parquet(filed)
    rows = chart(df, "x", "a", filter="n > 7", band=1, low_weight="40%", first_seen=True).rows.collect()
    data = [(r["n"], r["x"]) for r in df.where("n > 7").collect()]
    firsts = {str(x): min(n for n, y in data if y == x) for x in {x for _, x in data}}
    shown = {r["x"]: r["first_seen"] for r in rows}
    tails = [t for t in ("Low tail", "High tail") if t in shown]
    assert tails and all(shown[x] == firsts[x] for x in shown if x not in tails)
    assert min(shown.values()) == min(firsts.values())
    other = {r["x"]: r["first_seen"] for r in chart(df, "k", "a", low_weight="26%", first_seen=True).rows.collect()}
    assert min(other.values()) == 1


def test_tiles_in_row_order(spark, filed):
    df = spark.read.parquet(filed)
    # Nine tiles over seven values: the reference order is x, then the row's place.
    ordered = sorted((r["x"], r["n"], r["a"]) for r in df.collect())
    want, at = {}, 0
    for tile in range(9):
        size = 4000 // 9 + (tile < 4000 % 9)
        want[f"Q{tile + 1}"] = sum(a for *_, a in ordered[at : at + size])
        at += size
    for res in (chart(df, "x", "a", quantiles=9, tie_by=ROW_ORDER), chart_from_request(
            df, {"x": "x", "responses": [{"numerator": "a"}], "quantileMode": "on", "bandWidth": "9"})):
        assert {r["x"]: pytest.approx(r["resp0_num"]) for r in res.rows.collect()} == want
    seen = chart(df, "x", "a", quantiles=9, tie_by=ROW_ORDER, first_seen=True)
    firsts, at = {}, 0
    for tile in range(9):
        size = 4000 // 9 + (tile < 4000 % 9)
        firsts[f"Q{tile + 1}"] = min(n for _, n, _ in ordered[at : at + size])
        at += size
    assert {r["x"]: r["first_seen"] for r in seen.rows.collect()} == firsts


def test_rows_without_files(spark):
    df = spark.createDataFrame([(i % 3, float(i), i * 0.9) for i in range(300)], "x int, a double, e double")
    with pytest.raises(ValueError, match="Parquet files"):
        chart(df, "x", "a", first_seen=True)
    pick = lambda d: [(r["x"], r["valid_folds"], r["sigma_se"]) for r in chart(d, "x", "a", "e", sigma=1).rows.orderBy("x").collect()]
    first, again = pick(df.repartition(2)), pick(df.repartition(7))
    assert [r[:2] for r in first] == [r[:2] for r in again]
    assert [r[2] for r in first] == pytest.approx([r[2] for r in again])


def test_range_split_doesnt_depend_on_the_order_of_rows(spark):
    """What a map task that runs again sends where: the same rows in another order fall into the same ranges."""
    rows = [(i // 400, i, f"t{i % 7}") for i in range(2000)]
    placed = []
    for seed in (1, 2):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        df = spark.createDataFrame(mixed, "g long, id long, t string").coalesce(1)
        split = range_split(df, [F.col("g").asc()], 5)
        assert "rand" not in split._jdf.queryExecution().analyzed().toString().lower()
        salts = {r["id"]: r["__salt"] for r in split.collect()}
        sizes = split.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        placed.append(salts)
        assert len(sizes) == 5 and max(r["count"] for r in sizes) < 800  # runs of equal keys are split
    assert placed[0] == placed[1]
