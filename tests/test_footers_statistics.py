"""Row counts and ranges from footers, statistics that are kept per file, CSV types, pages, documents of features."""

import json
import os
import statistics
import time

import pytest
from pyspark.sql import functions as F

from kpiframe.operators.ordering import PagedRows
from kpiframe.operators.profile import profile
from kpiframe.plans.chart import chart
from kpiframe.sources.boundaries import read_boundaries, write_collections
from kpiframe.sources.footers import footer_query, footer_statistics
from kpiframe.sources.table import Table, csv_types, load_table, read_csv

SF = "/root/testdata/sf0.001"


@pytest.fixture
def numbers(spark, tmp_path):
    path = str(tmp_path / "numbers.parquet")
    spark.range(1000).selectExpr("id", "CAST(id % 90 AS INT) AS small", "id * 1.5 AS price", "CAST(id AS STRING) AS name").repartition(3).write.parquet(path)
    return path


def test_footers_answer_counts_and_ranges(spark, numbers):
    df = spark.read.parquet(numbers)
    query = footer_query(df, ["id", "small"])
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id), MIN(small), MAX(small)]" in plan
    found = footer_statistics(df, ["id", "small"])
    assert (found.rows, found.ranges) == (1000, {"id": (0, 999), "small": (0, 89)})
    # The session that asked keeps its settings.
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    assert chart(df, "small", "price").row_count() == 1000


def test_what_footers_cant_answer(spark, numbers, tmp_path):
    df = spark.read.parquet(numbers)
    assert footer_statistics(df.where("id > 5"), ["id"]) is None
    assert footer_statistics(df, ["price"]) is None
    assert footer_statistics(spark.range(5).toDF("id"), ["id"]) is None
    nulls = str(tmp_path / "nulls.parquet")
    spark.range(50).select(F.lit(None).cast("int").alias("n"), (F.col("id") * 2).alias("id")).write.parquet(nulls)
    read = spark.read.parquet(nulls)
    assert footer_statistics(read, ["n"]) is None  # no range in a footer
    rows = {r["name"]: r for r in profile(read).collect()}
    assert rows["n"]["min_value"] is None and rows["id"]["max_value"] == 98 and rows["n"]["row_count"] == 50


@pytest.mark.parametrize("name", ["lineitem", "orders", "part", "events"])
def test_profile_from_footers_equals_the_scan(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    df = spark.read.parquet(f"{SF}/{name}.parquet")
    scanned = df.where("1 = 1 OR rand() < 2")  # no plain read: the same rows without footers
    assert footer_statistics(scanned, []) is None
    assert profile(df).collect() == profile(scanned).collect()


def test_statistics_of_unchanged_files_are_kept(spark, numbers, tmp_path):
    store = str(tmp_path / "store")
    table = Table(spark, numbers, statistics_store=store)
    first = {r["name"]: r for r in table.profile().collect()}
    assert table.files_read == 3 and table.row_count() == 1000
    plain = {r["name"]: r for r in profile(spark.read.parquet(numbers)).collect()}
    assert {k: v["band_suggestion"] for k, v in first.items()} == {k: v["band_suggestion"] for k, v in plain.items()}
    # Another handle on the same files reads none of them.
    again = Table(spark, numbers, statistics_store=store)
    assert again.profile().collect() == table.profile().collect() and again.files_read == 0
    spark.range(5000, 5100).selectExpr("id", "CAST(7 AS INT) AS small", "id * 1.5 AS price", "'x' AS name").coalesce(1).write.mode("append").parquet(numbers)
    again.refresh()
    rows, found = again.statistics()
    assert again.files_read == 1 and rows == 1100 and found["id"][:2] == (0, 5099)
    prices = [i * 1.5 for i in [*range(1000), *range(5000, 5100)]]
    assert found["price"][2] == pytest.approx(statistics.stdev(prices), rel=1e-12)
    assert chart(again, "small", "price").counts.first()["row_count"] == 1100


def test_a_folder_without_a_suffix_is_read(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.range(10).write.parquet(path)
    assert load_table(spark, path).row_count() == 10
    (tmp_path / "texts").mkdir()
    with pytest.raises(ValueError, match="Only .csv and .parquet"):
        load_table(spark, str(tmp_path / "texts"))
    (tmp_path / "texts" / "a.csv").write_text("n\n1\n2\n")
    assert load_table(spark, str(tmp_path / "texts")).row_count() == 2


CSV = """n,big,price,day,at,flag,mixed,empty,name
1,9000000000,1.5,2024-01-01,2024-01-01 10:00:00,true,1,,a
2,3,2e3,2024-02-01,2024-01-02,false,x,,b
oops
3,4,.5,2024-03-01,2024-01-03T11:22:33.5,TRUE,2,,"c,d"
not,a,number,at,all,here,and,too,many,fields
,, 7 ,,,,,,
"""


def test_malformed_rows_change_no_type(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text(CSV)
    df = read_csv(spark, str(path))
    assert dict(df.dtypes) == {
        "n": "int", "big": "bigint", "price": "double", "day": "date", "at": "timestamp", "flag": "boolean", "mixed": "string",
        "empty": "string", "name": "string",
    }
    rows = df.collect()
    assert [(r["n"], r["price"], r["name"]) for r in rows] == [(1, 1.5, "a"), (2, 2000.0, "b"), (3, 0.5, "c,d"), (None, 7.0, None)]
    assert df.count() == df.select("n").count() == 4
    assert chart(df, "flag", "price").quality.first()["filtered_row_count"] == 4


def test_csv_types_merge_over_partitions(spark):
    texts = spark.createDataFrame([("1", "2024-01-01"), ("2", None), ("3000000000", "2024-13-01")] * 40, "a string, b string").repartition(7)
    assert csv_types(texts) == {"a": "bigint", "b": "string"}
    assert csv_types(texts.where("b IS NULL OR b < '2024-02'")) == {"a": "int", "b": "date"}


def test_a_page_opens_few_files(spark, tmp_path):
    rows = spark.range(1, 25_001).select(F.col("id").alias("position"), (F.col("id") * 2).alias("v"))
    pages = PagedRows(rows.repartition(5), str(tmp_path / "pages"), file_rows=1000)
    page = pages.page(12, page_size=300)
    assert [r["position"] for r in page.orderBy("position").collect()] == list(range(3301, 3601))
    assert page.first()["pages"] == 84 and len(page.select("v").distinct().collect()) == 300
    scan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "position" in scan
    files = {r["f"] for r in page.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) == 1
    across = pages.page(4, page_size=300)  # 901..1200
    assert len({r["f"] for r in across.select(F.input_file_name().alias("f")).distinct().collect()}) == 2
    assert pages.page(10**6).first()["page"] == 25 and pages.page(-3).first()["page"] == 1
    assert "PartitionFilters: [isnotnull(file" in page._jdf.queryExecution().executedPlan().toString()
    assert PagedRows(rows.where("position < 0"), str(tmp_path / "none")).page(1).count() == 0


def document(n, space=""):
    features = [
        {"type": "Feature", "properties": {"K": f"k{i}", "note": 'a {"type":"Feature" in a text', "n": i},
         "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0.25], [i, 0]]]} if i % 5 else None}
        for i in range(n)
    ]
    return json.dumps({"type": "FeatureCollection", "name": "areas", "features": features}, separators=("," + space, ":" + space), indent=1 if space else None)


@pytest.mark.parametrize("space", ["", " "])
def test_one_document_is_read_by_many_tasks(spark, tmp_path, space):
    path = str(tmp_path / "areas.geojson")
    with open(path, "w") as f:
        f.write(document(400, space))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        split = read_boundaries(spark, path, "K")
        assert split.rdd.getNumPartitions() > 4
        whole = read_boundaries(spark, path, "K", split=False)
        key = lambda df: sorted((r["key"], r["geometry"] and json.dumps(json.loads(r["geometry"])), sorted(r["properties"].items())) for r in df.collect())
        assert key(split) == key(whole) and split.count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError, match="no 'Other' property"):
        read_boundaries(spark, path, "Other")


def test_other_documents_are_read_whole(spark, tmp_path):
    path = str(tmp_path / "late.geojson")
    with open(path, "w") as f:
        json.dump({"features": [{"properties": {"K": "a"}, "geometry": None, "type": "Feature"}], "type": "FeatureCollection"}, f)
    assert [r["key"] for r in read_boundaries(spark, path, "K").collect()] == ["a"]


def test_one_collection_per_layer(spark, tmp_path):
    rows = [(f"k{i}", f'{{"type":"Point","coordinates":[{i},0]}}' if i % 3 else None, ["north", "south \"x\"", None][i % 3 if i else 0], i) for i in range(50)]
    features = spark.createDataFrame(rows, "key string, geometry string, layer string, n int").repartition(6)
    path = str(tmp_path / "layers")
    write_collections(features, path, "K", "layer")
    found = {}
    for folder, _, files in os.walk(path):
        parts = [f for f in files if f.startswith("part-")]
        if parts:
            assert len(parts) == 1
            with open(os.path.join(folder, parts[0])) as f:
                doc = json.load(f)
            assert doc["type"] == "FeatureCollection"
            keys = [f["properties"]["K"] for f in doc["features"]]
            assert keys == sorted(keys) and all(set(f["properties"]) == {"K", "n"} for f in doc["features"])
            found[doc["name"]] = len(keys)
    assert found == {"north": 17, 'south "x"': 17, "features": 16}
    back = {r["key"]: (r["geometry"], r["properties"]["n"]) for r in read_boundaries(spark, path + "/layer=north", "K").collect()}
    assert back == {k: (g, str(n)) for k, g, layer, n in rows if layer == "north"}


def test_a_second_profile_is_quick_to_say_what_changed(spark, numbers, tmp_path):
    """A rewritten file has another modification time and is read again."""
    store = str(tmp_path / "store")
    Table(spark, numbers, statistics_store=store).statistics()
    time.sleep(1.1)
    spark.range(10).selectExpr("id", "CAST(1 AS INT) AS small", "1.0 AS price", "'a' AS name").coalesce(1).write.mode("overwrite").parquet(numbers)
    table = Table(spark, numbers, statistics_store=store)
    assert table.row_count() == 10 and table.files_read == 1
