import json
import struct

import pytest
from pyspark.sql import functions as F

from kpiframe.operators.profile import profile
from kpiframe.plans.chart import chart
from kpiframe.sources.boundaries import decode_geometry, features_from_wkb, read_boundaries, write_features
from kpiframe.sources.saved_filters import load_saved_filters
from kpiframe.sources.table import load_table


def test_csv_dropmalformed_and_types(spark, tmp_path):
    p = tmp_path / "sample.csv"
    # The malformed row (one field too many) is dropped.  Spark's type inference
    # still reads it, so it carries type-compatible values here; give an explicit
    # schema when a file may hold rows that would widen a column to string.
    p.write_text("x,Actual,d\n1,10,2024-01-01\n2,,2024-01-02\n9,90,2024-01-09,extra\n3,30,2024-01-03\n")
    t = load_table(spark, str(p))
    df = t.df
    assert dict(df.dtypes)["x"] == "int" and dict(df.dtypes)["d"] == "date"
    assert df.count() == 3 and df.select("x").count() == 3
    res = chart(df, "x", "Actual")
    assert res.quality.first()["missing_response_rows"] == 1
    assert t.total_size().first()["files"] == 1
    typed = load_table(spark, str(p), schema="x int, Actual int, d date").df
    assert typed.count() == 3
    d = t.describe()
    assert d["row_count"] == 3 and d["file_size"] == p.stat().st_size
    assert [(c["name"], c["kind"], c["band_suggestion"]) for c in d["columns"]] == [
        ("x", "integer", 1.0), ("Actual", "integer", 1.0), ("d", "date", None)]


def test_parquet_and_errors(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, 123.45, "AB")], "id int, premium double, postcode_area string").write.parquet(p)
    rows = chart(load_table(spark, p).df, "postcode_area", "premium").rows.collect()
    assert rows[0]["x"] == "AB" and rows[0]["resp0"] == pytest.approx(123.45)
    with pytest.raises(ValueError, match="Only .csv and .parquet"):
        load_table(spark, str(tmp_path / "x.json"))
    with pytest.raises(FileNotFoundError):
        load_table(spark, str(tmp_path / "missing.csv"))


def test_saved_filters(spark, tmp_path):
    p = tmp_path / "filter_spec.csv"
    p.write_text("﻿name,expression\nHeavy,\t load > 15\u00a0\n , x\nEmpty,\n", encoding="utf-8")
    rows = load_saved_filters(spark, str(p)).collect()
    assert [(r["name"], r["expression"]) for r in rows] == [("Heavy", "load > 15")]
    assert load_saved_filters(spark, cwd=str(tmp_path)).count() == 1
    assert load_saved_filters(spark, enabled=False).count() == 0
    (tmp_path / "bad.csv").write_text("filter\nx > 1\n")
    with pytest.raises(ValueError, match="name,expression"):
        load_saved_filters(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(FileNotFoundError):
        load_saved_filters(spark, str(tmp_path / "nope.csv"))


def test_geojson_roundtrip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"PostcodeArea": "AB", "n": 1},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"PostcodeArea": "AL"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[0.5, 0.5], [1, 0], [1, 1], [0.5, 0.5]]]]}},
    ]}
    p = tmp_path / "areas.geojson"
    p.write_text(json.dumps(doc))
    b = read_boundaries(spark, str(p), "PostcodeArea")
    rows = {r["key"]: json.loads(r["geometry"]) for r in b.collect()}
    assert rows["AB"]["type"] == "Polygon" and rows["AL"]["coordinates"][0][0][0] == [0.5, 0.5]
    out = str(tmp_path / "lines")
    write_features(b, out, "PostcodeArea")
    again = read_boundaries(spark, out, "PostcodeArea", lines=True)
    assert {r["key"]: r["properties"].get("n") for r in again.collect()} == {"AB": "1", "AL": None}
    with pytest.raises(ValueError):
        read_boundaries(spark, str(p), "PostcodeSector")


def _wkb_polygon(order="<"):
    flag = 1 if order == "<" else 0
    ring = [(0.1234567, 1.0), (2.0, 1.0), (2.0, 3.0), (0.1234567, 1.0)]
    body = struct.pack(order + "I", 1) + struct.pack(order + "I", len(ring))
    body += b"".join(struct.pack(order + "dd", *pt) for pt in ring)
    return bytes([flag]) + struct.pack(order + "I", 3) + body


def test_wkb_decode(spark):
    little = json.loads(decode_geometry(_wkb_polygon("<")))
    big = json.loads(decode_geometry(_wkb_polygon(">")))
    assert little == big and little["type"] == "Polygon" and little["coordinates"][0][0] == [0.123457, 1.0]
    gpkg = b"GP" + bytes([0, 0b0000_0011]) + struct.pack("<i", 4326) + struct.pack("<dddd", 0, 2, 1, 3) + _wkb_polygon()
    assert json.loads(decode_geometry(gpkg)) == little
    point_z = bytes([1]) + struct.pack("<I", 1001) + struct.pack("<ddd", 1.0, 2.0, 3.0)
    assert json.loads(decode_geometry(point_z)) == {"type": "Point", "coordinates": [1.0, 2.0]}
    multi = bytes([1]) + struct.pack("<I", 4) + struct.pack("<I", 2) + point_z + point_z
    assert json.loads(decode_geometry(multi))["coordinates"] == [[1.0, 2.0], [1.0, 2.0]]
    df = spark.createDataFrame([("AB", bytearray(_wkb_polygon())), ("AL", None)], "k string, g binary")
    rows = {r["k"]: r["geometry"] for r in features_from_wkb(df, "g", ["k"]).collect()}
    assert json.loads(rows["AB"]) == little and rows["AL"] is None


def test_profile(spark):
    df = spark.createDataFrame([(i, float(i) * 1.7, "a", i % 3 == 0) for i in range(300)],
                               "age int, price double, name string, flag boolean")
    rows = {r["name"]: r for r in profile(df).collect()}
    assert [rows[c]["kind"] for c in ("age", "price", "name", "flag")] == ["integer", "numeric", "categorical", "categorical"]
    assert rows["age"]["band_suggestion"] == 20.0  # range 299 >= 120; std 86.7 -> rung 50 -> one below = 20
    assert rows["price"]["band_suggestion"] == 50.0  # std 147.5 -> rung 100 -> 50
    assert rows["name"]["band_suggestion"] is None
    assert rows["age"]["row_count"] == 300 and (rows["age"]["min_value"], rows["age"]["max_value"]) == (0, 299)
    small = spark.createDataFrame([(i,) for i in range(50)], "n int")
    assert profile(small).first()["band_suggestion"] == 1.0


def test_saved_filters_bind(spark, tmp_path, rides):
    from kpiframe.operators.filters import check_filters

    p = tmp_path / "spec.csv"
    p.write_text('name,expression\nLong,hours > 3\nTariffs,"tariff IN (\'hour\', \'week\')"\nBroken,wheels = 2\n')
    results = check_filters(rides, load_saved_filters(spark, str(p)))
    assert [(n, ok) for n, ok, _ in results] == [("Long", True), ("Tariffs", True), ("Broken", False)]
    assert results[2][2].startswith("Invalid filter")


def test_profile_reads_every_row(spark):
    # The spread is in the last rows only.
    df = spark.range(30000).select(F.when(F.col("id") < 20000, 0.0).otherwise(F.col("id") * 1.0).alias("v"))
    assert profile(df).first()["band_suggestion"] == 5000.0  # standard deviation about 11,900: rung 10000, one below


def test_file_metadata_folder(spark, tmp_path):
    out = str(tmp_path / "multi.parquet")
    spark.range(100).repartition(3).write.parquet(out)  # a folder with 3 part files and _SUCCESS
    t = load_table(spark, out)
    files = t.file_metadata().collect()
    assert len(files) == 3 and all(r["file_path"].endswith(".parquet") for r in files)
    size = t.total_size().first()
    assert size["files"] == 3 and size["file_size"] == sum(r["file_size"] for r in files)
    assert t.df.count() == 100
