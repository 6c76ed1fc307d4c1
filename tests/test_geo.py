import pytest
from pyspark.sql import functions as F

from kpiframe.functions.postcode import parse_postcode
from kpiframe.operators import geo as G
from kpiframe.plans.geo import boundary_join, geo_summary


def rows_by_key(df):
    return {r["key"]: r for r in df.collect()}


def test_area_summary(stations):
    res = geo_summary(stations, "area", "spend")
    rows = rows_by_key(res.rows)
    assert {k: (r["value"], r["denominator"], r["row_count"]) for k, r in rows.items()} == {"NO": (8, 3, 3), "SU": (27, 3, 3)}
    assert res.quality.first()["value"] == 7 and res.totals.first()["value"] == pytest.approx(149 / 7)


def test_sector_weight_filter(stations):
    res = geo_summary(stations, "sector", "spend", weight="hours", filter="PostcodeArea = 'SU'")
    rows = rows_by_key(res.rows)
    assert (rows["SU 1"]["value"], rows["SU 1"]["denominator"]) == (5, 4)
    assert rows["SU 2"]["value"] is None and rows["SU 2"]["denominator"] == 0 and rows["SU 2"]["row_count"] == 2
    assert res.quality.first()["filtered_row_count"] == 3
    assert [r["code"] for r in res.warnings.orderBy("position").collect()] == ["missing_weight", "zero_weight"]


def test_named_columns(stations):
    assert set(rows_by_key(geo_summary(stations, "area", "spend", key_col="district").rows)) == {"D1", "D2", "D3", "D4"}
    defaults = {"unit_column": "point", "latitude_column": "north", "longitude_column": "east"}
    res = geo_summary(stations, "unit", "spend", defaults=defaults)
    assert res.key_column == "point" and rows_by_key(res.rows)["P1"]["latitude"] == pytest.approx(41.25)
    assert geo_summary(stations, "unit", "spend", key_col="PostcodeUnit", defaults=defaults).key_column == "PostcodeUnit"


def test_unit_points(stations):
    res = geo_summary(stations, "units", "spend", weight="hours")
    s = res.point_summary.first()
    assert (s["summary_count"], s["plotted_count"], s["missing_value_count"], s["missing_coordinate_count"]) == (5, 3, 1, 1)
    rows = rows_by_key(res.rows)
    assert rows["NO 7-1"]["latitude"] == pytest.approx(40.25) and rows["NO 7-1"]["longitude"] == pytest.approx(10.25)
    assert rows["NO 8-4"]["value"] == 4


def test_errors(stations):
    for level in ("area", "unit"):
        with pytest.raises(ValueError, match=f"valid {level} postcode column"):
            geo_summary(stations, level, "spend", key_col="nowhere")
    with pytest.raises(ValueError, match="numeric latitude"):
        geo_summary(stations, "unit", "spend", lat_col="district")
    with pytest.raises(ValueError, match="numeric longitude"):
        geo_summary(stations, "unit", "spend", lon_col="nowhere")
    with pytest.raises(ValueError, match="map level"):
        geo_summary(stations, "street", "spend")
    with pytest.raises(ValueError, match="Actual"):
        geo_summary(stations, "area", "district")


def test_aliases(spark):
    df = spark.createDataFrame([("w1", "w1-2", 3.5, -7.0, 2)], "POSTCODE_AREA string, POSTCODE_UNIT string, LATITUDE double, LONGiTUDE double, n int")
    assert geo_summary(df, "areas", "n").key_column == "POSTCODE_AREA"
    point = geo_summary(df, "unit", "n").rows.first()
    assert (point["latitude"], point["longitude"]) == (3.5, -7.0)


def test_boundary_join_scale_and_hotspots(spark):
    summary = spark.createDataFrame([("a", 4.0), ("b", 4.0), ("c", 9.0), ("d", None), ("e", 1.0), ("f", float("nan"))], "key string, value double")
    bounds = spark.createDataFrame([(k, "{}") for k in "abcdefz"], "place string, geometry string")
    res = boundary_join(summary, bounds, "place", hotspots=2)
    feats = {r["place"]: r for r in res.features.collect()}
    assert len(feats) == 7 and not feats["z"]["matched"] and feats["z"]["bucket"] is None and not feats["f"]["matched"]
    assert {k for k, r in feats.items() if r["selected"]} == {"c", "b"}  # of equal values the larger key
    # Ranks: e 1, a 2, b 3, c 4; of 100 thresholds 25 are e's, 50 of value 4, 24 of c's.
    assert [feats[k]["bucket"] for k in "eabc"] == [0, 25, 25, 75]
    stats = res.stats.first()
    assert (stats["features"], stats["matched"], stats["summary_rows"], stats["no_match_warning"]) == (7, 4, 6, False)
    legend = {r["bin"]: r for r in res.legend.collect()}
    assert sum(r["keys"] for r in legend.values()) == 6 and legend[-1]["keys"] == 2
    assert [(r["key"], r["rank"]) for r in G.hotspots(summary, -2).orderBy("rank").collect()] == [("e", 1), ("a", 2)]
    assert G.hotspots(summary, 0).count() == 0
    nothing = boundary_join(summary.where("key = 'd'"), bounds, "place").stats.first()
    assert nothing["matched"] == 0 and nothing["no_match_warning"]


def test_quantile_thresholds_rule(spark):
    df = spark.createDataFrame([(f"k{i}", float(i)) for i in range(1, 8)], "key string, value double")
    th = [r["threshold"] for r in G.quantile_thresholds(df, 3).orderBy("i").collect()]
    # n=7, b=3 -> ranks ceil(7/3)=3, ceil(14/3)=5
    assert th == [3.0, 5.0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("ab", ("area", "AB")),
        ("AB10 1AA", ("sector", "AB10 1")),
        ("ab101aa", ("sector", "AB10 1")),
        ("AB10 1", ("sector", "AB10 1")),
        ("AB10", ("sector", "AB1 0")),
        ("AB1", ("area", "AB")),
        ("10AB", None),
        ("", None),
    ],
)
def test_postcode_parse(spark, text, expected):
    row = spark.createDataFrame([(text,)], "s string").select(parse_postcode(F.col("s")).alias("p")).first()["p"]
    assert (None if row is None else (row["level"], row["key"])) == expected


def test_geo_payload(stations, tmp_path):
    import json

    res = geo_summary(stations, "sector", "spend", weight="hours", filter="PostcodeArea = 'SU'")
    path = str(tmp_path / "rows")
    p = res.payload(path)
    assert (p["row_count"], p["filtered_row_count"], p["denominator"]["value"]) == (7, 3, 4)
    assert (p["level"], p["level_label"], p["join_property"], p["join_column"]) == ("sector", "sectors", "PostcodeSector", "PostcodeSector")
    rows = sorted((json.loads(r["value"]) for r in res.source.sparkSession.read.text(path).collect()), key=lambda r: r["key"])
    assert rows[0] == {"key": "SU 1", "row_count": 1, "numerator": 20, "denominator": 4, "volume": 4, "value": 5}
    assert rows[1]["value"] is None
    units = geo_summary(stations, "unit", "spend").payload()
    assert units["point_summary"]["plotted_count"] == 4


def test_geo_from_request(stations):
    from kpiframe.plans.geo import geo_from_request

    request = {"level": "unit", "numerator": "spend", "unitColumn": "point", "latitudeColumn": "north"}
    res = geo_from_request(stations, request, {"longitude_column": "east"})
    assert res.level == "unit" and res.rows.count() == 5


def test_empty_result_warnings(stations):
    res = geo_summary(stations, "area", "spend", filter="spend < 0")
    assert [r["message"] for r in res.warnings.collect()] == ["No non-empty PostcodeArea values were found after filtering."]
    res = geo_summary(stations, "unit", "spend", filter="lat < -90")
    assert [r["message"] for r in res.warnings.collect()] == ["No plot-ready PostcodeUnit points were found after filtering."]
