import pytest
from pyspark.sql import functions as F

from kpiframe.functions.arguments import Argument
from kpiframe.plans.chart import chart, chart_from_request


def by_x(rows):
    return {r["x"]: r for r in rows}


def shown(res, *columns):
    return [tuple(r[c] for c in columns) for r in res.rows.orderBy("position").collect()]


def test_average_of_rows(rides):
    res = chart(rides, "tariff", "spend", "forecast", filter="age >= 23")
    # day: one ride left; hour: (6 + 3) / 2; week: (50 + 70) / 2
    assert shown(res, "x", "volume", "resp0", "resp1") == [
        ("day", 1, 14, 15), ("hour", 2, 4.5, 5.25), ("week", 2, 60, 62.5)]
    totals = {r["label"]: r["value"] for r in res.totals.collect()}
    assert totals == {"Actual": pytest.approx(143 / 5), "Expected": pytest.approx(150.5 / 5)}
    quality = res.quality.first()
    assert (quality["value"], quality["filtered_row_count"]) == (5, 5)
    assert (res.weight.label, res.weight.bar_label) == ("Average row value", "Row count")


def test_per_weight(rides):
    res = chart(rides, "tariff", "spend", weight="hours")
    # day 22 / 6 hours, hour 9 / 2, week 120 / 12
    assert shown(res, "x", "volume", "resp0") == [
        ("day", 6, pytest.approx(22 / 6)), ("hour", 2, 4.5), ("week", 12, 10)]
    assert res.quality.first()["value"] == 20


def test_rows_without_a_response_leave_every_sum(spark):
    df = spark.createDataFrame([("p", 4.0, 1.0), ("p", 6.0, None), ("q", None, 2.0), ("q", 9.0, 3.0)], "k string, a double, b double")
    res = chart(df, "k", "a", "b")
    assert shown(res, "x", "volume", "resp0", "resp1") == [("p", 1, 4, 1), ("q", 1, 9, 3)]
    assert [r["message"] for r in res.warnings.collect()] == [
        "2 rows excluded from Weight because one or more selected response values were missing."]
    assert res.quality.first()["missing_response_rows"] == 2


def test_odd_weights_are_counted(spark):
    df = spark.createDataFrame([("p", 1.0, 0.0), ("p", 2.0, 0.0), ("q", 3.0, -2.0), ("q", 4.0, None), ("q", 5.0, 9.0)],
                               "k string, a double, w double")
    res = chart(df, "k", "a", weight="w")
    assert shown(res, "x", "volume", "resp0") == [("p", 0, None), ("q", 7, pytest.approx(8 / 7))]
    assert [(r["code"], r["count"], r["message"]) for r in res.warnings.orderBy("position").collect()] == [
        ("missing_weight", 1, "1 row excluded from Weight because w was missing."),
        ("zero_weight", 2, "2 rows have zero w."),
        ("negative_weight", 1, "1 row has negative w."),
    ]


@pytest.mark.parametrize("text, left", [
    ("tariff <> 'day'", {"hour", "week"}),
    ('"Load.Kg" < 10', {"day", "week"}),
    ("day < DATE '2023-06-12' AND hours > 1", {"day"}),
    ("tariff = 'say \"hi\"' OR \"age\" = 58", {"hour"}),
])
def test_filters(rides, text, left):
    assert {r["x"] for r in chart(rides, "tariff", "spend", filter=text).rows.collect()} == left


@pytest.mark.parametrize("text, complaint", [
    ("age > 1; SELECT 2", "single .*expression"), ("age > 1 -- all", "single .*expression"), ("age + 1", "Invalid filter"),
    ("height > 1", "Invalid filter"), ("age > (", "Invalid filter"), ("reflect('java.lang.Math', 'abs', 1) = '1'", "reflection"),
])
def test_bad_filters(rides, text, complaint):
    with pytest.raises(ValueError, match=complaint):
        chart(rides, "tariff", "spend", filter=text)


def test_bad_arguments(rides):
    with pytest.raises(ValueError, match="Weight"):
        chart(rides, "tariff", "spend", weight="tariff")
    with pytest.raises(ValueError, match="x-axis"):
        chart(rides, "colour", "spend")
    with pytest.raises(ValueError, match="quantiles"):
        chart(rides, "age", "spend", quantiles=1001)
    with pytest.raises(ValueError, match="responses"):
        chart(rides, "tariff", responses=["spend", "forecast", "hours"])


def test_bands(rides):
    assert shown(chart(rides, "age", "spend", band=25), "x", "volume", "resp0") == [
        ("0", 2, 11), ("25", 2, 28), ("50", 2, 36.5)]
    assert [x for (x,) in shown(chart(rides, "spend", "hours", band=0.5, filter="spend < 7"), "x")] == ["3.0", "6.0"]
    assert len(shown(chart(rides, "age", "spend", band="auto"), "x")) == 6  # range 45: value by value


def test_quantiles_and_missing(spark):
    df = spark.createDataFrame([(i, float(v) if v else None, float(i)) for i, v in enumerate([9, 1, 0, 4, 4, 0, 7, 2])],
                               "id int, v double, a double")
    # Values in order: 1(1) 2(7) 4(3) 4(4) 7(6) 9(0); null v for ids 2 and 5.
    assert shown(chart(df, "v", "a", quantiles=4, tie_by=["id"]), "x", "volume", "resp0") == [
        ("Q1", 2, 4), ("Q2", 2, 3.5), ("Q3", 1, 6), ("Q4", 1, 0), ("Missing", 2, 3.5)]
    merged = chart(df, "v", "a", quantiles=4, tie_by=["id"], low_weight="3")
    assert [x for (x,) in shown(merged, "x")] == ["Q1", "Q2", "High tail", "Missing"]


def test_default_ties_read_only_columns_in_use(spark, tmp_path):
    path = str(tmp_path / "wide.parquet")
    spark.range(300).selectExpr("id % 5 AS x", "id % 7 AS a", "id % 3 AS w", "repeat('z', 50) AS note").write.parquet(path)
    res = chart(spark.read.parquet(path), "x", "a", weight="w", quantiles=7)
    again = chart(spark.read.parquet(path).orderBy("a"), "x", "a", weight="w", quantiles=7)
    assert shown(res, "x", "volume", "resp0") == shown(again, "x", "volume", "resp0")
    plan = res.scanned._jdf.queryExecution().toString()
    assert "note" not in plan.split("ReadSchema", 1)[-1]


@pytest.mark.parametrize("raw, tiles, amount", [("7.5", 8, 7.5), (" 3 ", 3, 3.0), ("-2", 1, None), ("x", 1, None),
                                                (None, 1, None), ("1e2", 100, 100.0), ("inf", 1, None), (0.2, 1, 0.2), ("", 1, None)])
def test_numbers_from_requests(raw, tiles, amount):
    assert Argument(raw).tiles() == tiles and Argument(raw).amount() == amount
    assert Argument("4000").tiles(1000) == 1000


@pytest.mark.parametrize("raw, on", [(True, True), ("Yes", True), (" quantiles ", True), ("1", True), (False, False), (None, False), ("off", False)])
def test_switches(raw, on):
    assert Argument(raw).switched_on() is on


def test_bounds_of_tails(rides):
    res = chart(rides, "age", "spend", "forecast", low_weight="2", sigma=3, fold_by=["age"])
    rows = res.rows.orderBy("position").collect()
    assert [r["x"] for r in rows] == ["Low tail", "37", "41", "High tail"]
    low = rows[0]
    # Both members in folds of their own: differences 8 - 7 and 14 - 15, spread sqrt(2), over sqrt(2) folds.
    assert low["valid_folds"] == 2 and low["sigma_se"] == pytest.approx(1.0)
    assert (low["resp1_low"], low["resp1_high"]) == (pytest.approx(11 - 3), pytest.approx(11 + 3))
    assert rows[1]["sigma_se"] is None and rows[1]["resp1_low"] is None


def test_null_fold_keys_have_folds(spark):
    df = spark.createDataFrame([(None if i % 3 else i, "a", float(i), float(i * i)) for i in range(60)], "k int, c string, a double, b double")
    from kpiframe.operators.sigma import fold_column

    folds = {r[0] for r in df.select(fold_column(["k", "c"])).collect()}
    assert None not in folds and folds <= set(range(20))
    swapped = spark.createDataFrame([(None, "a"), ("a", None)], "p string, q string")
    from kpiframe.operators.sigma import FOLDS

    assert swapped.select(fold_column(["p", "q"])).count() == 2 and FOLDS == 20


def test_calendar_buckets(spark):
    df = spark.createDataFrame([("2022-12-30 23:00:00", 2.0), ("2023-01-01 00:30:00", 4.0), (None, 8.0), ("2023-01-02 00:00:00", 6.0)],
                               "t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert shown(chart(df, "t", "v", bucket="week"), "x", "resp0") == [
        ("2022-12-26 00:00:00", 3), ("2023-01-02 00:00:00", 6), ("(missing)", 8)]
    assert shown(chart(df, "t", "v", bucket="year"), "x", "volume") == [
        ("2022-01-01 00:00:00", 1), ("2023-01-01 00:00:00", 2), ("(missing)", 1)]


def test_other_and_orders(spark):
    rows = [("Zinc", 3.0)] * 4 + [("ash", 8.0)] * 3 + [("oak", 5.0)] * 2 + [("elm", 1.0)] * 2 + [(None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    merged = chart(df, "k", "v", low_weight="2", sort="volume")
    assert shown(merged, "x", "volume", "is_tail") == [("Other", 5, True), ("Zinc", 4, False), ("ash", 3, False)]
    assert [x for (x,) in shown(chart(df, "k", "v", sort="actual"), "x")] == ["ash", "oak", "Zinc", "(missing)", "elm"]
    assert [x for (x,) in shown(chart(df, "k", "v"), "x")] == ["(missing)", "ash", "elm", "oak", "Zinc"]


def test_transforms(spark):
    df = spark.createDataFrame([("p", -2.0), ("q", 0.25), ("r", 1.0), ("s", 900.0)], "k string, v double")
    res = chart(df, "k", "v", transform="log")
    assert by_x(res.rows.collect())["p"]["resp0"] is None and by_x(res.rows.collect())["r"]["resp0"] == 0
    assert [r["message"] for r in res.warnings.collect()] == [
        "1 response values could not be shown because they are outside the log transform domain."]
    logit = by_x(chart(df, "k", "v", transform="logit").rows.collect())
    assert logit["q"]["resp0"] == pytest.approx(-1.0986122886681098) and logit["r"]["resp0"] is None
    assert by_x(chart(df, "k", "v", transform="exp").rows.collect())["s"]["resp0"] is None
    zero = by_x(chart(df, "k", "v", transform="zero", max_groups=3).rows.collect())
    assert zero["r"]["resp0"] == pytest.approx(1 - (-2 + 0.25 + 1) / 3)  # over the shown groups


def test_every_group_and_caps(spark):
    from kpiframe.operators.ordering import table_page

    df = spark.range(24000).select((F.col("id") % 12000).alias("x"), F.lit(1.0).alias("v"))
    whole = chart(df, "x", "v")
    assert whole.rows.count() == 12000 and not whole.rows.where("truncated").count() and whole.warnings.count() == 0
    capped = chart(df, "x", "v", max_groups=50)
    assert capped.rows.count() == 50 and capped.rows.where("truncated").count() == 50
    assert [r["message"] for r in capped.warnings.collect()] == ["Only the first 50 groups are shown."]
    assert not chart(df, "x", "v", max_groups=12000).rows.where("truncated").count()
    page = table_page(whole.rows, page=99, page_size=5000).collect()
    assert {(r["page"], r["pages"]) for r in page} == {(3, 3)}
    assert sorted(r["position"] for r in page) == list(range(10001, 12001))


def test_defaults_and_counts(rides):
    from kpiframe.operators.profile import chart_defaults

    assert chart_defaults(rides) == {"x": "age", "actual": "age", "expected": None, "weight": None, "band": 1.0}
    wanted = chart_defaults(rides, {"x": "spend", "actual": "forecast", "weight": "colour"})
    # Standard deviation of spend is about 28.3: rung 20, one below is 10.
    assert (wanted["actual"], wanted["weight"], wanted["band"]) == ("forecast", None, 10.0)
    counts = chart(rides, "age", "spend", filter="spend > 5").counts.first()
    assert (counts["row_count"], counts["filtered_row_count"]) == (6, 5)


def test_payload(rides):
    res = chart(rides, "tariff", "spend", weight="hours", filter="hours < 7", max_groups=2)
    assert res.payload() == {
        "x": "tariff", "x_kind": "categorical", "row_count": 6, "filtered_row_count": 5, "filter": "hours < 7",
        "responses": [{"label": "Actual", "numerator": "spend"}],
        "denominator": {"column": "hours", "label": "hours", "bar_label": "hours", "value": 13, "missing_response_rows": 0,
                        "missing_weight_rows": 0, "zero_weight_rows": 0, "negative_weight_rows": 0},
        "response_summaries": [{"label": "Actual", "value": pytest.approx(81 / 13), "numerator": 81, "denominator": 13}],
        "rows": [{"x": "day", "volume": 6, "is_tail": False, "valid_folds": None, "resp0": pytest.approx(22 / 6)},
                 {"x": "hour", "volume": 2, "is_tail": False, "valid_folds": None, "resp0": 4.5}],
        "warnings": ["Only the first 2 groups are shown."],
    }
    with pytest.raises(ValueError, match="max_groups"):
        chart(rides, "tariff", "spend").payload()


def test_request(rides):
    request = {"x": "age", "responses": [{"numerator": "tariff"}, {"label": "Spent", "numerator": "spend"}, {"numerator": "forecast"}, {"numerator": "hours"}],
               "quantileMode": "quantile", "bandWidth": "2.5", "lowGroup": "-", "denominator": "__none__"}
    res = chart_from_request(rides, request)
    assert [(r.label, r.column) for r in res.responses] == [("Spent", "spend"), ("forecast", "forecast")]
    assert shown(res, "x", "resp0") == [("Q1", 11), ("Q2", 28), ("Q3", 36.5)] and res.max_groups == 10_000
