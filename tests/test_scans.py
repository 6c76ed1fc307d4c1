"""How often a request reads its table and how many jobs it runs, from Spark's event log of a session of its own."""

import json
import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.01"

SCRIPT = """
import json, sys
from pyspark.sql import SparkSession
from kpiframe.plans import registry
from kpiframe.plans.chart import chart
from kpiframe.session import SESSION_DEFAULTS

out, sf = sys.argv[1:]
builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
log = {"enabled": "true", "dir": "file://" + out, "rolling.enabled": "false", "compress": "false"}
for key, value in {**SESSION_DEFAULTS, **{f"spark.eventLog.{k}": v for k, v in log.items()}}.items():
    builder = builder.config(key, value)
spark = builder.getOrCreate()
lineitem = spark.read.parquet(sf + "/lineitem.parquet")

def orders(*parts):
    res = chart(lineitem, "l_returnflag", "l_extendedprice", weight="l_quantity", low_weight="1%")
    for part in parts:
        getattr(res, part).collect()

runs = {
    "rows first": lambda: orders("rows", "totals", "quality", "warnings"),
    "rows last": lambda: orders("quality", "totals", "rows"),
    "sigma": lambda: chart(lineitem, "l_quantity", "l_extendedprice", "l_tax", sigma=2, band=10, low_weight="9%").rows.collect(),
    "tails_percent": lambda: registry.QUERIES["tails_percent"](spark, sf).collect(),
    "sigma_tails": lambda: registry.QUERIES["sigma_tails"](spark, sf).collect(),
    "chart_quantile_band": lambda: registry.QUERIES["chart_quantile_band"](spark, sf).collect(),
    "chart_quantile_ties": lambda: registry.QUERIES["chart_quantile_ties"](spark, sf).collect(),
    "chart_quantile_windows": lambda: registry.QUERIES["chart_quantile_windows"](spark, sf).collect(),
}
for name, run in runs.items():
    spark.sparkContext.setJobGroup(name, name)
    run()
spark.stop()
"""


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    """{request: (records read, jobs)}."""
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    out = tmp_path_factory.mktemp("events")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
    subprocess.run([sys.executable, "-c", SCRIPT, str(out), SF], check=True, env=env, cwd=root, capture_output=True, timeout=600)
    records, jobs, group_of = {}, {}, {}
    for path in out.iterdir():
        for line in path.open():
            event = json.loads(line)
            if event["Event"] == "SparkListenerJobStart":
                group = (event.get("Properties") or {}).get("spark.jobGroup.id")
                jobs[group] = jobs.get(group, 0) + 1
                group_of |= {stage: group for stage in event["Stage IDs"] if stage not in group_of}
            elif event["Event"] == "SparkListenerTaskEnd":
                group = group_of.get(event["Stage ID"])
                read = ((event.get("Task Metrics") or {}).get("Input Metrics") or {}).get("Records Read", 0)
                records[group] = records.get(group, 0) + read
    return {name: (records.get(name, 0), jobs[name]) for name in jobs if name}


@pytest.mark.parametrize("name, rows, scans, jobs", [
    ("rows first", 60_000, 1, 9), ("rows last", 60_000, 1, 9), ("sigma", 60_000, 1, 6), ("tails_percent", 60_000, 1, 5),
    ("sigma_tails", 15_000, 1, 8), ("chart_quantile_band", 15_000, 2, 8), ("chart_quantile_ties", 60_000, 2, 8),
    ("chart_quantile_windows", 60_000, 2, 8),
])
def test_scans_and_jobs(log, name, rows, scans, jobs):
    read, ran = log[name]
    assert read == rows * scans
    assert ran <= jobs
