"""Allow and block rules for URLs by a sort-merge range join.

A rule (host, path, verdict) fits its host and all subdomains, if the URL's path starts with the rule's; the
longest rule (host and path together, then host) wins.

*Keys.* ``sub.example.org`` + ``/path`` becomes ``org.example.sub//path``: labels reversed, a slash, the path. All URLs
that a rule's host covers are then one interval of keys, from ``org.example.`` up to ``org.example0`` (``.``, ``/``
and ``0`` follow each other), and the intervals of hosts are nested or disjoint.
*Ranges.* URLs are range-partitioned by key and id, so that a host, or one URL, with a third of all rows spreads over
many ranges; the ranges are written to the shared folder, which fixes them. A rule goes to the ranges that its interval meets:
together at most the rules plus the nesting depth per range.
*Sweep.* Each range is read in key order with the starts of its rules; a stack holds the hosts whose interval is open.
The innermost is on top, and every open host is asked for its longest path that the URL's path starts with.

Defined results: a null URL or one without ``://`` has empty host and path and gets ``default``; a URL that no
rule fits gets a null rule and ``default``; repeated rows and null ids are kept; an empty table gives an empty
result; without rules every URL gets ``default``; two rules with the same host and path: block wins; very long URLs are
judged whole; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiframe.llm.common import shuffle_partitions, written

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT = "allow"
RULE_SCHEMA = "host string, path string, verdict string"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path and the canonical key."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise("")
    host = F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (
        pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
        .select("page_id", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
        .withColumn(
            "key", F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "."), F.lit("/"), F.col("path"))
        )
    )


def _open_at(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def _closed_at(host: str) -> str:
    return _open_at(host)[:-1] + "0"


def _sweep(rows, rules):
    """Rule and verdict of each (key, path) in key order; ``rules``: (host, path, verdict) that may be open."""
    frames: dict[str, dict[str, str]] = {}
    for host, path, verdict in rules:
        paths = frames.setdefault(host, {})
        paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict
    starts = sorted((_open_at(host), _closed_at(host), host) for host in frames if host)
    sizes = {host: sorted({len(p) for p in paths}, reverse=True) for host, paths in frames.items()}
    stack: list[tuple[str, str]] = []
    following = 0
    for key, path in rows:
        while following < len(starts) and starts[following][0] <= key:
            opened, closed, host = starts[following]
            while stack and stack[-1][0] <= opened:
                stack.pop()
            stack.append((closed, host))
            following += 1
        while stack and stack[-1][0] <= key:
            stack.pop()
        best = None
        for _, host in stack:
            for n in sizes[host]:
                if n <= len(path) and path[:n] in frames[host]:
                    rank = (len(host) + n, len(host))
                    if best is None or rank > best[0]:
                        best = (rank, host + path[:n], frames[host][path[:n]])
                    break
        yield (None, None) if best is None else best[1:]


def url_verdicts(pages: DataFrame, rules: DataFrame | None = None, *, default: str = DEFAULT, ranges: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. ``rules``: host, path, verdict (any number of rows)."""
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    ranges = ranges or shuffle_partitions(spark)
    placed = written(
        parsed(pages).repartitionByRange(ranges, "key", "page_id").withColumn("range", F.spark_partition_id()),
        "url-ranges",
    )
    # One row per range.
    bounds = placed.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("low", "high").collect()
    numbers, lows, highs = ([r[k] for r in bounds] for k in ("range", "low", "high"))

    def send(batches):
        for batch in batches:
            out = []
            for host, path, verdict in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not host:
                    continue
                # Ranges are in key order: those that end at or after the opening and start before the closing.
                for at in range(bisect_left(highs, _open_at(host)), bisect_right(lows, _closed_at(host))):
                    out.append({"range": numbers[at], "host": host, "path": path or "", "verdict": verdict})
            yield pa.RecordBatch.from_pylist(
                out, pa.schema([("range", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())])
            )

    sent = rules.select("host", "path", "verdict").mapInArrow(send, "range int, " + RULE_SCHEMA)
    kind = pages.schema["page_id"].dataType.simpleString()

    def judge(urls, mine):
        urls = urls.sort_by("key")
        found = list(_sweep(zip(urls["key"].to_pylist(), urls["path"].to_pylist()), zip(*(mine[k].to_pylist() for k in ("host", "path", "verdict")))))
        return pa.table(
            [
                urls["page_id"], urls["host"], urls["path"],
                pa.array([r for r, _ in found], pa.string()),
                pa.array([default if r is None else v for r, v in found], pa.string()),
            ],
            ["page_id", "host", "path", "rule", "verdict"],
        )

    return (
        placed.groupBy("range")
        .cogroup(sent.groupBy("range"))
        .applyInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
    )


def oracle() -> str:
    """DuckDB SQL for the verdicts under ``RULES``: every rule is tried on every URL."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {rules}),
cut AS (
  SELECT row_number() OVER () AS rid, page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
)
SELECT page_id, host, path, rhost || rpath AS rule, COALESCE(rverdict, '{DEFAULT}') AS verdict
FROM urls LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) = 1
"""
