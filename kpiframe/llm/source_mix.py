"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

*Targets.* Sources in code-point order (null last) weigh 3, 1, 2, repeating. They share ``share`` times all
words; no source gets more than ``most`` times its own size, and the excess is shared again by weight until none
is above. That is one water level: with sources sorted by capacity per weight, every source is full up to the
first one whose capacity the level does not reach.

*Blocks.* Each source's documents stand in a shuffled order (md5 of seed and id) on a line of words that starts
again when the source is used up. The line is cut into blocks of ``block`` words. Running sums come from two
levels, within hash ranges and over ranges, so no source needs all its rows in one task.

*Schedule.* Slot n has the point ``frac((n + 1) * golden ratio)``. The cumulative targets map the point to a source; the
slot's rank among its source's slots is the block it takes. Ranks also come from two levels (ranges of slots).
A source that the schedule leaves short of its last few blocks (the discrepancy, a few blocks for any number of
slots) gets them at the end, and slots beyond its target are dropped, so its words meet the target exactly.

Defined results: null text has size 0; a document of size 0 and one beyond every target is taken 0 times; a
null source is a source, last in order; repeated rows and null ids are documents of their own, ordered by where they are
stored; very long texts count whole; an empty table gives none; other columns are ignored by the mix and kept by
:func:`mixed_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiframe.llm.common import WORD_OF_SIZE, fresh, located, place_of, shuffle_partitions, stored, written

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 256
#: Fractional part of the golden ratio as a multiplier modulo 2**32 (Knuth's multiplicative constant).
GOLDEN_32 = 2654435769
#: Rows of one level of the running sums, on average.
RANGE_ROWS = 5_000
#: A range with more rows (null or equal ids) is cut into parts. At most one range in four of a table's can be one.
HOT_RANGE = 4 * RANGE_ROWS
#: The unit line is cut into this many cells, so that points meet sources by an equality join.
CELLS = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_OF_SIZE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, source_size, weight, target, and its place on the unit line (low, high).

    ``sizes`` has source and size. All windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    totals = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("no", F.row_number().over(order))
        .withColumn("weight", F.element_at(weights, ((F.col("no") - 1) % len(WEIGHTS) + 1).cast("int")))
        .withColumn("room", F.col("source_size") * float(most))
    )
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("room") / F.col("weight"), "no").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        totals.withColumn("before_room", F.coalesce(F.sum("room").over(fill), F.lit(0.0)))
        .withColumn("before_weight", F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("words", F.sum("source_size").over(every) * float(share))
        # What a unit of weight gets when every source before this one is full.
        .withColumn(
            "each", (F.col("words") - F.col("before_room")) / (F.col("all_weight") - F.col("before_weight"))
        )
        .withColumn("full", F.col("room") / F.col("weight") <= F.col("each"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("each"))).over(every))
        .withColumn(
            "target", F.when(F.col("full"), F.col("room")).otherwise(F.col("weight") * F.col("level"))
        )
    )
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return level.withColumn("sum_target", F.sum("target").over(so_far)).select(
        "source",
        "source_size",
        "weight",
        "target",
        F.coalesce((F.col("sum_target") - F.col("target")) / F.sum("target").over(every), F.lit(0.0)).alias("low"),
        F.coalesce(F.col("sum_target") / F.sum("target").over(every), F.lit(0.0)).alias("high"),
        F.floor("target").cast("long").alias("goal"),
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def shuffled_lines(sized: DataFrame, rows: int, seed: str) -> DataFrame:
    """``sized`` (doc_id, source, size, place) with ``start``: words before the document on its source's line."""
    ranges = max(1, -(-rows // RANGE_ROWS))
    keyed = sized.withColumn("mix", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    # The first 32 bits of the digest cut its order into ranges of about the same number of rows.
    keyed = keyed.withColumn(
        "range", F.floor(F.conv(F.substring("mix", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(2**32))
    )
    per_range = lambda df, *by: df.groupBy("source", *by).agg(F.sum("size").alias("range_size"), F.count(F.lit(1)).alias("n"))
    sums = per_range(keyed, "range")
    hot = sums.filter(F.col("n") > HOT_RANGE).select(
        F.col("source").alias("s"), F.col("range").alias("r"), F.ceil(F.col("n") / RANGE_ROWS).alias("parts")
    )
    if hot.isEmpty():
        keyed = keyed.withColumn("part", F.lit(0).cast("long"))
        sums = sums.withColumn("part", F.lit(0).cast("long"))
    else:
        # Null or equal ids have one digest: their range is cut further by where the rows are stored.
        cut = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("place"), F.col("parts"))).otherwise(F.lit(0))
        keyed = keyed.join(F.broadcast(hot), _same(F.col("source"), F.col("s")) & (F.col("range") == F.col("r")), "left")
        keyed = keyed.withColumn("part", cut.cast("long")).drop("s", "r", "parts")
        sums = per_range(keyed, "range", "part")
    before = Window.partitionBy("source").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("s"), F.col("range").alias("r"), F.col("part").alias("p"),
        F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start"),
    )
    within = (
        Window.partitionBy("source", "range", "part")
        .orderBy("mix", F.col("doc_id").asc_nulls_last(), "size", "place")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        keyed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(sums, _same(F.col("source"), F.col("s")) & (F.col("range") == F.col("r")) & (F.col("part") == F.col("p")))
        .withColumn("start", F.col("range_start") + F.col("inner"))
        .drop("mix", "range", "part", "s", "r", "p", "range_start", "inner")
    )


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: slot (its order), source, block (rank among the source's slots)."""
    spark = targets.sparkSession
    need = targets.withColumn("blocks", F.ceil(F.col("goal") / block).cast("long"))
    slots = int(need.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"])
    bounds = need.select(
        "source", "blocks", F.floor(F.col("low") * 2**32).cast("long").alias("from_point"),
        F.floor(F.col("high") * 2**32).cast("long").alias("to_point"),
    )
    point = F.col("slot") + 1
    # (slot + 1) * golden modulo 2**32 without leaving a long: both halves of the slot number separately.
    high_part = (F.shiftright(point, 16) * F.lit(GOLDEN_32) % 65536) * 65536
    low_part = point.bitwiseAND(F.lit(65535)) * F.lit(GOLDEN_32)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn(
        "point", (high_part + low_part) % F.lit(2**32)
    )
    # Sources stand in every cell that their interval meets; inside a cell the intervals are disjoint.
    wide = 2**32 // CELLS
    cells = bounds.filter("to_point > from_point").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("from_point") / wide), F.floor((F.col("to_point") - 1) / wide)))
    )
    dealt = points.withColumn("cell", F.floor(F.col("point") / wide)).join(cells, "cell").filter(
        (F.col("point") >= F.col("from_point")) & (F.col("point") < F.col("to_point"))
    )
    dealt = dealt.select("slot", "source", "blocks", F.floor(F.col("slot") / RANGE_ROWS).alias("range"))
    counts = dealt.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("source").alias("s"), F.col("range").alias("r"), "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"),
    )
    rank = F.row_number().over(Window.partitionBy("source", "range").orderBy("slot"))
    ranked = (
        dealt.withColumn("inner", rank - 1)
        .join(counts, _same(F.col("source"), F.col("s")) & (F.col("range") == F.col("r")))
        .withColumn("block", F.col("ahead") + F.col("inner"))
        .filter(F.col("block") < F.col("blocks"))
        .select("slot", "source", "block")
    )
    given = counts.groupBy("s").agg(F.sum("n").alias("given"))
    late = (
        need.join(given, _same(F.col("source"), F.col("s")), "left")
        .withColumn("given", F.coalesce("given", F.lit(0)))
        .filter(F.col("given") < F.col("blocks"))
        .select("source", F.explode(F.sequence(F.col("given"), F.col("blocks") - 1)).alias("block"))
        .select((F.lit(slots) + F.col("block")).alias("slot"), "source", "block")
    )
    return ranked.unionByName(late)


def _spot(source: Column, number: Column) -> Column:
    """Source (may be null) and a number as one text: a plain equality key, so a hot source spreads out."""
    return F.concat_ws(
        ":", F.when(source.isNull(), "0").otherwise("1"), number.cast("string"), F.coalesce(source, F.lit(""))
    )


def mix_sources(
    docs: DataFrame, *, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: str = "mix"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, source, text) as ``(lines, targets, plan)``.

    ``lines``: every document with size and start, its first word's place on its source's line; ``targets``: one
    row per source; ``plan``: one row per piece of a document in a scheduled block: slot, source, start (names
    the document, with source), doc_id, round (0: first use of the document), from_word, to_word.
    """
    sized = written(
        located(docs, "doc_id", "source", "text").select("doc_id", "source", size_of(F.col("text")).alias("size"), "place"),
        "mix-sizes",
    )
    targets = source_targets(sized, share, most)
    lines = shuffled_lines(sized, sized.count(), seed)
    goals = targets.select(F.col("source").alias("s"), "source_size", "goal").filter("goal > 0")
    pieces = (
        lines.filter("size > 0")
        .join(goals, _same(F.col("source"), F.col("s")))
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(int(most)))))
        .withColumn("at", F.col("start") + F.col("round") * F.col("source_size"))
        .filter(F.col("at") < F.col("goal"))
        .withColumn("until", F.least(F.col("at") + F.col("size"), F.col("goal")))
        .withColumn("b", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("until") - 1) / block))))
        .select(
            _spot(F.col("source"), F.col("b")).alias("spot"), "doc_id", "start", "round",
            (F.greatest("at", F.col("b") * block) - F.col("at")).alias("from_word"),
            (F.least("until", (F.col("b") + 1) * block) - F.col("at")).alias("to_word"),
        )
    )
    slots = schedule(targets, block).withColumn("spot", _spot(F.col("source"), F.col("block")))
    plan = slots.join(pieces, "spot").select("slot", "source", "start", "doc_id", "round", "from_word", "to_word")
    return lines, targets, plan


def taken_words(lines: DataFrame, targets: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_slot (the first scheduled slot that takes words
    of it, null if none does), source, start, place."""
    taken = (
        plan.select(_spot(F.col("source"), F.col("start")).alias("spot"), (F.col("to_word") - F.col("from_word")).alias("n"), "slot")
        .groupBy("spot")
        .agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"))
    )
    goals = targets.select(F.col("source").alias("s"), "source_size", "target")
    return (
        lines.withColumn("spot", F.when(F.col("size") > 0, _spot(F.col("source"), F.col("start"))))
        .join(taken, "spot", "left")
        .join(goals, _same(F.col("source"), F.col("s")))
        .select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
            "first_slot", "source", "start", "place",
        )
    )


def _partition_keys(spark: SparkSession, parts: int) -> list[int]:
    """Numbers that hash partitioning sends to partitions 0, 1, 2, ... of ``parts``."""
    tries = spark.range(64 * parts + 64)
    found = tries.groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.min("id").alias("key")).orderBy("part").collect()
    return [r["key"] for r in found] if len(found) == parts else list(range(parts))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, all columns and whole texts: each as often as it is taken. The document on which a
    source's target ends is taken or left whole, whichever ends nearer to the target.

    The rows stand in the order of the schedule: by the slot in which a use of a document begins, and inside a slot
    as on the source's line. Slots are numbered without gaps, so equal runs of them are the partitions.
    """
    docs = stored(docs)
    spark, columns = docs.sparkSession, docs.columns
    lines, _, plan = mix_sources(docs, **settings)
    place, at, slot, turn, start, part = (fresh(columns, f"__{c}") for c in ("place", "at", "slot", "turn", "start", "part"))
    uses = plan.groupBy(_spot(F.col("source"), F.col("start")).alias("spot"), "round").agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("words"), F.min("slot").alias("slot")
    )
    named = lines.filter("size > 0").select(
        _spot(F.col("source"), F.col("start")).alias("spot"), "place", "size", "start"
    )
    uses = written(
        named.join(uses, "spot").filter("2 * words >= size").select(
            F.col("place").alias(at), F.col("slot").alias(slot), F.col("round").alias(turn), F.col("start").alias(start)
        ),
        "mix-uses",
    )
    parts = shuffle_partitions(spark)
    slots = uses.agg(F.coalesce(F.max(slot) + 1, F.lit(1)).alias("n")).first()["n"]
    keys = F.array(*[F.lit(k) for k in _partition_keys(spark, parts)])
    run = F.floor(F.col(slot) * F.lit(parts) / F.lit(slots)).cast("int")
    out = docs.select("*", place_of(docs).alias(place)).join(
        uses.withColumn(part, F.get(keys, run).cast("long")), F.col(place) == F.col(at)
    )
    return out.repartition(parts, part).sortWithinPartitions(slot, turn, start).select(*columns)


#: Rows of the mix query for DuckDB: targets by the same water level, words by position on the shuffled line.
ORACLE = r"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
    COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, SUM(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source IS NULL, encode(source)) AS no FROM sized GROUP BY source
), weighted AS (
  SELECT *, [3.0, 1.0, 2.0][((no - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS room FROM totals
), filled AS (
  SELECT *, (SUM(source_size) OVER () * 1.5::DOUBLE
      - COALESCE(SUM(room) OVER (ORDER BY room / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (SUM(weight) OVER ()
      - COALESCE(SUM(weight) OVER (ORDER BY room / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS each
  FROM weighted
), targets AS (
  SELECT source, source_size, no, CASE WHEN room / weight <= each THEN room
    ELSE weight * MAX(CASE WHEN room / weight > each THEN each END) OVER () END AS target FROM filled
), placed AS (
  SELECT s.*, t.source_size, t.target, floor(t.target)::BIGINT AS goal,
    COALESCE(SUM(size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || doc_id), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), lined AS (
  SELECT source, ceil(floor(target) / 256)::BIGINT AS blocks, SUM(target) OVER (ORDER BY no) AS upto, target, SUM(target) OVER () AS whole
  FROM targets
), bounds AS (
  SELECT source, blocks, floor((upto - target) / whole * 4294967296)::BIGINT AS from_point, floor(upto / whole * 4294967296)::BIGINT AS to_point
  FROM lined
), slots AS (
  SELECT slot, ((slot + 1) * 2654435769::HUGEINT % 4294967296)::BIGINT AS point
  FROM (SELECT unnest(range((SELECT COALESCE(SUM(blocks), 0) FROM lined)::BIGINT)) AS slot)
), dealt AS (
  SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS block
  FROM slots JOIN bounds ON point >= from_point AND point < to_point
), given AS (SELECT source, count(*) AS n FROM dealt GROUP BY source),
scheduled AS (
  SELECT slot, source, block FROM dealt WHERE block < blocks
  UNION ALL
  SELECT (SELECT count(*) FROM slots) + block, source, block FROM (
    SELECT b.source, unnest(range(COALESCE(n, 0), blocks)) AS block FROM bounds b LEFT JOIN given g ON b.source IS NOT DISTINCT FROM g.source
  )
)
SELECT doc_id, size, p.source_size, p.target,
  (greatest(0, least(start + size, goal) - start)
   + greatest(0, least(start + source_size + size, goal) - start - source_size))::BIGINT AS taken,
  CASE WHEN size > 0 AND start < goal THEN slot END::BIGINT AS first_slot
FROM placed p LEFT JOIN scheduled s ON p.source IS NOT DISTINCT FROM s.source AND s.block = p.start // 256
"""
