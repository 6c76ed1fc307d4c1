"""Postcode search text -> (level, key) as column expressions (KEY-15).

Rules: upper-case, keep letters and digits ("compact"); nothing left or no
leading letter -> null.  One or two letters only -> area.  Then a sector
"<outward> <first inward digit>" from, in order: two space-separated parts
where the first has a digit and the second starts with one; a compact text
of >= 5 characters ending digit-letter-letter; a compact text ending in a
digit with another digit before it.  Otherwise the leading letters (area).
A bare district such as "AB10" therefore reads as sector "AB1 0", as the
original tool does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_postcode(raw: Column) -> Column:
    """Struct ``(level, key)``; null when the text has no leading letter."""
    value = F.upper(F.regexp_replace(raw.cast("string"), r"^\s+|\s+$", ""))
    compact = F.regexp_replace(value, "[^A-Z0-9]", "")
    area = F.regexp_extract(compact, "^[A-Z]{1,2}", 0)
    parts = F.split(F.trim(F.regexp_replace(value, "[^A-Z0-9 ]", " ")), " +")
    first, second = F.element_at(parts, 1), F.element_at(parts, 2)
    n = F.length(compact)
    head = F.substr(compact, F.lit(1), n - 1)
    by_parts = F.concat(first, F.lit(" "), F.substr(second, F.lit(1), F.lit(1)))
    by_unit = F.concat(F.substr(compact, F.lit(1), n - 3), F.lit(" "), F.substr(compact, n - 2, F.lit(1)))
    by_digit = F.concat(head, F.lit(" "), F.substr(compact, n, F.lit(1)))
    sector = (
        F.when((F.size(parts) >= 2) & first.rlike("[0-9]") & second.rlike("^[0-9]"), by_parts)
        .when((n >= 5) & compact.rlike("[0-9][A-Z]{2}$"), by_unit)
        .when(compact.rlike("[0-9]$") & head.rlike("[0-9]"), by_digit)
    )
    only_letters = compact.rlike("^[A-Z]{1,2}$")
    level = F.when(only_letters, F.lit("area")).when(sector.isNotNull(), F.lit("sector")).otherwise(F.lit("area"))
    key = F.when(only_letters, area).otherwise(F.coalesce(sector, area))
    ok = (compact != "") & (area != "")
    return F.when(ok, F.struct(level.alias("level"), key.alias("key")))


def postcode_lookup(searches: DataFrame, text_col: str, boundaries: DataFrame, level_col: str = "level",
                    key_col: str = "key") -> DataFrame:
    """Parse each search text and flag whether its (level, key) exists in ``boundaries`` (GEO-11).

    ``boundaries`` holds one row per feature with its level and key; the
    lookup is an equi-join, left-outer so unknown postcodes stay ("not found").
    """
    parsed = searches.withColumn("__pc", parse_postcode(F.col(text_col))).select(
        "*", F.col("__pc.level").alias("search_level"), F.col("__pc.key").alias("search_key")
    ).drop("__pc")
    feats = boundaries.select(
        F.col(level_col).alias("__bl"), F.col(key_col).cast("string").alias("__bk")
    ).distinct()
    joined = parsed.join(
        feats, (parsed["search_level"] == feats["__bl"]) & (parsed["search_key"] == feats["__bk"]), "left"
    )
    return joined.withColumn("found", F.col("__bk").isNotNull()).drop("__bl", "__bk")
