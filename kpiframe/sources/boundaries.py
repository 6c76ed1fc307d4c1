"""Boundary features: GeoJSON in and out, and geometry decoding (SRC-6, SNK-2, GEO-1).

A FeatureCollection is one JSON document, but Spark's text reader can cut it where a feature begins: the way its first
feature opens (``{"type":"Feature"`` in the writer's own spacing) is the record separator, so a large document is read
by many tasks and each feature is parsed by Spark's JSON functions. Features are written one per line, or as one
FeatureCollection document per layer. Geometries may also be decoded from a table of WKB / GeoPackage blobs with
:func:`features_from_wkb`, which runs per partition.
"""

from __future__ import annotations

import json
import math
import re
import struct
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_COLLECTION_SCHEMA = "features array<struct<properties: map<string,string>, geometry: string>>"
_FEATURE_SCHEMA = "properties map<string,string>, geometry string"
#: How a feature opens when its type comes first.
_OPENING = re.compile(r'\{\s*"type"\s*:\s*"Feature"')
#: The first feature is looked for in so much of a document.
_HEAD_BYTES = 64 << 10


def _head(spark: SparkSession, path: str) -> str:
    """The beginning of the first file at ``path`` (a file, folder or glob)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(place)
    if not found:
        return ""
    if found[0].isDirectory():
        found = [f for f in system.listStatus(found[0].getPath()) if not f.isDirectory() and f.getPath().getName()[0] not in "_."]
    if not len(found):
        return ""
    stream = system.open(found[0].getPath())
    try:
        return bytes(stream.readNBytes(_HEAD_BYTES)).decode("utf-8", "replace")
    finally:
        stream.close()


def _split_features(spark: SparkSession, path: str, opening: str) -> DataFrame:
    """Features of documents cut at ``opening``; what stands behind a feature (comma, end of the document) is not read."""
    records = spark.read.option("lineSep", opening).text(path)
    # The part before a document's first feature names the collection.
    records = records.where(~F.col("value").rlike(r'^\s*\ufeff?\s*\{'))
    parsed = records.select(F.from_json(F.concat(F.lit(opening), "value"), _FEATURE_SCHEMA).alias("f"), "value")
    broken = F.raise_error(F.lit("a feature could not be cut out of the document; read it with split=False"))
    whole = F.col("f.properties").isNotNull() | F.col("f.geometry").isNotNull() | F.col("value").rlike(r'^\s*[,}]')
    return parsed.select(F.when(whole, F.col("f")).otherwise(broken.cast(parsed.schema["f"].dataType)).alias("f")).select("f.*")


def read_boundaries(
    spark: SparkSession, path: str, key_property: str, lines: bool = False, split: bool = True
) -> DataFrame:
    """``(key, geometry, properties)`` with ``geometry`` the raw GeoJSON text of each feature.

    The schema is given, not inferred: property values are read as text and geometries are kept verbatim.  ``lines``: one
    Feature per line. A FeatureCollection document is cut into features (``split``) if they open with their type, as
    writers commonly do; other documents, and all with ``split=False``, are parsed whole, in one task. Errors when
    no feature has the key property.
    """
    opening = None if lines or not split else _OPENING.search(_head(spark, path))
    if lines:
        feats = spark.read.schema(_FEATURE_SCHEMA).json(path)
    elif opening:
        feats = _split_features(spark, path, opening.group())
    else:
        doc = spark.read.schema(_COLLECTION_SCHEMA).option("multiLine", True).json(path)
        feats = doc.select(F.explode("features").alias("f")).select("f.properties", "f.geometry")
    if feats.where(F.col("properties").getItem(key_property).isNotNull()).isEmpty() and not feats.isEmpty():
        raise ValueError(f"Boundary features have no '{key_property}' property")
    return feats.select(F.col("properties").getItem(key_property).alias("key"), "geometry", "properties")


def _feature_text(features: DataFrame, key_property: str, key_col: str, geometry_col: str, without: tuple[str, ...] = ()) -> Column:
    """A compact GeoJSON Feature: the key, and every other column as a property.

    A ``properties`` map (as :func:`read_boundaries` gives it) is written entry by entry.
    """
    out = {key_col, geometry_col, "properties", key_property, *without}
    own = F.struct(F.col(key_col).cast("string").alias(key_property), *[F.col(c) for c in features.columns if c not in out])
    text = F.to_json(own)
    if "properties" in features.columns:
        more = F.to_json(F.map_filter("properties", lambda k, _: k != F.lit(key_property)))
        some = F.col("properties").isNotNull() & (F.length(more) > 2)
        begun = F.when(text == "{}", "{").otherwise(F.concat(text.substr(F.lit(1), F.length(text) - 1), F.lit(",")))
        text = F.when(some, F.concat(begun, more.substr(F.lit(2), F.length(more)))).otherwise(text)
    return F.concat(
        F.lit('{"type":"Feature","properties":'), text,
        F.lit(',"geometry":'), F.coalesce(F.col(geometry_col), F.lit("null")), F.lit("}"),
    )


def write_features(features: DataFrame, path: str, key_property: str, key_col: str = "key",
                   geometry_col: str = "geometry", mode: str = "overwrite") -> None:
    """Write one compact GeoJSON Feature per line."""
    line = _feature_text(features, key_property, key_col, geometry_col)
    features.select(line.alias("value")).write.mode(mode).text(path)


def write_collections(
    features: DataFrame, path: str, key_property: str, layer_col: str | None = None, key_col: str = "key",
    geometry_col: str = "geometry", name: str = "features", mode: str = "overwrite",
) -> None:
    """Write one FeatureCollection document per layer (a folder ``layer=…`` with one file each), features by key (SNK-2).

    Each document is a text file of one feature per line: the first line also opens the collection, the last closes it,
    and the others end with a comma. A layer's document is written by one task, row by row, because it is one file; without
    ``layer_col`` there is one layer called ``name``. A layer without features has no document.
    """
    layer = F.col(layer_col).cast("string") if layer_col else F.lit(name)
    text = _feature_text(features, key_property, key_col, geometry_col, (layer_col,) if layer_col else ())
    rows = features.select(
        F.coalesce(layer, F.lit(name)).alias("layer"), F.col(key_col).cast("string").alias("__key"), text.alias("__text")
    ).repartition("layer")
    order = Window.partitionBy("layer").orderBy(F.col("__key").asc_nulls_last(), "__text")
    placed = rows.select(
        "layer", "__key", "__text",
        F.lag("layer").over(order).isNull().alias("__first"), F.lead("layer").over(order).isNull().alias("__last"),
    )
    quoted = F.to_json(F.array("layer"))
    opened = F.concat(F.lit('{"type":"FeatureCollection","name":'), quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(',"features":['))
    line = F.concat(
        F.when(F.col("__first"), F.concat(opened, F.lit("\n"))).otherwise(""), F.col("__text"),
        F.when(F.col("__last"), F.lit("]}")).otherwise(","),
    )
    placed.select("layer", line.alias("value")).write.mode(mode).partitionBy("layer").text(path)


# --- WKB / GeoPackage decoding (per-row helper inside mapInPandas) ----------------------

# WKB geometry type codes 1..7 and the GeoPackage header layout
# (magic "GP", version, flags; envelope sizes by indicator 0..4).
_TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString",
          6: "MultiPolygon", 7: "GeometryCollection"}
_ENVELOPE_DOUBLES = {0: 0, 1: 4, 2: 6, 3: 6, 4: 8}


def _strip_gpkg(blob: bytes) -> bytes:
    """WKB payload of a GeoPackage geometry blob (plain WKB passes through)."""
    if len(blob) >= 8 and blob[:2] == b"GP":
        flags = blob[3]
        indicator = (flags >> 1) & 0x07
        if indicator not in _ENVELOPE_DOUBLES:
            raise ValueError("invalid GeoPackage envelope indicator")
        return blob[8 + 8 * _ENVELOPE_DOUBLES[indicator]:]
    return blob


class _Reader:
    def __init__(self, data: bytes, precision: int):
        self.data, self.pos, self.precision = data, 0, precision

    def _unpack(self, fmt: str, size: int):
        value = struct.unpack_from(fmt, self.data, self.pos)
        self.pos += size
        return value

    def geometry(self) -> dict:
        order = "<" if self._unpack("B", 1)[0] == 1 else ">"
        code = self._unpack(order + "I", 4)[0]
        has_z = bool(code & 0x80000000)
        has_m = bool(code & 0x40000000)
        has_srid = bool(code & 0x20000000)
        code &= 0x0FFFFFFF
        if code >= 3000:
            has_z = has_m = True
        elif code >= 2000:
            has_m = True
        elif code >= 1000:
            has_z = True
        base = code % 1000
        if has_srid:
            self._unpack(order + "I", 4)
        dims = 2 + int(has_z) + int(has_m)
        kind = _TYPES.get(base)
        if kind is None:
            raise ValueError(f"unsupported WKB geometry type {code}")

        def point() -> list[float]:
            values = self._unpack(order + "d" * dims, 8 * dims)
            return [round(values[0], self.precision), round(values[1], self.precision)]

        def points() -> list[list[float]]:
            return [point() for _ in range(self._unpack(order + "I", 4)[0])]

        def rings() -> list[list[list[float]]]:
            return [points() for _ in range(self._unpack(order + "I", 4)[0])]

        if kind == "Point":
            coords = point()
            if any(math.isnan(c) for c in coords):
                return {"type": "Point", "coordinates": []}
            return {"type": "Point", "coordinates": coords}
        if kind == "LineString":
            return {"type": kind, "coordinates": points()}
        if kind == "Polygon":
            return {"type": kind, "coordinates": rings()}
        parts = [self.geometry() for _ in range(self._unpack(order + "I", 4)[0])]
        if kind == "GeometryCollection":
            return {"type": kind, "geometries": parts}
        return {"type": kind, "coordinates": [p["coordinates"] for p in parts]}


def decode_geometry(blob: bytes | None, precision: int = 6) -> str | None:
    """GeoJSON text of a WKB / EWKB / GeoPackage blob; None for null input."""
    if blob is None:
        return None
    return json.dumps(_Reader(_strip_gpkg(bytes(blob)), precision).geometry(), separators=(",", ":"))


def features_from_wkb(df: DataFrame, geometry_col: str, key_cols: list[str], precision: int = 6) -> DataFrame:
    """``key_cols`` + ``geometry`` (GeoJSON text) decoded per partition with Arrow batches (GEO-1)."""
    keep = [*key_cols, geometry_col]
    out_schema = ", ".join(f"`{c}` string" for c in key_cols) + ", geometry string"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[key_cols].astype("string")
            out["geometry"] = [decode_geometry(b, precision) for b in pdf[geometry_col]]
            yield out

    return df.select(*[F.col(c).cast("string") if c in key_cols else F.col(c) for c in keep]).mapInPandas(
        decode, out_schema
    )
