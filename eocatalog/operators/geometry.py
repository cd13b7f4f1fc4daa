"""Geometry over DataFrames: Arrow UDFs for single shapes, and union by group in levels.

Geometries are WKB with an EPSG code beside. All UDFs give null for null.
"""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eocatalog.functions import projections, shapes


#: Reference systems that one region's shapes lie in at most: all UTM zones of both hemispheres and some more.
MAX_SYSTEMS = 128


def _each(fn, *series):
    return pd.Series([None if any(v is None or v != v for v in vs) else fn(*vs) for vs in zip(*series, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def geojson_to_wkb(s: pd.Series) -> pd.Series:
    return _each(lambda t: shapes.to_wkb(shapes.from_json(t)), s)


@functools.lru_cache(4096)
def _as_wkb(text: str, tolerance: float) -> bytes:
    # tiles of a grid come again and again
    shape = shapes.from_json(text)
    return shapes.to_wkb(shapes.simplify(shape, tolerance) if tolerance else shape)


@functools.lru_cache(4096)
def _is_valid(wkb: bytes) -> bool | None:
    return shapes.is_valid(shapes.from_wkb(wkb))


@functools.lru_cache(4096)
def _placed(wkb: bytes, srid: int | None) -> tuple:
    """valid, outline in degrees as GeoJSON, and the box of its rings."""
    if srid is None:
        return _is_valid(wkb), None, None, None, None, None
    shape = projections.transform_shape(shapes.from_wkb(wkb), srid, 4326)
    rings = shape["type"] in ("Polygon", "MultiPolygon") and len(shapes.points(shape))
    return _is_valid(wkb), json.dumps(shape), *(shapes.envelope(shape) if rings else (None,) * 4)


_PLACED = ("valid boolean", "outline string", "xmin double", "ymin double", "xmax double", "ymax double")


def placed(wkb: Column, srid: Column) -> Column:
    """struct(valid, outline, xmin, ymin, xmax, ymax): what is known of a shape's place in degrees, in one call of Python a row.

    It isn't marked as deterministic, else each use of a field would be another call.
    """

    @F.pandas_udf(", ".join(_PLACED))
    def run(s: pd.Series, code: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 6 if w is None else _placed(bytes(w), None if c is None or c != c else int(c)) for w, c in zip(s, code, strict=True)]
        found = pd.DataFrame(rows, columns=[x.split()[0] for x in _PLACED], dtype=object)
        return found.astype({x: "float64" for x in ("xmin", "ymin", "xmax", "ymax")})

    return run.asNondeterministic()(wkb, srid)


def outline_to_wkb(outline: Column, tolerance: Column) -> Column:
    """GeoJSON text as WKB, with fewer points where there is a tolerance: none is farther off than that."""

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if text is None else _as_wkb(text, 0.0 if off != off else off) for text, off in zip(s, t, strict=True)], dtype=object)

    return run(outline, tolerance.cast("double"))


@F.pandas_udf(T.StringType())
def wkb_to_geojson(s: pd.Series) -> pd.Series:
    return _each(lambda w: json.dumps(shapes.from_wkb(w)), s)


@F.pandas_udf(T.BooleanType())
def is_valid(s: pd.Series) -> pd.Series:
    return _each(lambda w: _is_valid(bytes(w)), s)


@F.pandas_udf(T.DoubleType())
def area(s: pd.Series) -> pd.Series:
    return _each(lambda w: shapes.area(shapes.from_wkb(w)), s).astype("float64")


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")]))
def envelope(s: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 4 if w is None else shapes.envelope(shapes.from_wkb(w)) for w in s]
    return pd.DataFrame(rows, columns=["xmin", "ymin", "xmax", "ymax"], dtype="float64")


def parse_box(text: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax) of ``BOX(1 2,3 4)``; null for anything else."""
    number = r"([-+0-9.eE]+)"
    pattern = rf"^\s*BOX\s*\(\s*{number}\s+{number}\s*,\s*{number}\s+{number}\s*\)\s*$"
    ends = [F.regexp_extract(text, pattern, k + 1).try_cast("double").alias(n) for k, n in enumerate(("xmin", "ymin", "xmax", "ymax"))]
    return F.when(text.rlike(pattern), F.struct(*ends))


def point(x: Column, y: Column) -> Column:
    """A point without Python; null where a coordinate is missing."""
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def ewkt(wkb: Column, srid: Column) -> Column:
    """``SRID=4326;POLYGON((0 0,...))``; without a code the text alone."""

    @F.pandas_udf(T.StringType())
    def text(s: pd.Series) -> pd.Series:
        return _each(lambda w: shapes.to_wkt(shapes.from_wkb(w)), s)

    return F.concat(F.when(srid.isNull(), "").otherwise(F.concat(F.lit("SRID="), srid.cast("string"), F.lit(";"))), text(wkb))


def lonlat_bounds(wkb: Column, srid: Column) -> Column:
    """The box (xmin, ymin, xmax, ymax) of a shape in degrees."""
    return envelope(transform(wkb, srid, 4326))


def transform(wkb: Column, srid: Column, target: int) -> Column:
    """Coordinates in the target system; null without a code."""

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series, code: pd.Series) -> pd.Series:
        return _each(lambda w, c: shapes.to_wkb(projections.transform_shape(shapes.from_wkb(w), int(c), target)), s, code)

    return run(wkb, srid)


def simplify(wkb: Column, tolerance: float) -> Column:
    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return _each(lambda w: shapes.to_wkb(shapes.simplify(shapes.from_wkb(w), tolerance)), s)

    return run(wkb)


def bounds_polygon(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """A rectangle's ring as an array of points, without Python."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(left, bottom), p(left, top), p(right, top), p(right, bottom), p(left, bottom))


def corners_polygon(doc_points: dict[str, tuple[Column, Column]]) -> Column:
    """The ring ll, ul, ur, lr, ll of four named corners, as an array of points."""
    return F.array(*[F.struct(doc_points[k][0].alias("x"), doc_points[k][1].alias("y")) for k in ("ll", "ul", "ur", "lr", "ll")])


def union_by(footprints: DataFrame, keys: list[str], wkb: str = "footprint", fan_in: int = 64, simplify_to: float | None = None, at_most: int | None = None) -> DataFrame:
    """keys, footprint: what any of a group's shapes covers.

    Shapes are united in rounds of about fan_in by a hash, the hash coarser each round, so no task unites
    many of one group whatever its size; what is left of a group at last is united once more. Equal shapes, as
    those of a fixed grid of tiles, count once, before any hash puts them together. at_most is a known bound of
    a group's shapes, which saves counting them.
    """
    rows = footprints.where(F.col(wkb).isNotNull()).select(*keys, F.col(wkb).alias("footprint")).distinct()
    largest = at_most if at_most is not None else rows.groupBy(*keys).count().agg(F.max("count").alias("n")).first().n or 0

    def united(rows: DataFrame, by: list[str], last: bool) -> DataFrame:
        @F.pandas_udf(T.BinaryType())
        def unite(lists: pd.Series) -> pd.Series:
            out = []
            for own in lists:
                shape = shapes.union([shapes.from_wkb(bytes(w)) for w in own])
                if last and simplify_to is not None:
                    shape = shapes.simplify(shape, simplify_to)
                out.append(shapes.to_wkb(shape) if shape else None)
            return pd.Series(out, dtype=object)

        # lists are bounded by the buckets; sorted, so that a result doesn't depend on how rows came
        lists = rows.where(F.col("footprint").isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list("footprint")).alias("_shapes"))
        return lists.select(*keys, unite("_shapes").alias("footprint"))

    while largest > fan_in:
        buckets = -(-largest // fan_in)
        rows = united(rows.withColumn("_bucket", F.pmod(F.xxhash64("footprint"), F.lit(buckets))), [*keys, "_bucket"], False)
        largest = buckets
    return united(rows, keys, True)


def region_coverage(footprints: DataFrame, tolerance: float = 0.0001) -> DataFrame:
    """product, region_code, footprint (lon/lat), n: by code first, each united in its own system.

    Invalid shapes are left out; a null region is written as empty once its group is made.
    """
    valid = footprints.where(is_valid("footprint"))
    keys = ["product", "region_code", "srid"]
    counts = valid.groupBy("product", "region_code").agg(F.count(F.lit(1)).alias("n"))
    first = union_by(valid, keys).withColumn("footprint", transform(F.col("footprint"), F.col("srid"), 4326))
    united = union_by(first, ["product", "region_code"], fan_in=MAX_SYSTEMS, simplify_to=tolerance, at_most=MAX_SYSTEMS)
    on = counts["product"].eqNullSafe(united["product"]) & counts["region_code"].eqNullSafe(united["region_code"])
    return counts.join(united, on).select(counts["product"], F.coalesce(counts["region_code"], F.lit("")).alias("region_code"), "footprint", "n")


def equal_area_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Coordinates of the cylindrical equal-area grid (6933) as plain Columns."""
    import math

    a, f = projections.WGS84[0], 1 / projections.WGS84[1]
    e = math.sqrt(f * (2 - f))
    p = math.radians(projections.PARALLEL_6933)
    k0 = math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - (e * s) * (e * s)) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return a * k0 * F.radians(lon), a * q / (2 * k0)
