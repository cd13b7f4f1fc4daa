"""Whole period cells: all measures of a product's month, and months added up to years and all time.

A cell is mergeable: counts, sizes, bounds of times and places, histograms of days and regions, the set of reference
systems. Cells are summed in long form, a row for each thing counted (the cell itself, a day, a region, a system), so that
one aggregate with map-side combining does all of them and all periods at once; only a cell's own histograms, whose keys are
a product's days and regions, are then packed into its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eocatalog.functions import times

#: Days of a timeline beyond which it is kept by month.
MAX_BUCKETS = 366
#: Columns of extents that cells are made of; those that aren't there are null.
INPUTS = {
    "product": "string", "center_time": "timestamp_ntz", "creation_time": "timestamp_ntz", "size_bytes": "long", "region_code": "string", "srid": "int",
    "xmin": "double", "ymin": "double", "xmax": "double", "ymax": "double",
}
#: How each measure that isn't a histogram is put together.
_SCALARS = {
    "dataset_count": F.sum, "size_bytes": F.sum, "newest_creation_time": F.max, "footprint_count": F.sum, "begin": F.min, "end": F.max,
    "xmin": F.min, "ymin": F.min, "xmax": F.max, "ymax": F.max,
}
MEASURES = [*_SCALARS, "timeline_unit", "timeline", "regions", "srids"]


def month_of(tz: str) -> Column:
    return F.to_date(F.date_trunc("month", times.local_time(F.col("center_time"), tz)))


def _item(kind: str, key: Column, n: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), n.cast("long").alias("n"))


def _exploded(rows: DataFrame, keys: list[str], items: Column) -> DataFrame:
    """Rows for each item; only the cell's own has the scalars."""
    long = rows.select(*keys, *_SCALARS, F.explode(items).alias("item")).select(*keys, *_SCALARS, "item.*")
    return long.select(*keys, "kind", "key", "n", *(F.when(F.col("kind") == "cell", F.col(x)).alias(x) for x in _SCALARS))


def _sums() -> list[Column]:
    return [F.sum("n").alias("n"), *(how(x).alias(x) for x, how in _SCALARS.items())]


def _packed(summed: DataFrame, keys: list[str]) -> DataFrame:
    """One row a cell, its histograms as arrays of struct(key, n) in the order of keys."""
    histogram = lambda kind, cast: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("key").cast(cast).alias("key"), "n"))))
    systems = F.array_sort(F.collect_list(F.when((F.col("kind") == "srid") & F.col("key").isNotNull(), F.col("key").cast("int"))))
    cells = summed.groupBy(*keys).agg(*(F.max(x).alias(x) for x in _SCALARS), histogram("day", "date").alias("_days"), histogram("month", "date").alias("_months"), histogram("region", "string").alias("regions"), systems.alias("srids"))
    wide = F.size("_days") > MAX_BUCKETS
    cells = cells.withColumn("timeline_unit", F.when(wide, "month").otherwise("day")).withColumn("timeline", F.when(wide, F.col("_months")).otherwise(F.col("_days")))
    return cells.select(*keys, *MEASURES)


def month_cells(extents: DataFrame, tz: str, only: DataFrame | None = None) -> DataFrame:
    """product, month and all measures, of extents or of those in the months only(product, month).

    Extents with valid = false count nowhere. Datasets without a time, region or system count under null.
    """
    rows = extents if "valid" not in extents.columns else extents.where(F.col("valid").isNull() | F.col("valid"))
    rows = rows.select(*((F.col(x) if x in rows.columns else F.lit(None)).cast(kind).alias(x) if x != "size_bytes" else (F.col(x) if x in rows.columns else F.lit(None).cast("long")).alias(x) for x, kind in INPUTS.items()))
    rows = rows.withColumn("month", month_of(tz)).withColumn("day", times.local_day(F.col("center_time"), tz))
    if only is not None:
        same = rows["product"].eqNullSafe(only["product"]) & rows["month"].eqNullSafe(only["month"])
        rows = rows.join(only, same, "left_semi")
    t = F.col("center_time")
    parts = rows.groupBy("product", "month", "day", "region_code", "srid").agg(
        F.count(F.lit(1)).alias("dataset_count"), F.sum("size_bytes").alias("size_bytes"), F.max("creation_time").alias("newest_creation_time"),
        F.count("xmin").alias("footprint_count"), F.min(t).alias("begin"), F.max(t).alias("end"), *(_SCALARS[x](x).alias(x) for x in ("xmin", "ymin", "xmax", "ymax")),
    )
    n = F.col("dataset_count")
    items = F.array(_item("cell", F.lit(None), n), _item("day", F.col("day"), n), _item("region", F.col("region_code"), n), _item("srid", F.col("srid"), n))
    keys = ["product", "month"]
    return _packed(_exploded(parts, keys, items).groupBy(*keys, "kind", "key").agg(*_sums()), keys)


def roll_up(cells: DataFrame) -> DataFrame:
    """All periods from month cells: product, period_type, start_day, month and all measures.

    One pass of grouping sets makes months, years and all time of all products. A timeline of more than
    MAX_BUCKETS days is kept by month. All time starts in 1900, as cells are keyed; a sum without any size is 0.
    """
    of = lambda name, kind, key=lambda k: k: F.transform(name, lambda x: _item(kind, key(x.key), x.n))
    first = lambda day: F.trunc(day, "month")
    items = F.concat(F.array(_item("cell", F.lit(None), F.col("dataset_count"))), of("timeline", "day"), of("timeline", "month", first), of("regions", "region"), F.transform("srids", lambda s: _item("srid", s, F.lit(1))))
    rows = _exploded(cells.withColumn("y", F.year("month")), ["product", "y", "month"], items)
    sets = rows.groupingSets([["product", "kind", "key"], ["product", "y", "kind", "key"], ["product", "y", "month", "kind", "key"]], "product", "y", "month", "kind", "key")
    # of the grouping id's five bits, those of year and month tell the period
    summed = sets.agg(F.grouping_id().alias("g"), *_sums()).withColumn("g", F.shiftright("g", 2).bitwiseAND(3))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "year").otherwise("month")
    start = F.coalesce(F.col("month"), F.make_date(F.coalesce("y", F.lit(1900)), F.lit(1), F.lit(1)))
    keyed = summed.withColumn("period_type", kind).withColumn("start_day", start).drop("g", "y")
    return _packed(keyed, ["product", "period_type", "start_day", "month"]).withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))


def histogram_text(name: str) -> Column:
    """``key:n`` of a histogram, separated by commas; a key that is null is empty."""
    return F.array_join(F.transform(name, lambda x: F.concat(F.coalesce(x.key.cast("string"), F.lit("")), F.lit(":"), x.n.cast("string"))), ",")
