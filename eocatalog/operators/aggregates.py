"""Summaries of datasets by product, period and region.

Datasets have the columns product, center_time (UTC, without zone), and where an operator says so
region_code, size_bytes, srid, creation_time. All measures are additive, so each summary is one map-side
combined aggregate however large a product is.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from eocatalog.functions import times

GROUPING_TZ = "Australia/Darwin"
MAX_BUCKETS = 366


def valid_only(datasets: DataFrame, valid: str = "footprint_valid") -> DataFrame:
    """Rows whose footprint is valid or unknown; invalid ones count nowhere."""
    return datasets.where(F.col(valid).isNull() | F.col(valid))


def in_period(datasets: DataFrame, begin: dt.datetime, end: dt.datetime, closed: bool = False) -> DataFrame:
    """center_time from begin up to end; the end itself only with closed."""
    t, bound = F.col("center_time"), lambda x: F.lit(x.replace(tzinfo=None)).cast("timestamp_ntz")
    return datasets.where((t >= bound(begin)) & ((t <= bound(end)) if closed else (t < bound(end))))


def day_histogram(datasets: DataFrame, tz: str = GROUPING_TZ) -> DataFrame:
    day = times.local_day(F.col("center_time"), tz)
    return datasets.groupBy("product", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def timeline(datasets: DataFrame, first: dt.date, last: dt.date, tz: str = GROUPING_TZ) -> DataFrame:
    """product, day, n for every product and every day from first to last; zero where there is none."""
    counts = day_histogram(datasets, tz).where(F.col("day").between(F.lit(first), F.lit(last)))
    days = F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day")))
    every = datasets.select("product").distinct().select("product", days.alias("day"))
    return every.join(counts, ["product", "day"], "left").select("product", "day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def coarsen(buckets: DataFrame, limit: int = MAX_BUCKETS) -> DataFrame:
    """product, unit, day, n: where a product has over limit buckets, days become months or months years; one step.

    Buckets without a column unit are days; years stay. A coarsened timeline has no empty buckets.
    """
    if "unit" not in buckets.columns:
        buckets = buckets.withColumn("unit", F.lit("day"))
    sizes = buckets.groupBy("product").agg(F.count_distinct("day").alias("n_buckets"))
    wide, unit = (F.col("n_buckets") > limit) & (F.col("unit") != "year"), F.col("unit")
    joined = buckets.join(sizes, "product").where(~wide | (F.col("n") > 0))
    day = F.when(wide & (unit == "day"), F.trunc("day", "month")).when(wide, F.trunc("day", "year")).otherwise(F.col("day"))
    unit = F.when(wide & (unit == "day"), "month").when(wide, "year").otherwise(unit)
    return joined.groupBy("product", unit.alias("unit"), day.alias("day")).agg(F.sum("n").alias("n"))


def period_rollup(datasets: DataFrame, tz: str | None = GROUPING_TZ, measures: dict[str, Column] | None = None) -> DataFrame:
    """product, period_type (all, year, month), start_day, dataset_count and measures, from one pass.

    All time starts in 1900, as cells are keyed.
    """
    local = times.local_time(F.col("center_time"), tz) if tz else F.col("center_time")
    rows = datasets.withColumn("y", F.year(local)).withColumn("m", F.month(local))
    aggs = {"dataset_count": F.count(F.lit(1)), **(measures or {})}
    sets = rows.groupingSets([["product"], ["product", "y"], ["product", "y", "m"]], "product", "y", "m")
    rolled = sets.agg(F.grouping_id().alias("g"), *[a.alias(n) for n, a in aggs.items()])
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "year").otherwise("month")
    start = F.make_date(F.coalesce("y", F.lit(1900)), F.coalesce("m", F.lit(1)), F.lit(1))
    return rolled.select("product", kind.alias("period_type"), start.alias("start_day"), *aggs)


def period_counts(cells: DataFrame) -> DataFrame:
    """product, year, month, dataset_count of all stored periods; null for what a period spans all of."""
    year = F.when(F.col("period_type") != "all", F.year("start_day")).cast("long")
    month = F.when(F.col("period_type") == "month", F.month("start_day")).cast("long")
    return cells.select("product", year.alias("year"), month.alias("month"), "dataset_count")


def total_count(cells: DataFrame) -> DataFrame:
    """n: datasets of all products, from the cells of all time."""
    return cells.where("period_type = 'all'").agg(F.sum("dataset_count").alias("n"))


def period_summary(datasets: DataFrame) -> DataFrame:
    """product, dataset_count, crs_list, size_bytes, newest_creation_time; first by srid, then over all.

    The size of a product without any size is null.
    """
    by_srid = datasets.groupBy("product", "srid").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("size"), F.max("creation_time").alias("newest"))
    return by_srid.groupBy("product").agg(
        F.sum("n").alias("dataset_count"),
        F.array_sort(F.collect_set("srid")).alias("srids"),
        F.sum("size").alias("size_bytes"),
        F.max("newest").alias("newest_creation_time"),
    )


def region_histogram(datasets: DataFrame) -> DataFrame:
    """product, region_code, n; datasets without a region are a group of their own."""
    return datasets.groupBy("product", "region_code").agg(F.count(F.lit(1)).alias("n"))


def product_extent(datasets: DataFrame) -> DataFrame:
    return datasets.groupBy("product").agg(F.min("center_time").alias("time_earliest"), F.max("center_time").alias("time_latest"), F.count(F.lit(1)).alias("dataset_count"))


def add_periods(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of product, start_day, dataset_count, size_bytes, begin, end, newest, generated, histograms, added up.

    Empty cells count for nothing but their time of generation; a sum without any size is 0. Histograms are
    arrays of struct(key, n), in which a key may be null.
    """
    some = F.col("dataset_count") > 0
    kept = lambda x: F.when(some, F.col(x))
    scalars = cells.groupBy(*keys).agg(
        F.sum("dataset_count").alias("dataset_count"),
        F.coalesce(F.sum(kept("size_bytes")), F.lit(0)).alias("size_bytes"),
        F.min(kept("begin")).alias("begin"),
        F.max(kept("end")).alias("end"),
        F.max(kept("newest")).alias("newest"),
        F.min("generated").alias("generated"),
    )
    out = scalars
    for name in ("timeline", "regions"):
        key = dict(cells.dtypes)[name].split("key:")[1].split(",")[0]
        long = cells.where(some).select(*keys, F.inline(name)).groupBy(*keys, "key").agg(F.sum("n").alias("n"))
        # a histogram has a bounded number of keys (days of a period, regions of a product)
        packed = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias(name))
        out = out.join(packed, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<struct<key:{key},n:bigint>>")))
    return out


def common_period(cells: DataFrame) -> DataFrame:
    """product, year, month, day: what all of a product's days have in common, from the left."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    parts = cells.groupBy("product").agg(one(F.year("day")).alias("year"), one(F.month("day")).alias("m"), one(F.dayofmonth("day")).alias("d"))
    month = F.when(F.col("year").isNotNull(), F.col("m"))
    return parts.select("product", "year", month.alias("month"), F.when(month.isNotNull(), F.col("d")).alias("day"))


def encode_histogram(df: DataFrame, keys: list[str], key: str, n: str, name: str) -> DataFrame:
    """A histogram in long form as an array of struct(key, n), null keys allowed."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(n).alias("n")))).alias(name))


def bar_heights(counts: DataFrame, by: str = "product", n: str = "n") -> DataFrame:
    """Each count as a percentage of its product's largest."""
    return counts.withColumn("height", 100.0 * F.col(n) / F.max(n).over(W.partitionBy(by)))


def min_max(counts: DataFrame, by: str = "product", n: str = "n") -> DataFrame:
    return counts.groupBy(by).agg(F.min(n).alias("min_n"), F.max(n).alias("max_n"))


def colour_bins(counts: DataFrame, bins: int = 5, by: str = "product", n: str = "n") -> DataFrame:
    """bin 0..bins-1 of equal width between a product's smallest and largest count."""
    bounds = min_max(counts, by, n)
    width = F.col("max_n") - F.col("min_n")
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(n) - F.col("min_n")) * bins / width), F.lit(bins - 1)))
    return counts.join(bounds, by).withColumn("bin", at.cast("int")).drop("min_n", "max_n")


def crs_names(datasets: DataFrame, crs: DataFrame, max_crs_rows: int = 20_000) -> DataFrame:
    """product, crs_list of "AUTH:code" names; crs(srid, auth_name, auth_srid) is broadcast up to max_crs_rows rows."""
    small = crs.limit(max_crs_rows + 1).count() <= max_crs_rows
    side = F.broadcast(crs) if small else crs
    distinct = datasets.select("product", "srid").distinct()
    named = distinct.join(side, "srid").select("product", F.concat_ws(":", "auth_name", "auth_srid").alias("crs"))
    return named.groupBy("product").agg(F.array_sort(F.collect_set("crs")).alias("crs_list"))


def empty_cell(spark, product: str) -> DataFrame:
    """A cell that no dataset is in."""
    schema = T.StructType([T.StructField("product", T.StringType()), T.StructField("dataset_count", T.LongType()), T.StructField("size_bytes", T.LongType())])
    return spark.createDataFrame([(product, 0, 0)], schema)
