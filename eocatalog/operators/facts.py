"""Facts about products: what is fixed, linked, changed, new, missing or misplaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eocatalog.functions import texts, times


def first_rows(rows: DataFrame, by: str | list[str], order: list[Column], n: int) -> DataFrame:
    """The n first rows of each group, in a window that keeps n rows of a group at a time."""
    keys = [by] if isinstance(by, str) else by
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def hash_sample(rows: DataFrame, n: int, by: str = "product", id_col: str = "id") -> DataFrame:
    """Up to n rows of each product, in the order of a hash of their ids: the same at each run."""
    return first_rows(rows, by, [F.xxhash64(id_col), F.col(id_col)], n)


def block_sample(rows: DataFrame, percent: float, seed: int = 11) -> DataFrame:
    """About percent of the rows; all of them from 100 on, without a sampling step."""
    return rows if percent >= 100 else rows.sample(fraction=percent / 100, seed=seed)


def fixed_fields(rows: DataFrame, fields: list[str], by: str = "product", id_col: str = "id") -> DataFrame:
    """by, field, value, is_fixed: whether a group's rows all hold the first row's value.

    The first row is the one with the smallest id. Where it holds null the others must as well; else nulls
    in other rows don't count against it.
    """
    first = rows.groupBy(by).agg(F.min_by(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]), F.col(id_col)).alias("first"))
    joined = rows.join(first, by)
    checks = []
    for f in fields:
        value, own = F.col("first").getField(f), F.col(f).cast("string")
        holds = F.when(value.isNull(), own.isNull()).otherwise(own == value)
        checks += [F.every(holds).alias(f"ok_{f}"), F.first(value).alias(f"v_{f}")]
    wide = joined.groupBy(by).agg(*checks)
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"v_{f}").alias("value"), F.coalesce(f"ok_{f}", F.lit(False)).alias("is_fixed")) for f in fields]
    return wide.select(by, F.inline(F.array(*cells)))


def linked_products(edges: DataFrame, datasets: DataFrame, kind: str = "source") -> DataFrame:
    """product, linked: sorted names of the products that its datasets come from, or that come from them.

    edges(dataset_ref, source_ref), datasets(id, product). Products without any have an empty array.
    """
    near, far = ("dataset_ref", "source_ref") if kind == "source" else ("source_ref", "dataset_ref")
    ends = edges.select(F.col(near).alias("id"), F.col(far).alias("other")).join(datasets.select("id", "product"), "id").select("product", "other").distinct()
    others = ends.join(datasets.select(F.col("id").alias("other"), F.col("product").alias("linked")), "other").select("product", "linked").distinct()
    packed = others.groupBy("product").agg(F.array_sort(F.collect_list("linked")).alias("linked"))
    every = datasets.select("product").distinct()
    return every.join(packed, "product", "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<string>")))


def changed_time(*parts: str) -> Column:
    """The latest of added, updated and archived; nulls don't count."""
    return F.greatest(*parts)


def most_recent_change(datasets: DataFrame, column: str = "changed") -> DataFrame:
    return datasets.groupBy("product").agg(F.max(column).alias("most_recent_change"))


def needs_refresh(changes: DataFrame, products: DataFrame) -> DataFrame:
    """product, needs_refresh: never summarised, or changed since the last refresh."""
    joined = products.join(changes, "product", "left")
    stale = F.col("last_refresh").isNull() | F.coalesce(F.col("most_recent_change") > F.col("last_refresh"), F.lit(False))
    return joined.select("product", stale.alias("needs_refresh"))


def months_needing_update(datasets: DataFrame, since, tz: str | None = None, changed: str = "changed") -> DataFrame:
    """product, month, n: the months in which datasets changed after since lie, by their center time."""
    local = times.local_time(F.col("center_time"), tz) if tz else F.col("center_time")
    month = F.to_date(F.date_trunc("month", local))
    return datasets.where(F.col(changed) > F.lit(since)).groupBy("product", month.alias("month")).agg(F.count(F.lit(1)).alias("n"))


def years_needing_update(expected: DataFrame, years: DataFrame, months: DataFrame) -> DataFrame:
    """key, year of expected that have no cell, or a cell older than one of their months'.

    years(key, year, generated), months(key, year, generated).
    """
    missing = expected.join(years, ["key", "year"], "left_anti")
    newest = months.select("key", "year", F.col("generated").alias("of_month"))
    older = years.join(newest, (years["key"] == newest["key"]) & (years["year"] == newest["year"]) & (newest["of_month"] > years["generated"]), "left_semi")
    return missing.select("key", "year").union(older.select("key", "year")).distinct()


def arrivals(datasets: DataFrame, days: int = 14, sample: int = 3) -> DataFrame:
    """day, product, n, sample_ids of the days after (newest day - days); the samples are the smallest ids."""
    newest = datasets.agg(F.max("added").alias("t")).first().t
    if newest is None:
        return datasets.limit(0).select(F.to_date("added").alias("day"), "product", F.lit(0).cast("long").alias("n"), F.array(F.col("id")).alias("sample_ids"))
    day = F.to_date("added")
    recent = datasets.where(day > F.date_sub(F.lit(newest.date()), days)).withColumn("day", day)
    counts = recent.groupBy("day", "product").agg(F.count(F.lit(1)).alias("n"))
    ids = first_rows(recent, ["day", "product"], [F.col("id").asc()], sample).groupBy("day", "product").agg(F.array_sort(F.collect_list("id")).alias("sample_ids"))
    return counts.join(ids, ["day", "product"])


def quality_stats(datasets: DataFrame) -> DataFrame:
    """Counts of what rows lack, and the mean and spread of stored footprint sizes, by product."""
    size = F.octet_length("footprint")
    return datasets.groupBy("product").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("footprint").isNull()).alias("missing_footprint"),
        F.sum(size).cast("long").alias("footprint_size"),
        F.stddev_samp(size).alias("footprint_stddev"),
        F.count_if(F.col("srid").isNull()).alias("missing_srid"),
        F.count("size_bytes").alias("has_file_size"),
        F.count("region_code").alias("has_region"),
    )


def location_samples(locations: DataFrame, n: int = 3, by: str = "product") -> DataFrame:
    return first_rows(locations, by, [F.col("uri").asc()], n)


def uri_prefixes(locations: DataFrame) -> DataFrame:
    """product, scheme, prefix (a folder that all share, or the only address), n, first and last address."""
    scheme = F.regexp_extract("uri", "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    ends = locations.groupBy("product", scheme.alias("scheme")).agg(F.count(F.lit(1)).alias("n"), F.min("uri").alias("first_uri"), F.max("uri").alias("last_uri"))
    return ends.withColumn("prefix", texts.shared_prefix(F.col("first_uri"), F.col("last_uri")))


def group_products(products: DataFrame, patterns: list[tuple[str, str]], default: str = "Other", chunk: int = 5) -> DataFrame:
    """product, group_name, group_size, chunk: by the first pattern that matches, the default group in chunks."""
    group = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        group = F.when(F.col("product").rlike(pattern), name).otherwise(group)
    named = products.withColumn("group_name", F.coalesce(group, F.lit(default)))
    rank = F.row_number().over(W.partitionBy("group_name").orderBy("product"))
    part = F.when(F.col("group_name") == default, F.floor((rank - 1) / chunk)).otherwise(0)
    return named.select("product", "group_name", F.count(F.lit(1)).over(W.partitionBy("group_name")).alias("group_size"), part.cast("int").alias("chunk"))


def overflow(edges: DataFrame, limit: int, by: str = "dataset_ref", other: str = "source_ref") -> DataFrame:
    """by, shown (the first limit others, sorted), remaining (how many more)."""
    own = W.partitionBy(by)  # one shuffle: rank, count and the aggregate all go by the same key
    ranked = edges.select(by, other, F.row_number().over(own.orderBy(other)).alias("_k"), F.count(F.lit(1)).over(own).alias("_n"))
    first = ranked.where(F.col("_k") <= limit).groupBy(by).agg(F.array_sort(F.collect_list(other)).alias("shown"), F.first("_n").alias("_n"))
    return first.select(by, "shown", F.greatest(F.col("_n") - limit, F.lit(0)).alias("remaining"))


def largest(rows: DataFrame, n: int = 15, by: str = "size") -> DataFrame:
    """The n rows with the largest value, ties by id; only n of each task are sorted together."""
    return rows.orderBy(F.col(by).desc_nulls_last(), F.col("id")).limit(n)


def product_listing(cells: DataFrame, positions: DataFrame) -> DataFrame:
    """A row for each product that was ever refreshed, by name: what its cells say of it, and how far it is refreshed.

    positions(product, last_refresh). A product without datasets has 0 of everything and no times.
    """
    months = cells.where("period_type = 'month'").groupBy("product").agg(F.count(F.lit(1)).alias("months"))
    whole = cells.where("period_type = 'all'").select("product", "dataset_count", "size_bytes", "begin", "end", F.size(F.filter("regions", lambda r: r.key.isNotNull())).alias("regions"), F.size("srids").alias("systems"))
    out = positions.select("product", "last_refresh").join(whole, "product", "left").join(months, "product", "left").fillna(0, ["dataset_count", "size_bytes", "regions", "systems", "months"])
    return out.select("product", "dataset_count", "size_bytes", F.col("begin").alias("first_time"), F.col("end").alias("last_time"), F.col("regions").cast("long").alias("regions"), F.col("systems").cast("long").alias("systems"), "months", "last_refresh").orderBy("product")


def unsummarised(products: DataFrame, cells: DataFrame) -> DataFrame:
    return products.join(cells.where("period_type = 'all'"), "product", "left_anti")


def complete_products(products: DataFrame, cells: DataFrame) -> DataFrame:
    return products.join(cells.where("period_type = 'all'"), "product", "left_semi")


def with_summaries(products: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every product with its summary, or nulls."""
    return products.join(summaries, "product", "left")


def products_with_metadata_type(products: DataFrame, name: str) -> DataFrame:
    return products.where(F.col("metadata_type") == name).select("product").orderBy("product")


def newest_indexed(extents: DataFrame, datasets: DataFrame) -> DataFrame:
    return extents.join(datasets.select("id", "added"), "id").groupBy("product").agg(F.max("added").alias("newest"))
