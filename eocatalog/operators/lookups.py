"""Products, cells, regions and locations by name or id, and how they are replaced.

products(id, product, metadata_type), cells(product, period_type, start_day, ...), regions(product,
region_code, footprint, n), locations(id, uri, archived), datasets(id, product, center_time, added, archived).
Products and regions are small; joins with them are left to Spark's own size check.
"""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eocatalog.functions import regions as codes
from eocatalog.functions import times
from eocatalog.operators import aggregates as agg
from eocatalog.operators import extents as ext
from eocatalog.operators import geometry


def product_by_name(products: DataFrame, name: str) -> DataFrame:
    return products.where(F.col("product") == name)


def product_by_id(products: DataFrame, id_: int) -> DataFrame:
    """The product's row; KeyError for an id that there isn't."""
    found = products.where(F.col("id") == id_)
    if found.isEmpty():
        raise KeyError(id_)
    return found


def metadata_types(types: DataFrame) -> DataFrame:
    return types.orderBy("name")


def checked_names(products: DataFrame, wanted: list[str]) -> list[str]:
    """wanted as it is; ValueError with all possible names if one of them is unknown."""
    known = {r.product for r in products.where(F.col("product").isin(wanted)).select("product").distinct().collect()}  # at most as many as wanted
    unknown = [w for w in wanted if w not in known]
    if unknown:
        possible = ", ".join(r.product for r in products.select("product").distinct().orderBy("product").collect())
        raise ValueError(f"unknown product {', '.join(unknown)}; there are: {possible}")
    return wanted


def of_product(rows: DataFrame, products: DataFrame, name: str, ref: str = "product_ref") -> DataFrame:
    """Rows that refer by id to the product of this name."""
    return rows.join(product_by_name(products, name).select(F.col("id").alias(ref)), ref, "left_semi")


def with_product_names(rows: DataFrame, products: DataFrame, ref: str = "product_ref") -> DataFrame:
    """Rows with the name of the product that they refer to by id; null for an unknown one."""
    return rows.join(products.select(F.col("id").alias(ref), "product"), ref, "left")


def has_cell(cells: DataFrame, product: str, year: int | None = None, month: int | None = None) -> bool:
    return not stored_cell(cells, product, year, month).isEmpty()


def stored_cell(cells: DataFrame, product: str, year: int | None = None, month: int | None = None) -> DataFrame:
    kind, start = times.encode_period(year, month)
    return cells.where((F.col("product") == product) & (F.col("period_type") == kind) & (F.col("start_day") == F.lit(start)))


def cell(cells: DataFrame, datasets: DataFrame, product: str, year: int | None = None, month: int | None = None, day: int | None = None, tz: str = agg.GROUPING_TZ) -> DataFrame:
    """product, start_day, dataset_count, size_bytes: stored for months and more, worked out on the spot for a day."""
    if day is None:
        return stored_cell(cells, product, year, month).select("product", "start_day", "dataset_count", "size_bytes")
    begin, end = times.period_bounds(year, month, day, tz)
    some = agg.in_period(datasets.where(F.col("product") == product), begin, end)
    out = some.agg(F.count(F.lit(1)).alias("dataset_count"), F.sum("size_bytes").alias("size_bytes"))
    return out.select(F.lit(product).alias("product"), F.lit(dt.date(year, month, day)).alias("start_day"), "dataset_count", "size_bytes")


def product_summary(summaries: DataFrame, products: DataFrame, name: str):
    """The product's summary as a Row, None before its first; ValueError for an unknown product."""
    if product_by_name(products, name).isEmpty():
        raise ValueError(f"unknown product {name!r}")
    return summaries.where(F.col("product") == name).first()


def cells_of_products(cells: DataFrame, products: DataFrame) -> DataFrame:
    """Cells that refer to a product by id, with its name; those of products that are gone don't count."""
    return cells.join(products.select(F.col("id").alias("product_ref"), "product"), "product_ref")


def put_product_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """One summary a product; the old one's id stays, so that references to it hold."""
    kept = new.join(old.select("product", F.col("id").alias("_id")), "product", "left").withColumn("id", F.coalesce("_id", "id")).drop("_id")
    return ext.upsert(old, kept, "product").select(*old.columns)


def put_regions(old: DataFrame, new: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Regions after some products were summarised again: theirs are replaced, and those no longer found go.

    refreshed(product) are all products looked at, also those that have no region left.
    """
    return old.join(refreshed.select("product").distinct(), "product", "left_anti").unionByName(new)


def product_regions(regions: DataFrame, product: str) -> DataFrame:
    """A product's regions that have a footprint, by code."""
    return regions.where((F.col("product") == product) & F.col("footprint").isNotNull()).orderBy("region_code")


def region_label(code: Column, kind: str | None) -> Column:
    """``Tile +1, -2``, ``Path 1, Row 2``, ``Path 1`` or the code itself."""
    x, y = codes.split_code(code)
    if kind == "tile":
        return F.when(x.isNotNull(), F.format_string("Tile %+d, %+d", x, y)).otherwise(code)
    if kind == "scene":
        first, second = (F.regexp_extract(code, r"^(-?\d+)_(-?\d+)$", i) for i in (1, 2))
        return F.when(x.isNotNull(), F.concat(F.lit("Path "), first, F.lit(", Row "), second)).otherwise(F.concat(F.lit("Path "), code))
    return code


def region_info(regions: DataFrame, product: str, kind: str | None) -> DataFrame:
    """A product's regions with the label that its kind of region gives them."""
    return product_regions(regions, product).withColumn("label", region_label(F.col("region_code"), kind))


def footprint_region(extents: DataFrame, id_: str) -> DataFrame:
    """footprint (lon/lat) and region_code of a dataset; no row before its product is summarised."""
    return extents.where(F.col("id") == id_).select(geometry.transform(F.col("footprint"), F.col("srid"), 4326).alias("footprint"), "region_code")


def active_locations(locations: DataFrame, datasets: DataFrame) -> DataFrame:
    """id, product, center_time, uri of live locations of live datasets."""
    live = datasets.where(F.col("archived").isNull()).select("id", "product", "center_time")
    return locations.where(F.col("archived").isNull()).select("id", "uri").join(live, "id").select("id", "product", "center_time", "uri")


def product_locations(active: DataFrame, product: str, begin: dt.datetime | None = None, end: dt.datetime | None = None, limit: int = 100) -> DataFrame:
    """Up to limit locations of a product, by address; both bounds or none."""
    found = active.where(F.col("product") == product)
    if begin is not None:
        found = agg.in_period(found, begin, end)
    return found.orderBy("uri", "id").limit(limit)


def archived_location_times(locations: DataFrame, id_: str) -> DataFrame:
    """uri, archived of a dataset's locations that were archived, newest first."""
    return locations.where((F.col("id") == id_) & F.col("archived").isNotNull()).select("uri", "archived").orderBy(F.col("archived").desc(), "uri")


def middle_days(datasets: DataFrame) -> DataFrame:
    """product, day, n: how many datasets lie in the UTC day amid each product's first and last.

    The bounds of all products are one aggregate; the count reads the datasets once more, for all products.
    """
    bounds = agg.product_extent(datasets)
    day = F.to_date(times.midpoint(F.col("time_earliest"), F.col("time_latest")))
    days = bounds.select("product", day.alias("day"))
    counts = datasets.withColumn("day", F.to_date("center_time")).join(days, ["product", "day"], "left_semi").groupBy("product", "day").agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, ["product", "day"], "left").select("product", "day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def day_timings(datasets: DataFrame, extents: DataFrame) -> list[dict]:
    """product, dataset_count, seconds, day of a one-day count in the middle of each product, slowest first.

    extents are the products' time bounds. Meant to show scans that don't prune: one small job a product.
    """
    out = []
    for p in extents.select("product", "time_earliest", "time_latest").toLocalIterator():
        if p.time_earliest is None:
            out.append({"product": p.product, "dataset_count": 0, "seconds": None, "day": None})
            continue
        middle = p.time_earliest + (p.time_latest - p.time_earliest) / 2
        day = middle.replace(hour=0, minute=0, second=0, microsecond=0)
        start = time.monotonic()
        n = agg.in_period(datasets.where(F.col("product") == p.product), day, day + dt.timedelta(days=1)).count()
        out.append({"product": p.product, "dataset_count": n, "seconds": time.monotonic() - start, "day": day})
    return sorted(out, key=lambda r: (-(r["seconds"] or 0), r["product"]))


def slowest(timings: DataFrame, n: int, seconds: str = "seconds") -> DataFrame:
    return timings.orderBy(F.col(seconds).desc_nulls_last(), *[c for c in timings.columns if c != seconds]).limit(n)


def by_label(datasets: DataFrame) -> DataFrame:
    """Datasets in the order of their labels; ties by id."""
    return datasets.orderBy("label", "id")
