"""The whole refresh: documents to extents, and extents to cells, regions and product summaries.

Definitions are pairs (metadata type, product); documents are read in one pass, and what follows is one plan for all products.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eocatalog.functions import spatial, times
from eocatalog.operators import aggregates as agg
from eocatalog.operators import extents as ext
from eocatalog.operators import geometry, lookups, refresh
from eocatalog.sources import tables


extents_of = ext.extents_of


def placed(extents: DataFrame) -> DataFrame:
    """Extents with valid, outline (GeoJSON in degrees), its rings, their box xmin, ymin, xmax, ymax, and its quad key, cell.

    Rings and key are Columns of the outline and its box; a footprint of a system that isn't known has none of them.
    """
    looked = extents.withColumn("_placed", geometry.placed(F.col("footprint"), F.col("srid")))
    of = lambda name: F.col(f"_placed.{name}")
    bounds = {x: of(x) for x in ("xmin", "ymin", "xmax", "ymax")}
    rings = spatial.rings(of("outline")).alias("rings")
    return looked.select(*extents.columns, of("valid").alias("valid"), of("outline").alias("outline"), rings, *(c.alias(x) for x, c in bounds.items()), spatial.quad_key(*bounds.values()).alias("cell"))


def period_summary(extents: DataFrame, target: int, keys: tuple[str, ...] = ("product",), tz: str = agg.GROUPING_TZ) -> DataFrame:
    """keys, dataset_count, size_bytes, newest_creation_time, srids, footprint (in target), timeline and regions.

    Extents with an invalid footprint count nowhere; those without one count everywhere but in the footprint.
    Footprints are united by reference system first, then over the systems. Histograms are arrays of struct(key, n).
    """
    by = list(keys)
    rows = agg.valid_only(extents.withColumn("_valid", geometry.is_valid("footprint")), "_valid").drop("_valid")
    rows = tables.stored(rows, "summed")  # documents are read and outlines judged once for all that follows
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dataset_count"),
        F.sum("size_bytes").alias("size_bytes"),
        F.max("creation_time").alias("newest_creation_time"),
        F.array_sort(F.collect_set("srid")).alias("srids"),
    )
    by_system = geometry.union_by(rows.where(F.col("srid").isNotNull()), [*by, "srid"])
    moved = by_system.withColumn("footprint", geometry.transform(F.col("footprint"), F.col("srid"), target))
    days = rows.groupBy(*by, times.local_day(F.col("center_time"), tz).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    regions = rows.groupBy(*by, F.col("region_code").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.join(geometry.union_by(moved, by), by, "left")
    for name, long in (("timeline", days), ("regions", regions)):
        out = out.join(agg.encode_histogram(long, by, "key", "n", name), by, "left")
    return out


def tables_of(extents: DataFrame, tz: str = agg.GROUPING_TZ) -> dict[str, DataFrame]:
    """cells of all periods, regions, and summaries of the products."""
    return {
        "cells": refresh.roll_up(refresh.month_cells(extents, tz)),
        "regions": geometry.region_coverage(extents),
        "summaries": agg.product_extent(extents),
    }


def refresh_tables(old: dict[str, DataFrame], extents: DataFrame, products: DataFrame, tz: str = agg.GROUPING_TZ) -> dict[str, DataFrame]:
    """old's tables after the products(product) were made again from their extents; of others nothing changes.

    What a product no longer has, its last cell, region or summary included, goes.
    """
    new = tables_of(extents.join(products, "product", "left_semi"), tz)
    return {name: lookups.put_regions(old[name], new[name], products) for name in new}
