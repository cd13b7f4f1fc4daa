"""Incremental refresh of extents and period cells.

Changes since a watermark (less an overlap for transactions still open then) replace extents by id. Only the
(product, month) cells that a changed row lies in, or lay in, are made again; years and all time are sums of
months. Repeating a refresh changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eocatalog.operators import extents as ext
from eocatalog.operators.cells import month_cells, month_of, roll_up

__all__ = ["month_cells", "month_of", "roll_up"]

OVERLAP = dt.timedelta(minutes=15)


def scan_start(last_refresh: dt.datetime | None, now: dt.datetime, least_window: dt.timedelta | None = None, newest_known: dt.datetime | None = None) -> dt.datetime | None:
    """From when to look for changes; None: everything. newest_known sets the position back to the data."""
    start = newest_known or last_refresh
    if start is None:
        return None
    start -= OVERLAP
    return min(start, now - least_window) if least_window else start


def advance(old: dt.datetime | None, new: dt.datetime) -> dt.datetime:
    """Watermarks never go back."""
    return new if old is None or new > old else old


def changes_since(datasets: DataFrame, start: dt.datetime | None) -> DataFrame:
    """Rows (live or archived) added, updated or archived after start."""
    changed = datasets.withColumn("changed", F.greatest("added", "updated", "archived"))
    if start is None:
        return changed
    after = lambda x: F.col(x) > F.lit(start).cast("timestamp_ntz")
    return changed.where(after("added") | after("updated") | after("archived"))  # one by one, so that it reaches the scan


def apply_changes(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Extents after changes (with the columns of old, and archived): archived ids go, others are replaced."""
    live = changes.where(F.col("archived").isNull()).select(*old.columns)
    return old.join(changes.select("id"), "id", "left_anti").unionByName(live)


def affected_months(old: DataFrame, changes: DataFrame, tz: str) -> DataFrame:
    """product, month where a changed dataset is now or was before, so moves of time or product count too."""
    now = changes.select("product", month_of(tz).alias("month"))
    before = old.join(changes.select("id"), "id", "left_semi").select("product", month_of(tz).alias("month"))
    return now.unionByName(before).distinct()


def refresh_months(cells: DataFrame, extents: DataFrame, affected: DataFrame, tz: str) -> DataFrame:
    """cells with the affected months made again; months that have become empty go."""
    kept = cells.join(affected, ["product", "month"], "left_anti")
    return kept.unionByName(month_cells(extents, tz, affected))


def put_cells(old: DataFrame, new: DataFrame) -> DataFrame:
    return ext.upsert(old, new, ["product", "period_type", "start_day"])
