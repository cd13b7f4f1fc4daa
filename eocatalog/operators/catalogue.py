"""A stored catalogue that changes of datasets keep current: extents, whole cells of all periods, and how far each
product has been refreshed.

Changes may come in any order, late and repeatedly. Of a dataset's states the one with the latest change time counts; of
two with the same time the archived one, then the one with the larger digest. Each state that counted is kept in a log by
id, archivals too, so an older change that comes later is known as such.

A run reads and writes what its changes touch: the log's buckets of their ids, extents of the (product, month) that they are
in or were in, and the cells of their products. All tables and the products' positions become current in one step.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eocatalog.operators import aggregates as agg
from eocatalog.operators import cells as cell
from eocatalog.operators import facts, refresh
from eocatalog.sources import tables
from eocatalog.sources.partitioned import Change, Conflict, Partitioned, code

#: Raised when stored tables must be made anew: products of an older number are refreshed as a whole.
LAYOUT = 1
#: Buckets of ids, and folders of one bucket before these are merged.
BUCKETS, MERGE_AT = 64, 16
_ADDED = ("_changed", "_gone", "_digest")


def clock(spark: SparkSession) -> dt.datetime:
    """The time of a run, asked for once: all that a run stores carries the same."""
    return spark.sql("SELECT current_timestamp() AS t").first().t.astimezone(dt.timezone.utc).replace(tzinfo=None)


def _time(t: dt.datetime) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def ordered(changes: DataFrame) -> DataFrame:
    """Changes with what tells which of a dataset's states counts."""
    state = sorted(changes.columns)
    never = F.lit(dt.datetime(1, 1, 1)).cast("timestamp_ntz")
    return changes.withColumns({"_changed": F.coalesce(F.greatest("added", "updated", "archived"), never), "_gone": F.col("archived").isNotNull(), "_digest": F.xxhash64(*state)})


def latest(states: DataFrame) -> DataFrame:
    """The state of each id that counts, of states that ordered() gave."""
    whole = F.struct(*states.columns)
    return states.groupBy("id").agg(F.max_by(whole, F.struct(*_ADDED)).alias("_s")).select("_s.*")


class Catalogue:
    def __init__(self, spark: SparkSession, path: str, tz: str = agg.GROUPING_TZ, listeners: tuple[Callable[[DataFrame], None], ...] = ()):
        """listeners are called with the month cells that a run has made again."""
        self.spark, self.tz, self.listeners = spark, tz, listeners
        self.store = Partitioned(spark, path)
        #: Bytes that the last run wrote, by table.
        self.written: dict[str, int] = {}

    # ---- what is stored

    def extents(self, head: dict | None = None) -> DataFrame | None:
        return self.store.read("extents", head=head)

    def cells(self, head: dict | None = None) -> DataFrame | None:
        """Cells of all periods with all measures, see cells.roll_up."""
        return self.store.read("cells", head=head)

    def month_cells(self, head: dict | None = None) -> DataFrame | None:
        found = self.cells(head)
        return None if found is None else found.where("period_type = 'month'").drop("period_type", "start_day")

    def products(self, head: dict | None = None) -> DataFrame | None:
        """product, last_refresh, newest_added, layout, time_earliest, time_latest, dataset_count."""
        return self.store.read("products", head=head)

    #: Columns that each stored table has at least.
    EXPECTED = {
        "extents": {"id", "product", "center_time", "added", "month"},
        "cells": {"product", "period_type", "start_day", "month", "generated", *cell.MEASURES},
        "products": {"product", "last_refresh", "newest_added", "layout", "time_earliest", "time_latest", "dataset_count"},
        "log": {"id", "product", "month", *_ADDED},
    }

    def problems(self) -> list[str]:
        """What keeps stored tables from being used as they are: none yet, columns that are missing, older layouts."""
        head = self.store.head()
        if not head["tables"]:
            return ["nothing is stored yet"]
        found = []
        for name, columns in self.EXPECTED.items():
            table = self.store.read(name, head=head)
            missing = columns - set(table.columns) if table is not None else columns
            found += [f"{name} lacks {', '.join(sorted(missing))}"] if missing else []
        if not found:
            older = self.products(head).where(F.coalesce(F.col("layout"), F.lit(0)) < LAYOUT).count()
            found += [f"{older} products have an older layout: the next refresh makes them anew"] if older else []
        return found

    # ---- runs

    def apply(self, changes: DataFrame, token: str, now: dt.datetime | None = None) -> None:
        """Changes (id, product, center_time, ..., added, updated, archived) as they come from a feed.

        token names this batch in its feed; the same one twice in a row is the same batch. Columns beside the last two are
        extents' own; null ids are left out.
        """
        if self.store.token() != token:
            run = ordered(changes.where(F.col("id").isNotNull()))
            self._run(lambda head: run, token, now or clock(self.spark))
        self._tell()

    def refresh(self, datasets: DataFrame, now: dt.datetime | None = None, force: bool = False, only: list[str] | None = None, least_window: dt.timedelta | None = None, reset_position: bool = False) -> DataFrame:
        """Looks for changes of datasets since each product's last refresh; product, result, changed, months.

        A product that was never refreshed, or by an older layout, is made as a whole (created), as all are with force:
        then datasets that are no longer there go, and states that were known before count again. Others take what
        changed after the last refresh less the overlap (updated or no_changes), or after least_window before now if that is
        earlier; with reset_position after the newest dataset that is known, less nothing. The products' new positions
        become current together with the tables, so a run that dies changes neither.
        """
        now = now or clock(self.spark)
        looked = datasets if only is None else datasets.where(F.col("product").isin(only))

        def found(head: dict) -> tuple[DataFrame, DataFrame]:
            known = self.products(head)
            every = looked.select("product").distinct()
            if known is not None:  # a product whose last dataset is gone is looked at too
                every = every.union((known if only is None else known.where(F.col("product").isin(only))).select("product")).distinct()
            start, whole = F.lit(None).cast("timestamp_ntz"), F.lit(True)
            if known is not None:
                every = every.join(known, "product", "left")
                whole = F.lit(force) | F.col("last_refresh").isNull() | F.coalesce(F.col("layout") < LAYOUT, F.lit(True))
                since = F.coalesce("newest_added", "last_refresh") if reset_position else F.col("last_refresh") - F.expr(f"INTERVAL {int(refresh.OVERLAP.total_seconds())} SECONDS")
                start = F.when(~whole, F.least(since, _time(now - least_window)) if least_window else since)
            products = tables.stored(every.select("product", start.alias("start"), whole.alias("whole")), "looked")
            least = products.agg(F.min("start").alias("t"), F.max("whole").alias("w")).first()
            some = looked
            if not least.w and least.t is not None:  # reaches the scan
                after = lambda x: F.col(x) > _time(least.t)
                some = looked.where(after("added") | after("updated") | after("archived"))
            states = ordered(some.where(F.col("id").isNotNull())).join(products, "product").where(F.col("whole") | (F.col("_changed") > F.col("start")))
            old = self.extents(head)
            if old is not None and least.w:
                gone = old.join(products.where("whole"), "product", "left_semi").join(looked.select("id", "product"), ["id", "product"], "left_anti")
                gone = ordered(gone.withColumns({"updated": F.lit(None).cast("timestamp_ntz"), "archived": _time(now)}).select(*looked.columns)).withColumn("_digest", F.lit(0).cast("long"))
                # what another product has by now comes last
                states = states.unionByName(gone.join(datasets.select("id"), "id", "left_anti").withColumns({"start": F.lit(None).cast("timestamp_ntz"), "whole": F.lit(True)}))
            return states.drop("start"), products

        return self._run(found, f"refresh-{now.isoformat()}", now)

    # ---- one run

    def _run(self, found: Callable, token: str, now: dt.datetime) -> DataFrame:
        while True:
            head = self.store.head()
            given = found(head)
            states, looked = given if isinstance(given, tuple) else (given, None)
            try:
                return self._once(head, states, looked, token, now)
            except Conflict:  # another run was first: look again from where it left the tables
                continue
            finally:
                if looked is not None:
                    tables.drop(looked)

    def _codes(self, df: DataFrame, partition: Column) -> list[str]:
        """Partitions of rows; as many as a version's file lists at most."""
        return [r.c for r in df.select(partition.alias("c")).distinct().collect()]

    def _once(self, head: dict, states: DataFrame, looked: DataFrame | None, token: str, now: dt.datetime) -> DataFrame:
        store, month = self.store, cell.month_of(self.tz)
        bucket = F.format_string("b%03d", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
        if "whole" not in states.columns:
            states = states.withColumn("whole", F.lit(False))
        batch = tables.stored(latest(states).withColumn("month", month), "batch")
        buckets = self._codes(batch, bucket)
        log = store.read("log", buckets, head)
        if log is None:
            won = batch.withColumns({"_old_product": F.lit(None).cast("string"), "_old_month": F.lit(None).cast("date"), "_was": F.lit(False)})
        else:
            mine = latest(log.join(batch.select("id"), "id", "left_semi"))
            before = mine.select("id", F.struct(*_ADDED).alias("_key"), F.col("product").alias("_old_product"), F.col("month").alias("_old_month"), (~F.col("_gone")).alias("_was"))
            key = F.struct(*_ADDED)
            newer = F.col("_key").isNull() | (key > F.col("_key")) | (F.col("whole") & (key != F.col("_key")))
            won = batch.join(before, "id", "left").where(newer).withColumn("_was", F.coalesce("_was", F.lit(False))).drop("_key")
        won = tables.stored(won, "won")
        columns = [x for x in batch.columns if x not in (*_ADDED, "whole", "month", "updated", "archived")]

        # the months that datasets are in now or were in
        places = won.where(~F.col("_gone")).select("product", "month").union(won.where("_was").select("_old_product", "_old_month"))
        old_cells = self.cells(head)
        if looked is not None and old_cells is not None:  # products made as a whole: all their months
            places = places.union(old_cells.where("period_type = 'month'").join(looked.where("whole"), "product", "left_semi").select("product", "month"))
        places = tables.stored(places.distinct(), "places")
        by_month, by_product = code("product", "month"), code("product")
        codes = self._codes(places, by_month)
        old = store.read("extents", codes, head)
        old = None if old is None else old.drop("month")
        live = won.where(~F.col("_gone")).select(*columns)
        new = live if old is None else old.join(won.select("id"), "id", "left_anti").unionByName(live)
        extents = store.stage("extents", Change(new.withColumn("month", month), by_month, codes, order=("cell",) if "cell" in new.columns else ()))
        made = cell.month_cells(store.staged(extents), self.tz).withColumn("generated", _time(now))

        # cells of the products: the other months stay, years and all time are made from the months
        product_codes = self._codes(places, by_product)
        kept = store.read("cells", product_codes, head)
        if kept is not None:
            kept = kept.where("period_type = 'month'").drop("period_type", "start_day", "timeline_unit")
            same = kept["product"].eqNullSafe(places["product"]) & kept["month"].eqNullSafe(places["month"])
            made = kept.join(places, same, "left_anti").unionByName(made.drop("timeline_unit"))
        months = tables.stored(made, "months")
        rolled = cell.roll_up(months)
        stamps = months.withColumn("y", F.year("month")).groupingSets([["product"], ["product", "y"], ["product", "y", "month"]], "product", "y", "month")
        level = F.when(F.grouping_id() == 3, "all").when(F.grouping_id() == 1, "year").otherwise("month")
        stamps = stamps.agg(level.alias("period_type"), F.min("generated").alias("generated")).withColumn("start_day", F.coalesce("month", F.make_date(F.coalesce("y", F.lit(1900)), F.lit(1), F.lit(1))))
        rolled = rolled.join(stamps.select("product", "period_type", "start_day", F.col("month").alias("_m"), "generated"), (rolled["product"].eqNullSafe(stamps["product"])) & (rolled["period_type"] == stamps["period_type"]) & (rolled["start_day"] == stamps["start_day"]) & rolled["month"].eqNullSafe(F.col("_m"))).select(*[rolled[x] for x in rolled.columns], "generated")
        cells = store.stage("cells", Change(rolled, by_product, product_codes))

        log_rows = won.select("id", "product", "month", *_ADDED)
        crowded = [k for k in buckets if len(head["tables"].get("log", {"parts": {}})["parts"].get(k, [])) >= MERGE_AT]
        logs = [store.stage("log", Change(log_rows.where(~bucket.isin(crowded)), bucket, [], append=True))]
        if crowded:
            merged = latest(store.read("log", crowded, head).unionByName(log_rows.where(bucket.isin(crowded))))
            logs.append(store.stage("log", Change(merged, bucket, crowded)))

        positions, result = self._positions(head, won, looked, places, store.staged(cells), now)
        products = store.stage("products", Change(positions, F.lit("all"), ["all"]))
        affected = store.stage("affected", Change(places, F.lit("all"), ["all"]))
        stages = [extents, cells, *logs, products, affected]
        store.commit(head, stages, token)
        tables.drop(batch, won, places, months)
        self.written = {}
        for s in stages:
            self.written[s["table"]] = self.written.get(s["table"], 0) + store.size(s)
        return result

    def _positions(self, head: dict, won: DataFrame, looked: DataFrame | None, places: DataFrame, cells: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
        """The products' positions after a run, and what it did to each product that it looked at."""
        known = self.products(head)
        touched = places.groupBy("product").agg(F.count(F.lit(1)).alias("months"))
        changed = won.groupBy("product").agg(F.count(F.lit(1)).alias("changed"), F.max("added").alias("_newest"))
        every = touched.select("product") if looked is None else touched.select("product").union(looked.select("product")).distinct()
        own = every.join(touched, "product", "left").join(changed, "product", "left").fillna(0, ["months", "changed"])
        whole = cells.where("period_type = 'all'").select("product", F.col("begin").alias("time_earliest"), F.col("end").alias("time_latest"), "dataset_count")
        columns = ["product", "last_refresh", "newest_added", "layout", "time_earliest", "time_latest", "dataset_count"]
        if known is None:
            known = self.spark.createDataFrame([], "product string, last_refresh timestamp_ntz, newest_added timestamp_ntz, layout int, time_earliest timestamp_ntz, time_latest timestamp_ntz, dataset_count long")
        # a product that was only found to have nothing new keeps its bounds
        before = known.select("product", F.col("last_refresh").alias("_at"), F.col("newest_added").alias("_added"), F.col("layout").alias("_layout"), *(F.col(x).alias(f"_{x}") for x in columns[4:]))
        new = own.join(whole, "product", "left").join(before, "product", "left")
        bound = lambda x: F.when(F.col("months") > 0, F.col(x)).otherwise(F.col(f"_{x}"))
        # a feed tells of changes as they come; only a look at all datasets moves a position
        at = F.greatest("_at", _time(now)) if looked is not None else F.col("_at")
        if looked is not None:
            was_looked = looked.select("product", F.lit(True).alias("_looked"), F.col("whole").alias("_whole"))
            new = new.join(was_looked, "product", "left")
            at = F.when(F.col("_looked"), at).otherwise(F.col("_at"))
        new = tables.stored(new.withColumns({"last_refresh": at, "newest_added": F.greatest("_added", "_newest"), "layout": F.lit(LAYOUT) if looked is not None else F.coalesce("_layout", F.lit(LAYOUT)), "_te": bound("time_earliest"), "_tl": bound("time_latest"), "_n": F.coalesce(bound("dataset_count"), F.lit(0).cast("long"))}), "positions")
        positions = new.select("product", "last_refresh", "newest_added", "layout", F.col("_te").alias("time_earliest"), F.col("_tl").alias("time_latest"), F.col("_n").alias("dataset_count"))
        result = F.when(F.col("_whole") if looked is not None else F.lit(False), "created").when((F.col("changed") > 0) | (F.col("months") > 0), "updated").otherwise("no_changes")
        told = new.select("product", result.alias("result"), "changed", "months")
        return known.join(new.select("product"), "product", "left_anti").select(*columns).unionByName(positions), told

    def refresh_quality(self, products: list[str] | None = None) -> DataFrame:
        """The stored table of facts.quality_stats, made again for all products or for some, beside the other tables.

        It is told from the extents, so these need footprint, srid, size_bytes and region_code.
        """
        by_product = code("product")
        while True:
            head = self.store.head()
            found = self.extents(head)
            if found is None:
                raise ValueError("nothing is stored yet")
            some = found if products is None else found.where(F.col("product").isin(products))
            old = head["tables"].get("quality", {"parts": {}})["parts"]
            codes = list(old) if products is None else self._codes(self.spark.createDataFrame([(x,) for x in products], "product string"), by_product)
            stage = self.store.stage("quality", Change(facts.quality_stats(some), by_product, codes))
            try:
                self.store.commit(head, [stage], head["token"])
            except Conflict:
                continue
            return self.store.read("quality")

    def _tell(self) -> None:
        head = self.store.head()
        for tell in self.listeners:
            made, places = self.month_cells(head), self.store.read("affected", head=head)
            same = made["product"].eqNullSafe(places["product"]) & made["month"].eqNullSafe(places["month"])
            tell(made.join(places, same, "left_semi"))
