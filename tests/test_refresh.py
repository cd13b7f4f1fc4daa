"""The stored catalogue: changes in any order, runs that write what they touch, positions of products."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from eocatalog.operators import catalogue, cells
from eocatalog.operators.catalogue import Catalogue
from eocatalog.sources.partitioned import Change, Conflict, Partitioned, code

SCHEMA = (
    "id string, product string, center_time timestamp_ntz, creation_time timestamp_ntz, size_bytes long, region_code string, srid int, "
    "xmin double, ymin double, xmax double, ymax double, added timestamp_ntz, updated timestamp_ntz, archived timestamp_ntz"
)
BASE = dt.datetime(2020, 1, 1)
DAY = dt.timedelta(days=1)


def dataset(i, product="p", day=0, added=400, updated=None, archived=None, size=5, region="r"):
    at = lambda x: None if x is None else BASE + x * DAY
    return (str(i), product, at(day), at(added), size, region, 4326, 1.0, 2.0, 3.0, 4.0, at(added), at(updated), at(archived))


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(stored):
    """Everything that a catalogue says, for comparison."""
    found = stored.cells().drop("generated").collect()
    return {r.id for r in stored.extents().collect()}, sorted(map(repr, found))


def plainly(rows):
    """Live datasets and month counts of changes, whatever their order."""
    last = {}
    for r in rows:
        changed = max(x for x in r[11:14] if x is not None)
        last.setdefault(r[0], []).append((changed, r[13] is not None, r))
    live = [max(states, key=lambda s: s[:2])[2] for states in last.values()]
    live = [r for r in live if r[13] is None]
    counts = {}
    for r in live:
        counts[r[1], r[2].date().replace(day=1)] = counts.get((r[1], r[2].date().replace(day=1)), 0) + 1
    return {r[0] for r in live}, counts


def test_changes_in_any_order_give_one_result(spark, tmp_path):
    rng = random.Random(4)
    rows = [dataset(rng.randrange(12), f"p{rng.randrange(2)}", rng.randrange(90), 400, 401 + k, 401 + k if rng.random() < 0.3 else None) for k in range(24)]
    rows += [rows[3], rows[7]]
    batches = [rows[:9], rows[9:17], rows[17:]]
    ids, counts = plainly(rows)
    told = set()
    for n, order in enumerate([(0, 1, 2), (2, 0, 1, 2)]):
        stored = Catalogue(spark, f"file://{tmp_path}/{n}", "UTC")
        for k, b in enumerate(order):
            shuffled = batches[b][:]
            rng.shuffle(shuffled)
            stored.apply(table(spark, shuffled), f"b{k}", now=BASE + 500 * DAY)
        assert {r.id for r in stored.extents().collect()} == ids
        assert {(r["product"], r.month): r.dataset_count for r in stored.month_cells().collect()} == counts
        told.add(repr(state(stored)))
    assert len(told) == 1


def test_of_one_time_the_archived_state_counts_whichever_comes_first(spark, tmp_path):
    live, gone = dataset(1, updated=410), dataset(1, archived=410)
    older = dataset(2, "q", day=40, updated=405)
    newer = dataset(2, "p", day=2, updated=420)
    for n, batches in enumerate([([live, newer], [gone, older]), ([gone, older], [live, newer]), ([older, live, gone, newer],)]):
        stored = Catalogue(spark, f"file://{tmp_path}/{n}", "UTC")
        for k, rows in enumerate(batches):
            stored.apply(table(spark, rows), f"b{k}")
        assert [(r.id, r["product"]) for r in stored.extents().collect()] == [("2", "p")]
        assert [(r["product"], r.period_type) for r in stored.cells().where("period_type = 'all'").collect()] == [("p", "all")]


def test_a_run_writes_and_reads_what_its_changes_touch(spark, tmp_path):
    rows = [dataset(f"{month}-{i}", f"p{i % 3}", month * 30 + i % 28, region=f"r{i}") for month in range(8) for i in range(120)]
    stored = Catalogue(spark, f"file://{tmp_path}/c", "UTC")
    stored.refresh(table(spark, rows), now=BASE + 402 * DAY)
    first, before = dict(stored.written), stored.store.head()["tables"]
    stored.apply(table(spark, [dataset("0-0", "p0", 3, updated=403)]), "one")
    after = stored.store.head()["tables"]
    assert stored.written["extents"] < first["extents"] / 8
    assert stored.written["log"] < first["log"] / 20
    same = [k for k, v in before["extents"]["parts"].items() if after["extents"]["parts"].get(k) == v]
    assert len(before["extents"]["parts"]) - len(same) == 1  # that product's January
    assert sum(after["cells"]["parts"][k] != v for k, v in before["cells"]["parts"].items()) == 1
    assert stored.extents().count() == len(rows)


def test_refreshes_and_positions(spark, tmp_path):
    stored = Catalogue(spark, f"file://{tmp_path}/c", "UTC")
    at = lambda day: BASE + day * DAY
    rows = [dataset(1, "p", 1), dataset(2, "p", 40), dataset(3, "q", 1)]
    results = lambda df: {r["product"]: (r.result, r.changed) for r in df.collect()}
    assert results(stored.refresh(table(spark, rows), now=at(402))) == {"p": ("created", 2), "q": ("created", 1)}
    assert results(stored.refresh(table(spark, rows), now=at(403))) == {"p": ("no_changes", 0), "q": ("no_changes", 0)}
    assert {r.last_refresh for r in stored.products().collect()} == {at(403)}
    # a change before the last refresh isn't looked for, but within the window or from a reset position it is
    rows[0] = dataset(1, "p", 70, updated=401)
    assert results(stored.refresh(table(spark, rows), now=at(404)))["p"] == ("no_changes", 0)
    assert results(stored.refresh(table(spark, rows), now=at(405), least_window=5 * DAY))["p"] == ("updated", 1)
    rows[1] = dataset(2, "p", 41, updated=402)
    assert results(stored.refresh(table(spark, rows), now=at(406), reset_position=True, only=["p"])) == {"p": ("updated", 1)}
    assert {r["product"]: r.last_refresh for r in stored.products().collect()} == {"p": at(406), "q": at(405)}
    # a deleted dataset and one that changed its product unseen are found by force alone
    rows = [dataset(2, "q", 41, updated=402), dataset(3, "q", 1)]
    assert results(stored.refresh(table(spark, rows), now=at(407))) == {"p": ("no_changes", 0), "q": ("no_changes", 0)}
    assert results(stored.refresh(table(spark, rows), now=at(408), force=True)) == {"p": ("created", 1), "q": ("created", 1)}
    assert {(r.id, r["product"]) for r in stored.extents().collect()} == {("2", "q"), ("3", "q")}
    assert {(r["product"], r.dataset_count) for r in stored.cells().where("period_type = 'all'").collect()} == {("q", 2)}
    assert {(r["product"], r.dataset_count) for r in stored.products().collect()} == {("p", 0), ("q", 2)}


def test_a_lost_run_keeps_the_position_and_an_old_layout_is_made_anew(spark, tmp_path, monkeypatch):
    stored = Catalogue(spark, f"file://{tmp_path}/c", "UTC")
    stored.refresh(table(spark, [dataset(1)]), now=BASE + 402 * DAY)
    plain = Partitioned._publish

    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(Partitioned, "_publish", die)
    with pytest.raises(RuntimeError):
        stored.refresh(table(spark, [dataset(1), dataset(2, added=402)]), now=BASE + 403 * DAY)
    monkeypatch.setattr(Partitioned, "_publish", plain)
    assert stored.products().first().last_refresh == BASE + 402 * DAY and stored.extents().count() == 1
    result = stored.refresh(table(spark, [dataset(1), dataset(2, added=402)]), now=BASE + 404 * DAY).first()
    assert (result.result, result.changed) == ("updated", 1)
    monkeypatch.setattr(catalogue, "LAYOUT", 2)
    assert stored.refresh(table(spark, [dataset(1), dataset(2, added=402)]), now=BASE + 405 * DAY).first().result == "created"
    assert stored.products().first().layout == 2


def test_a_second_writer_begins_again(spark, tmp_path):
    stored, other = (Catalogue(spark, f"file://{tmp_path}/c", "UTC") for _ in range(2))
    stored.apply(table(spark, [dataset(1)]), "a")
    stage, raced = Partitioned.stage, []

    def slow(self, name, change):
        if not raced:
            raced.append(1)
            other.apply(table(spark, [dataset(2)]), "b")
        return stage(self, name, change)

    stored.store.stage = slow.__get__(stored.store)
    stored.apply(table(spark, [dataset(3)]), "c")
    assert {r.id for r in stored.extents().collect()} == {"1", "2", "3"}


def test_partitions_of_a_store(spark, tmp_path):
    store = Partitioned(spark, f"file://{tmp_path}/s")
    assert store.read("t") is None and store.token() is None
    rows = spark.createDataFrame([("a/b", 1), (None, 2), ("", 3)], "k string, v int")
    codes = [r[0] for r in rows.select(code("k")).collect()]
    assert len(set(codes)) == 3
    head = store.head()
    store.commit(head, [store.stage("t", Change(rows, code("k"), codes))], "one")
    with pytest.raises(Conflict):
        store.commit(head, [store.stage("t", Change(rows, code("k"), codes))], "two")
    for n in range(3):  # one partition is emptied, one replaced, one stays
        changed = rows.where("k = 'a/b'").withColumn("v", F.lit(10 + n))
        store.commit(store.head(), [store.stage("t", Change(changed, code("k"), codes[:1] + codes[2:]))], f"n{n}")
    assert {tuple(r) for r in store.read("t").collect()} == {("a/b", 12), (None, 2)}
    assert {tuple(r) for r in store.read("t", [codes[1]]).collect()} == {(None, 2)}
    assert store.read("t", []).count() == 0
    assert len(list((tmp_path / "s" / "versions").glob("0*"))) == 2
    assert len(list((tmp_path / "s" / "data" / "t").glob("*/part=*/*.parquet"))) == 3  # 12, its last version 11, and the first


def test_whole_cells(spark):
    rows = [dataset(k, "p", day, size=None if k == 1 else 5, region=None if k % 2 else "b") for k, day in enumerate([0, 0, 40, 800])] + [dataset(9, "empty", 0)]
    made = cells.roll_up(cells.month_cells(table(spark, rows).where("product = 'p'"), "UTC"))
    got = {(r.period_type, r.start_day): r for r in made.collect()}
    whole = got["all", dt.date(1900, 1, 1)]
    assert (whole.dataset_count, whole.size_bytes, whole.footprint_count, whole.srids) == (4, 15, 4, [4326])
    assert (whole.begin, whole.end) == (BASE, BASE + 800 * DAY)
    assert [tuple(x) for x in whole.regions] == [(None, 2), ("b", 2)]
    assert [x.n for x in whole.timeline] == [2, 1, 1] and len(got) == 1 + 2 + 3
    year = got["year", dt.date(2020, 1, 1)]
    assert [(x.key, x.n) for x in year.timeline] == [(dt.date(2020, 1, 1), 2), (dt.date(2020, 2, 10), 1)]
    none = cells.roll_up(cells.month_cells(table(spark, rows).where("false"), "UTC"))
    assert none.count() == 0
    bad = table(spark, rows).withColumn("valid", F.col("id") != "0")
    assert cells.month_cells(bad, "UTC").agg(F.sum("dataset_count")).first()[0] == 4
    timeless = table(spark, [dataset(1), dataset(2)]).withColumn("center_time", F.when(F.col("id") == "1", F.col("center_time")))
    assert {(r.period_type, r.start_day, r.month): r.dataset_count for r in cells.roll_up(cells.month_cells(timeless, "UTC")).collect()}[("month", dt.date(1900, 1, 1), None)] == 1


def test_long_timelines_are_kept_by_month(spark):
    rows = [dataset(k, "p", k) for k in range(400)]
    made = {r.period_type: r for r in cells.roll_up(cells.month_cells(table(spark, rows), "UTC")).where("period_type <> 'month'").orderBy("start_day", ascending=False).collect()}
    assert made["all"].timeline_unit == "month" and len(made["all"].timeline) == 14 and sum(x.n for x in made["all"].timeline) == 400
    assert made["year"].timeline_unit == "day" and len(made["year"].timeline) == 366
    assert list(itertools.accumulate(x.n for x in made["all"].timeline))[-1] == 400


def test_problems_of_stored_tables(spark, tmp_path, monkeypatch):
    stored = Catalogue(spark, f"file://{tmp_path}/c", "UTC")
    assert stored.problems() == ["nothing is stored yet"]
    stored.apply(table(spark, [dataset(1)]), "a")
    assert stored.problems() == []
    monkeypatch.setattr(catalogue, "LAYOUT", 9)
    assert stored.problems() == ["1 products have an older layout: the next refresh makes them anew"]
    monkeypatch.setitem(Catalogue.EXPECTED, "extents", {"id", "none"})
    assert stored.problems() == ["extents lacks none"]


def test_quality_is_made_again(spark, tmp_path):
    stored = Catalogue(spark, f"file://{tmp_path}/c", "UTC")
    with pytest.raises(ValueError):
        stored.refresh_quality()
    rows = table(spark, [dataset(1), dataset(2, size=None), dataset(3, "q")]).withColumn("footprint", F.when(F.col("id") != "1", F.lit("x").cast("binary")))
    stored.apply(rows, "a")
    count = lambda df: {r["product"]: (r.n, r.missing_footprint, r.has_file_size) for r in df.collect()}
    assert count(stored.refresh_quality()) == {"p": (2, 1, 1), "q": (1, 0, 1)}
    stored.apply(rows.where("id = '1'").withColumn("archived", F.col("added") + F.expr("INTERVAL 1 DAY")), "b")
    assert count(stored.refresh_quality(["q"])) == {"p": (2, 1, 1), "q": (1, 0, 1)}
    assert count(stored.refresh_quality(["p"])) == {"p": (1, 0, 0), "q": (1, 0, 1)}
    assert stored.extents().count() == 2 and stored.store.token() == "b"
