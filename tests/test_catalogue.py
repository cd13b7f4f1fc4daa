"""Catalogue operators on made-up documents and small tables."""

import datetime as dt
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from eocatalog.functions import crs, fields, regions, texts, times
from eocatalog.operators import aggregates as agg
from eocatalog.operators import cql2, extents, facts, geometry, refresh, search, stac
from eocatalog.plans import registry
from eocatalog.sources import documents, tables
from eocatalog.sources.partitioned import Partitioned
from eocatalog.streaming.refresh import StreamingRefresh

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't here")


#: An older dialect: times and corners in the document, regions by tile.
OLD_TYPE = {
    "name": "old",
    "dataset": {
        "creation_dt": ["creation_dt"],
        "grid_spatial": ["grid_spatial", "projection"],
        "measurements": ["image", "bands"],
        "search_fields": {
            "time": {"type": "datetime-range", "min_offset": [["extent", "from_dt"], ["extent", "center_dt"]], "max_offset": [["extent", "to_dt"], ["extent", "center_dt"]]},
            "platform": {"offset": ["platform", "code"]},
        },
    },
}
TILES = {"name": "tiles", "metadata_type": "old", "storage": {"crs": "EPSG:3577", "tile_size": {"x": 100_000.0, "y": 100_000.0}}}
#: A newer dialect: an outline and named properties, regions from a field.
NEW_TYPE = {
    "name": "new",
    "dataset": {
        "measurements": ["measurements"],
        "creation_dt": ["properties", "odc:processing_datetime"],
        "search_fields": {"region_code": {"offset": ["properties", "odc:region_code"]}, "cloud_cover": {"offset": ["properties", "eo:cloud_cover"], "type": "double"}},
    },
}
SCENES = {"name": "scenes", "metadata_type": "new"}


def old_document(i, begin, end, x=-1_399_990.0, y=-2_499_990.0, **projection):
    corner = lambda dx, dy: {"x": x + dx, "y": y + dy}
    points = {"ll": corner(0, 0), "lr": corner(90_000, 0), "ul": corner(0, 90_000), "ur": corner(90_000, 90_000)}
    return {"id": i, "creation_dt": "2019-05-05T01:02:03Z", "size_bytes": 77, "platform": {"code": "SAT_5"}, "extent": {"from_dt": begin, "to_dt": end, "center_dt": begin}, "grid_spatial": {"projection": {"geo_ref_points": points, **projection}}}


def new_document(i, when, ring, region="x11y46", cloud=None, crs_name="epsg:32755"):
    return {"id": i, "crs": crs_name.upper(), "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"datetime": when, "odc:region_code": region, "eo:cloud_cover": cloud, "odc:processing_datetime": "2020-02-02T00:00:00Z"}}


def made_extents(spark, docs, md, product):
    rows = [(d["id"], json.dumps(d), dt.datetime(2021, 1, 1), None) for d in docs]
    return extents.extents(spark.createDataFrame(rows, "id string, doc string, added timestamp_ntz, archived timestamp_ntz"), md, product)


def test_tile_product_by_zone(spark):
    hours = ["2010-12-31T00:10", "2010-12-31T00:30", "2010-12-31T15:00", "2010-12-31T16:00", "2010-12-31T17:00"]
    docs = [old_document(str(i), f"{t}:00Z", f"{t}:20Z") for i, t in enumerate(hours)]
    e = made_extents(spark, docs, OLD_TYPE, TILES).cache()
    days = lambda tz: {r.day.isoformat(): r.n for r in agg.day_histogram(e, tz).collect()}
    assert days("Australia/Darwin") == {"2010-12-31": 2, "2011-01-01": 3}
    assert days("America/Chicago") == {"2010-12-30": 2, "2010-12-31": 3}
    r = e.where("id = '0'").first()
    assert (r.center_time, r.creation_time) == (dt.datetime(2010, 12, 31, 0, 10, 10), dt.datetime(2019, 5, 5, 1, 2, 3))
    assert (r.srid, r.size_bytes, r.region_code) == (3577, 77, "-14_-25") and r.footprint


def test_tile_codes_and_missing_corners(spark):
    t = "2015-01-01T00:00:00Z"
    whole, other, bare = old_document("a", t, t), old_document("b", t, t, x=800_010.0, y=-3_599_990.0), old_document("c", t, t)
    del bare["grid_spatial"]
    got = {r.id: (r.region_code, r.footprint is None) for r in made_extents(spark, [whole, other, bare], OLD_TYPE, TILES).collect()}
    assert got == {"a": ("-14_-25", False), "b": ("8_-36", False), "c": (None, True)}


def test_reference_systems_of_documents(spark):
    t = "2015-01-01T00:00:00Z"
    docs = [
        old_document("zone", t, t, datum="GDA94", zone=-55),
        old_document("name", t, t, spatial_reference="EPSG:32655"),
        old_document("text", t, t, spatial_reference='PROJCS["x",AUTHORITY["EPSG","3577"]]'),
        old_document("none", t, t, spatial_reference="nonsense"),
    ]
    got = {r.id: r.srid for r in made_extents(spark, docs, OLD_TYPE, {"name": "p"}).collect()}
    assert got == {"zone": 28355, "name": 32655, "text": 3577, "none": None}


def square(x, y, size=1000.0):
    return [[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]


def test_invalid_outlines_count_nowhere(spark):
    flat = [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [0.0, 0.0]]
    docs = [new_document(str(i), f"2019-0{i + 1}-01T00:00:00Z", square(5e5, 6e6)) for i in range(4)] + [new_document("flat", "2020-09-01T00:00:00Z", flat)]
    e = made_extents(spark, docs, NEW_TYPE, SCENES).withColumn("footprint_valid", geometry.is_valid("footprint"))
    assert e.count() == 5
    assert agg.valid_only(e).count() == 4
    assert [(r.region_code, r.n) for r in agg.region_histogram(agg.valid_only(e)).collect()] == [("x11y46", 4)]


def test_values_that_cannot_be_read_are_null(spark):
    odd = new_document("odd", "no time", square(0, 0), cloud="many")
    r = made_extents(spark, [odd], NEW_TYPE, SCENES).first()
    assert r.center_time is None and r.region_code == "x11y46"


def test_cql2_over_documents(spark):
    docs = [new_document(str(i), "2019-01-01T00:00:00Z", square(0, 0), cloud=None if i == 0 else i * 10.5) for i in range(8)]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")
    own = fields.compile_fields(F.col("doc"), NEW_TYPE) | {"eo:cloud_cover": fields.json_path(F.col("doc"), ["properties", "eo:cloud_cover"])}
    count = lambda f: df.where(cql2.compile_filter(f, own)).count()
    assert count("eo:cloud_cover < 50") == 4 and count("cloud_cover < 50") == 4
    assert count('"eo:cloud_cover" IS NULL') == 1
    assert count("no:such = 3") == 0
    assert count("no:such IS NULL") == 8


def test_documents_are_read_where_they_are(spark, tmp_path):
    import gzip

    docs = [old_document("a", "2015-01-01T00:00:00Z", "2015-01-01T00:00:00Z"), {"id": "b", "when": dt.date(2020, 1, 2).isoformat()}]
    (tmp_path / "one.yaml").write_text(stac.to_yaml(docs))
    (tmp_path / "two.yaml.gz").write_bytes(gzip.compress(stac.to_yaml(docs[:1]).encode()))
    (tmp_path / "three.json").write_text(json.dumps(docs))
    got = documents.read_documents(spark, str(tmp_path)).collect()
    assert sorted(r.id for r in got) == ["a", "a", "a", "b", "b"]
    assert all(json.loads(r.doc) in docs for r in got)


@needs_tables
def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SMALL}/{name}'")
    plain = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = lambda columns, found: sorted(tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in found)
    for name, sql in registry.oracle_sql().items():
        got, want = registry.queries()[name](spark, SMALL), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()), name


@needs_tables
def test_queries_without_sql_run(spark):
    for name in registry.queries().keys() - registry.oracle_sql().keys():
        assert registry.queries()[name](spark, SMALL).count() > 0, name


def test_union_by_levels_equals_one_union(spark):
    from eocatalog.functions import shapes

    boxes = [(i % 3, shapes.to_wkb(shapes.box(i * 0.4, i % 5, i * 0.4 + 1, i % 5 + 1))) for i in range(60)]
    df = spark.createDataFrame(boxes, "product int, footprint binary")
    got = {r.product: shapes.area(shapes.from_wkb(bytes(r.footprint))) for r in geometry.union_by(df, ["product"], fan_in=4).collect()}
    for k in range(3):
        want = shapes.union([shapes.from_wkb(b) for p, b in boxes if p == k])
        assert got[k] == pytest.approx(shapes.area(want))


def test_region_coverage(spark):
    from eocatalog.functions import shapes

    x, y = 500_000.0, 6_000_000.0
    rows = [("p", r, 32755, shapes.to_wkb(shapes.box(x + i * 500, y, x + i * 500 + 1000, y + 1000))) for i, r in enumerate(["a", "a", None, "a"])]
    got = {r.region_code: r for r in geometry.region_coverage(spark.createDataFrame(rows, "product string, region_code string, srid int, footprint binary")).collect()}
    assert {k: r.n for k, r in got.items()} == {"a": 3, "": 1}


def test_add_periods(spark):
    schema = "product string, dataset_count long, size_bytes long, begin date, end date, newest date, generated date, timeline array<struct<key:date,n:bigint>>, regions array<struct<key:string,n:bigint>>"
    day = dt.date
    cells = [
        ("p", 3, 10, day(2020, 1, 1), day(2020, 2, 1), day(2020, 5, 1), day(2021, 1, 1), [(day(2020, 1, 3), 3)], [("a", 1), (None, 2)]),
        ("p", 1, None, day(2020, 2, 1), day(2020, 3, 1), day(2020, 6, 1), day(2020, 12, 1), [(day(2020, 2, 3), 1)], [("a", 1)]),
        ("p", 0, 99, day(1990, 2, 1), day(2030, 3, 1), None, day(2022, 12, 1), [], []),
        ("q", 0, None, None, None, None, day(2022, 1, 1), [], []),
    ]
    got = {r["product"]: r for r in agg.add_periods(spark.createDataFrame(cells, schema), ["product"]).collect()}
    p = got["p"]
    assert (p.dataset_count, p.size_bytes, p.begin, p.end, p.newest, p.generated) == (4, 10, day(2020, 1, 1), day(2020, 3, 1), day(2020, 6, 1), day(2020, 12, 1))
    assert [tuple(x) for x in p.timeline] == [(day(2020, 1, 3), 3), (day(2020, 2, 3), 1)]
    assert {tuple(x) for x in p.regions} == {("a", 2), (None, 2)}
    assert (got["q"].dataset_count, got["q"].size_bytes, got["q"].regions) == (0, 0, [])


def change_rows(events):
    return [(i, p, t, t, 5, a, None, arch) for i, p, t, a, arch in events]


CHANGES = "id string, product string, center_time timestamp_ntz, creation_time timestamp_ntz, size_bytes long, added timestamp_ntz, updated timestamp_ntz, archived timestamp_ntz"


def test_incremental_refresh_equals_full(spark):
    import random

    rng = random.Random(8)
    base = dt.datetime(2020, 1, 1)
    state, live = {}, spark.createDataFrame([], CHANGES).drop("updated", "archived")
    cells = refresh.month_cells(live, "UTC")
    for step in range(3):
        batch = {}
        for _ in range(25):
            i = str(rng.randrange(40))
            t = base + dt.timedelta(days=rng.randrange(200))
            gone = base + dt.timedelta(days=400 + step) if rng.random() < 0.3 else None
            batch[i] = (i, f"p{rng.randrange(2)}", t, base + dt.timedelta(days=300 + step), gone)
        state |= batch
        changes = spark.createDataFrame(change_rows(batch.values()), CHANGES)
        affected = refresh.affected_months(live, changes, "UTC")
        new = spark.createDataFrame(refresh.apply_changes(live, changes).collect(), live.schema)
        cells = spark.createDataFrame(refresh.refresh_months(cells, new, affected, "UTC").collect(), cells.schema)
        live = new
        want = [r for r in state.values() if r[4] is None]
        assert {r.id for r in live.collect()} == {r[0] for r in want}
        key = lambda r: tuple(map(str, r))
        assert sorted(cells.collect(), key=key) == sorted(refresh.month_cells(live, "UTC").collect(), key=key)


def test_streaming_refresh(spark, tmp_path):
    t = dt.datetime(2020, 5, 5)
    feed = str(tmp_path / "feed")
    first = [("a", "p", t, t, None), ("b", "p", t, t, None), ("c", "q", t, t, None)]
    second = [("a", "p", t, t, t + dt.timedelta(days=9)), ("b", "q", t.replace(month=6), t + dt.timedelta(days=8), None)]
    told = []
    stream = StreamingRefresh(spark, f"file://{tmp_path}/store", listeners=(lambda cells: told.append(cells.count()),))
    for rows in (first, second):
        spark.createDataFrame(change_rows(rows), CHANGES).write.mode("append").parquet(feed)
        changes = spark.readStream.schema(CHANGES).parquet(feed)
        stream.start(changes, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert {(r["product"], r.month.month, r.dataset_count) for r in stream.cells().collect()} == {("q", 5, 1), ("q", 6, 1)}
    assert {r.id for r in stream.extents().collect()} == {"b", "c"}
    assert told == [2, 1]


def test_watermarks():
    now = dt.datetime(2022, 1, 10)
    assert refresh.scan_start(None, now) is None
    assert refresh.scan_start(dt.datetime(2022, 1, 9), now) == dt.datetime(2022, 1, 8, 23, 45)
    assert refresh.scan_start(dt.datetime(2022, 1, 9), now, dt.timedelta(days=5)) == dt.datetime(2022, 1, 5)
    assert refresh.advance(now, dt.datetime(2021, 1, 1)) == now


def test_cql2_text_equals_json(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).cast("string").alias("s"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.5).alias("v"))
    own = {n: F.col(n) for n in df.columns}
    pairs = [
        ("s = '3' OR v > 60", {"op": "or", "args": [{"op": "=", "args": [{"property": "s"}, "3"]}, {"op": ">", "args": [{"property": "v"}, 60]}]}),
        ("NOT (v IS NULL) AND id NOT BETWEEN 5 AND 40", {"op": "and", "args": [{"op": "not", "args": [{"op": "isNull", "args": [{"property": "v"}]}]}, {"op": "not", "args": [{"op": "between", "args": [{"property": "id"}, 5, 40]}]}]}),
        ("id + 2 * 3 <= -4 + 20", {"op": "<=", "args": [{"op": "+", "args": [{"property": "id"}, {"op": "*", "args": [2, 3]}]}, 16]}),
        ("s IN ('1', '2') AND s <> '2'", {"op": "and", "args": [{"op": "in", "args": [{"property": "s"}, ["1", "2"]]}, {"op": "<>", "args": [{"property": "s"}, "2"]}]}),
    ]
    for text, tree in pairs:
        got = [df.where(cql2.compile_filter(f, own)).count() for f in (text, tree, json.dumps(tree))]
        assert got[0] == got[1] == got[2] > 0
    for bad in ("s = ", "s == 3", "(s = 1", "s LIKE", "AND", {"op": "nonsense", "args": []}, "FOO(s)"):
        with pytest.raises(cql2.FilterError):
            cql2.compile_filter(bad, own)
    with pytest.raises(cql2.FilterError):
        cql2.parse("s = '1'", "cql2-json")


def test_times():
    utc = dt.timezone.utc
    assert times.parse_search_time("2020-01-02") == (dt.datetime(2020, 1, 2, tzinfo=utc), dt.datetime(2020, 1, 3, tzinfo=utc))
    assert times.parse_search_time("2020-01-02T03:04:05Z")[1].second == 6
    assert times.parse_search_time("../..") is None
    now = dt.datetime(2021, 1, 1, tzinfo=utc)
    assert times.parse_search_time("2020-01-01/..", now)[1] == dt.datetime(2021, 1, 3, tzinfo=utc)
    assert times.parse_duration("1d2h") == dt.timedelta(days=1, hours=2)
    with pytest.raises(ValueError):
        times.parse_duration("2 parsecs")
    assert times.period_bounds(2020, 12)[1] == dt.datetime(2021, 1, 1, tzinfo=utc)
    assert times.encode_period(None) == ("all", dt.date(1900, 1, 1))
    for p in ((None, None, None), (2020, None, None), (2020, 3, None), (2020, 3, 4)):
        assert times.decode_period(*times.encode_period(*p)) == p
    assert times.months_between(dt.date(2019, 12, 3), dt.date(2020, 2, 1)) == [(2019, 12), (2020, 1), (2020, 2)]


def test_texts(spark):
    df = spark.createDataFrame([("file://a/b/ga-metadata.yaml", 1536), ("s3://x/y/scene.odc-metadata.yaml", None), ("http://h/p/thing.stac-item.json", 10)], "u string, n long")
    got = df.select(texts.file_label(F.col("u")).alias("l"), texts.data_size(F.col("n")).alias("s"), texts.web_url(F.col("u")).alias("w")).collect()
    assert [r.l for r in got] == ["b", "scene.odc-metadata", "thing.stac-item"]
    assert [r.s for r in got] == ["1.5 KiB", None, "10 B"]
    assert got[1].w == "https://x.s3.amazonaws.com/y/scene.odc-metadata.yaml"


def test_file_paths_and_formats(spark):
    doc = {"measurements": {"red": {"path": "r.tif", "band": 1}}, "accessories": {"thumbnail": {"path": "t.jpg"}}}
    df = spark.createDataFrame([(json.dumps(doc), 2_500_000.0), ("{}", 0.0)], "doc string, a double")
    got = df.select(fields.file_paths(F.col("doc")).alias("p"), fields.thumbnail(F.col("doc")).alias("t"), texts.area_km2(F.col("a")).alias("k"), texts.percent(F.col("a"), F.lit(1e7)).alias("s")).collect()
    assert got[0].p == {"red": "r.tif", "thumbnail": "t.jpg"} and got[0].t == "t.jpg"
    assert got[1].p == {} and got[1].t is None
    assert (got[0].k, got[0].s) == ("2 km2", "25.00%")


def test_regions_and_crs():
    assert regions.label("95_-3", "tile") == "Tile +95, -3"
    assert regions.label("95_3", "scene") == "Path 95, Row 3"
    assert regions.kind_of({"sat_path": {}}, None) == "scene"
    assert crs.infer("EPSG:3577") == "epsg:3577"
    assert crs.infer('GEOGCS["GDA 1994, latitude and longitude",DATUM["Geocentric Datum of Australia 1994",SPHEROID["GRS 1980",6378137.0,298.257222]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.01745329252]]') == "epsg:4283"
    assert crs.infer("xyz") is None


def test_fields_extension():
    item = {"id": "a", "type": "Feature", "properties": {"datetime": "t", "x": 1, "y": 2}, "assets": {"b": 1}}
    assert search.prune(item, ["properties.x"], None) == {"id": "a", "type": "Feature", "properties": {"datetime": "t", "x": 1}, "assets": {"b": 1}}
    assert "assets" not in search.prune(item, None, ["assets"])
    assert search.prune(item, ["properties.none"], None)["properties"] == {"datetime": "t"}


def test_pages_and_sorting(spark):
    df = spark.createDataFrame([(str(i), "p", dt.datetime(2020, 1, 1 + i % 3), None if i % 4 == 0 else i) for i in range(30)], "id string, product string, center_time timestamp_ntz, v int")
    seen, offset = [], 0
    while True:
        rows = search.search(df, search.Search(limit=7, offset=offset)).collect()
        seen += [r.id for r in rows[:7]]
        if len(rows) <= 7:
            break
        offset += 7
    assert len(seen) == len(set(seen)) == 30
    down = [r.v for r in search.search(df, search.Search(sortby=[{"field": "v", "direction": "desc"}], limit=30)).collect()]
    assert down[:8] == [None] * 8 and down[8:] == sorted(down[8:], reverse=True)
    with pytest.raises(search.SearchError):
        search.page_size(1001)
    with pytest.raises(search.SearchError):
        search.sort_columns([{"field": "bbox"}], {})
    assert search.page_size(0) == 20 and search.api_limit(9999) == 4000


def test_stac_builders():
    rows = [{"id": str(i)} for i in range(4)]
    page = stac.page(rows, 3, 3, 10, "http://x/search")
    assert page["numberReturned"] == 3 and page["numberMatched"] == 10 and page["links"][0]["href"].endswith("limit=3&_o=6")
    assert not stac.page(rows[:3], 3, 0, None, "u")["links"]
    assert [x["title"] for x in stac.collection("p", (0, 0, 1, 1), "a", "b", [(2020, 1, 2), (2020, 2, 0)])["links"]] == ["2020-01"]
    assert stac.parse_fields("a,-b") == (["a"], ["b"])
    assert stac.parse_bool("off") is False
    assert documents.parse(stac.to_yaml([{"a": 1}, {"b": [1, 2]}]).encode(), "x.yaml") == [{"a": 1}, {"b": [1, 2]}]


def test_fixed_fields_and_empty_inputs(spark):
    rows = [("p", 1, "x", None), ("p", 2, None, None), ("q", 1, None, "y"), ("q", 2, "x", "y")]
    got = {(r["product"], r.field): (r.value, r.is_fixed) for r in facts.fixed_fields(spark.createDataFrame(rows, "product string, id int, a string, b string"), ["a", "b"]).collect()}
    assert got == {("p", "a"): ("x", True), ("p", "b"): (None, True), ("q", "a"): (None, False), ("q", "b"): ("y", True)}
    none = spark.createDataFrame([], "id string, product string, added timestamp_ntz, center_time timestamp_ntz, region_code string")
    assert facts.arrivals(none).count() == 0
    assert agg.region_histogram(none).count() == 0


def test_versioned_table(spark, tmp_path):
    table = tables.Versioned(spark, f"file://{tmp_path}/t")
    assert table.read("x") is None and table.token() is None
    for k in range(4):
        before = table.read("x")
        table.write({"x": spark.range(3) if before is None else before.where("id > 0"), "y": spark.range(k)}, f"n{k}")
        assert (table.token(), table.read("x").count(), table.read("y").count()) == (f"n{k}", 2 if k else 3, k)
    assert len(list((tmp_path / "t" / "versions").glob("0*"))) == 2


@pytest.mark.parametrize("dies_at", ["extents", "cells", "log", "marker", "listener"])
def test_repeated_batch_after_a_crash(spark, tmp_path, monkeypatch, dies_at):
    t = dt.datetime(2020, 5, 5)
    batch = lambda rows: spark.createDataFrame(change_rows(rows), CHANGES)
    stream = StreamingRefresh(spark, f"file://{tmp_path}/store")
    stream.apply(batch([("a", "p", t, t, None), ("b", "p", t, t, None), ("c", "p", t, t, None)]), 0)
    moved = batch([("a", "p", t.replace(month=6), t + dt.timedelta(days=8), None), ("b", "p", t, t, t + dt.timedelta(days=9))])

    def die(*_):
        raise RuntimeError("lost")

    plain = {name: getattr(Partitioned, name) for name in ("stage", "_publish")}
    if dies_at == "listener":
        stream.listeners = (die,)
    elif dies_at == "marker":
        monkeypatch.setattr(Partitioned, "_publish", die)
    else:

        def stage(self, table, change):
            done = plain["stage"](self, table, change)
            return die() if table == dies_at else done

        monkeypatch.setattr(Partitioned, "stage", stage)
    with pytest.raises(RuntimeError):
        stream.apply(moved, 1)
    for name, method in plain.items():
        monkeypatch.setattr(Partitioned, name, method)
    told = []
    stream.listeners = (lambda cells: told.append({(r["product"], r.month.month) for r in cells.collect()}),)
    for _ in range(2):
        stream.apply(moved, 1)
        assert {(r["product"], r.month.month, r.dataset_count) for r in stream.cells().collect()} == {("p", 5, 1), ("p", 6, 1)}
        assert {r.id for r in stream.extents().collect()} == {"a", "c"}
    assert told == [{("p", 5), ("p", 6)}] * 2


def test_cql2_shape_on_either_side(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 4.0, 4.0, 5.0, 5.0), (3, 20.0, 0.0, 21.0, 1.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    bounds = tuple(F.col(n) for n in ("x0", "y0", "x1", "y1"))
    square = "POLYGON((3 3, 6 3, 6 6, 3 6, 3 3))"
    ids = lambda f: {r.id for r in df.where(cql2.compile_filter(f, {"id": F.col("id")}, bounds)).collect()}
    assert ids(f"S_WITHIN(geometry, {square})") == ids(f"S_CONTAINS({square}, geometry)") == {2}
    assert ids(f"S_CONTAINS(geometry, {square})") == ids(f"S_WITHIN({square}, geometry)") == {1}


def test_data_sizes_of_every_row(spark, tmp_path):
    rows = [(1, 5), (2, 2048), (3, 1 << 20), (4, 5 << 30), (5, None)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r.size for r in registry.queries()["data_sizes"](spark, str(tmp_path)).collect()}
    assert got == {1: "5 B", 2: "2.0 KiB", 3: "1.0 MiB", 4: "5.0 GiB", 5: None}


def test_a_row_is_placed_by_one_call(spark):
    """However many of its columns are used, and whatever filter follows: calls of Python are what takes time."""
    from eocatalog.functions import shapes
    from eocatalog.operators import job

    ring = [[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 0.0]]
    wkb = bytearray(shapes.to_wkb({"type": "Polygon", "coordinates": [ring]}))
    bow = bytearray(shapes.to_wkb({"type": "Polygon", "coordinates": [[[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]]}))
    rows = [("a", wkb, 4326), ("b", bow, 4326), ("c", None, 4326), ("d", wkb, None)]
    out = job.placed(spark.createDataFrame(rows, "id string, footprint binary, srid int"))
    used = out.where(F.col("valid").isNull() | F.col("valid")).select("id", "xmin", "ymin", "xmax", "ymax", "cell", "outline")
    assert used._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    got = {r.id: r for r in out.collect()}
    assert [got[k].valid for k in "abcd"] == [True, False, None, True]
    assert (got["a"].xmin, got["a"].ymin, got["a"].xmax, got["a"].ymax) == (0, 0, 2, 1) and len(got["a"].rings) == 1
    assert got["c"].xmin is None and got["d"].xmin is None and got["d"].outline is None
