"""Lookups, replaced tables, the whole refresh and items on small tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eocatalog.functions import shapes
from eocatalog.operators import aggregates as agg
from eocatalog.operators import extents, geometry, job, lookups, search, stac
from tests.test_catalogue import NEW_TYPE, OLD_TYPE, SCENES, TILES, made_extents, new_document, old_document


def _products(spark):
    return spark.createDataFrame([(1, "a", "t"), (2, "b", "t")], "id int, product string, metadata_type string")


def test_names_and_ids(spark):
    p = _products(spark)
    assert lookups.product_by_id(p, 2).first().product == "b"
    with pytest.raises(KeyError):
        lookups.product_by_id(p, 9)
    assert lookups.checked_names(p, ["b"]) == ["b"]
    with pytest.raises(ValueError, match="there are: a, b"):
        lookups.checked_names(p, ["b", "c"])
    refs = spark.createDataFrame([(1, 7), (9, 8)], "product_ref int, x int")
    assert [r.x for r in lookups.of_product(refs, p, "a").collect()] == [7]
    assert {r.x: r.product for r in lookups.with_product_names(refs, p).collect()} == {7: "a", 8: None}
    assert [r.x for r in lookups.cells_of_products(refs, p).collect()] == [7]


def test_cells_and_summaries(spark):
    cells = spark.createDataFrame([("a", "month", dt.date(2020, 2, 1), 3, 1), ("a", "all", dt.date(1900, 1, 1), 3, 1)], "product string, period_type string, start_day date, dataset_count long, size_bytes long")
    assert lookups.has_cell(cells, "a") and lookups.has_cell(cells, "a", 2020, 2) and not lookups.has_cell(cells, "a", 2020)
    datasets = spark.createDataFrame([("a", dt.datetime(2020, 2, 1, 23), 5), ("a", dt.datetime(2020, 2, 2), None)], "product string, center_time timestamp_ntz, size_bytes long")
    assert lookups.cell(cells, datasets, "a", 2020, 2).first().dataset_count == 3
    day = lookups.cell(cells, datasets, "a", 2020, 2, 1, "UTC").first()
    assert (day.dataset_count, day.size_bytes) == (1, 5)
    p, summaries = _products(spark), spark.createDataFrame([(4, "a", 3)], "id int, product string, n int")
    assert lookups.product_summary(summaries, p, "a").n == 3 and lookups.product_summary(summaries, p, "b") is None
    with pytest.raises(ValueError):
        lookups.product_summary(summaries, p, "c")
    new = spark.createDataFrame([(9, "a", 8), (10, "b", 9)], "id int, product string, n int")
    assert sorted(lookups.put_product_summaries(summaries, new).collect()) == [(4, "a", 8), (10, "b", 9)]
    timed = lookups.day_timings(datasets, agg.product_extent(datasets))
    assert [(t["product"], t["dataset_count"]) for t in timed] == [("a", 1)]


def test_regions_are_replaced(spark):
    schema = "product string, region_code string, footprint string, n int"
    old = spark.createDataFrame([("a", "1", "x", 1), ("a", None, "x", 1), ("b", "1", "x", 1), ("c", "1", None, 2)], schema)
    new = spark.createDataFrame([("a", "1", "y", 2)], schema)
    refreshed = spark.createDataFrame([("a",), ("b",)], "product string")
    assert sorted(lookups.put_regions(old, new, refreshed).collect()) == [("a", "1", "y", 2), ("c", "1", None, 2)]
    assert lookups.product_regions(old, "c").isEmpty()
    codes = spark.createDataFrame([("1_-2",), ("x",), (None,)], "code string")
    assert [r[0] for r in codes.select(lookups.region_label(F.col("code"), "tile")).collect()] == ["Tile +1, -2", "x", None]
    assert [r[0] for r in codes.select(lookups.region_label(F.col("code"), "scene")).collect()] == ["Path 1, Row -2", "Path x", None]


def test_locations(spark):
    t = dt.datetime(2020, 1, 1)
    locations = spark.createDataFrame([("1", "f:///b", None), ("1", "f:///a", t), ("1", "f:///c", t), ("2", "f:///d", None)], "id string, uri string, archived timestamp_ntz")
    datasets = spark.createDataFrame([("1", "a", t, None), ("2", "a", t, t)], "id string, product string, center_time timestamp_ntz, archived timestamp_ntz")
    active = lookups.active_locations(locations, datasets)
    assert [r.uri for r in lookups.product_locations(active, "a").collect()] == ["f:///b"]
    assert lookups.product_locations(active, "a", t - dt.timedelta(1), t).isEmpty()
    assert [r.uri for r in lookups.archived_location_times(locations, "1").collect()] == ["f:///a", "f:///c"]


def test_coarsening_by_steps(spark):
    first = dt.date(1900, 1, 1)
    rows = [("a", "month", dt.date(1900 + k // 12, k % 12 + 1, 1), k % 2) for k in range(48)] + [("b", "month", first, 0), ("c", "year", first, 1)]
    got = agg.coarsen(spark.createDataFrame(rows, "product string, unit string, day date, n long"), 36).collect()
    assert sorted((r.product, r.unit, r.day.year, r.n) for r in got) == [*[("a", "year", 1900 + y, 6) for y in range(4)], ("b", "month", 1900, 0), ("c", "year", 1900, 1)]


def test_places_of_documents(spark):
    d = new_document("1", "2020-01-01T00:00:00Z", [])
    del d["geometry"]
    d["grids"] = {"default": {"shape": [2, 4], "transform": [10, 0, 100, 0, -10, 50, 0, 0, 1]}}
    row = made_extents(spark, [d], NEW_TYPE, SCENES).withColumn("text", geometry.ewkt(F.col("footprint"), F.col("srid"))).first()
    assert shapes.envelope(shapes.from_wkb(bytes(row.footprint))) == (100, 30, 140, 50)
    assert row.text == "SRID=32755;POLYGON((100 30,100 50,140 50,140 30,100 30))"
    nowhere = {**OLD_TYPE, "dataset": {k: v for k, v in OLD_TYPE["dataset"].items() if k != "grid_spatial"}}
    row = made_extents(spark, [old_document("1", "2020-01-01T00:00:00Z", "2020-01-01T00:00:00Z")], nowhere, TILES).first()
    assert (row.footprint, row.srid, row.region_code) == (None, None, None) and row.center_time is not None


def test_whole_refresh(spark):
    square = lambda x: [[x, 0], [x, 1], [x + 2, 1], [x + 2, 0], [x, 0]]
    docs = [new_document(str(i), f"2020-0{1 + i % 2}-01T00:00:00Z", square(i), "r", crs_name="epsg:4326") for i in range(4)]
    docs.append(new_document("bad", "2020-01-01T00:00:00Z", [[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]], "r", crs_name="epsg:4326"))
    rows = [(d["id"], "scenes", json.dumps(d), dt.datetime(2021, 1, 1), None) for d in docs]
    made = job.extents_of(spark.createDataFrame(rows, "id string, product string, doc string, added timestamp_ntz, archived timestamp_ntz"), [(NEW_TYPE, SCENES)])
    whole = job.period_summary(made, 4326, tz="UTC").first()
    assert (whole.dataset_count, whole.srids, len(whole.timeline)) == (4, [4326], 2) and [tuple(r) for r in whole.regions] == [("r", 4)]
    assert shapes.area(shapes.from_wkb(bytes(whole.footprint))) == pytest.approx(5)
    old = job.tables_of(made, "UTC")
    gone = job.refresh_tables(old, made.where("false"), spark.createDataFrame([("scenes",)], "product string"), "UTC")
    assert all(t.isEmpty() for t in gone.values()) and not old["cells"].isEmpty()
    assert lookups.footprint_region(made, "1").first().region_code == "r" and lookups.footprint_region(made, "none").isEmpty()
    box = made.where("id = '3'").select(geometry.lonlat_bounds(F.col("footprint"), F.col("srid")).alias("b")).first().b
    assert tuple(box) == (3, 0, 5, 1)


def test_assets_and_links(spark):
    doc = {"measurements": {"b": {"path": "b.TIF"}, "none": {}}, "accessories": {"b": {"path": "x"}, "thumbnail:n": {"path": "http://h/t.jpg"}, "m": {"path": "m"}}, "lineage": {"k": ["1", "2"], "e": None}}
    rows = spark.createDataFrame([("1", json.dumps(doc), "file:///d/x.yaml"), ("2", "not json", None), ("3", None, "s3://b/k/x.json")], "id string, doc string, uri string")
    t = F.lit(None).cast("timestamp_ntz")
    rows = rows.select("*", F.lit("p").alias("product"), t.alias("center_time"), t.alias("creation_time"), F.lit(None).cast("string").alias("region_code"), *[F.lit(None).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    first, second, third = (json.loads(r.item) for r in stac.items(rows, doc="doc", uri="uri").orderBy("id").collect())
    assert first["assets"] == {
        "b": {"href": "file:///d/b.TIF", "title": "b", "type": "image/tiff; application=geotiff", "roles": ["data"]},
        "thumbnail:n": {"href": "http://h/t.jpg", "title": "thumbnail:n", "type": "image/jpeg", "roles": ["thumbnail"]},
        "m": {"href": "file:///d/m", "title": "m", "roles": ["metadata"]},
    }
    assert [x["href"] for x in first["links"] if x["rel"] == "derived_from"] == ["/dataset/1", "/dataset/2"]
    assert second["assets"] == {} and [x["rel"] for x in second["links"]] == ["self", "collection"]
    assert third["links"][-1] == {"rel": "canonical", "href": "https://b.s3.amazonaws.com/k/x.json"}


def test_hard_limit_and_arguments(spark):
    rows = spark.createDataFrame([(str(i), "p", dt.datetime(2020, 1, 9 - i)) for i in range(5)], "id string, product string, center_time timestamp_ntz")
    assert [r.id for r in search.hard_limited(rows, search.Search(products=["p"]), 2).collect()] == ["4", "3", "2"]
    assert search.normalised({"dataset_maturity": "NRT", "x": "Y"}) == {"dataset_maturity": "nrt", "x": "Y"}
    assert extents.active(rows.withColumn("archived", F.when(F.col("id") == "1", F.col("center_time"))), "p").count() == 4


def test_outlines_are_simplified_by_the_grid(spark):
    ring = [[0.0, 0.0], [50.0, 2.0], [100.0, 0.0], [100.0, 100.0], [0.0, 100.0], [0.0, 0.0]]
    docs = [new_document("1", "2020-01-01T00:00:00Z", ring)]
    n = lambda product: len(shapes.from_wkb(bytes(made_extents(spark, docs, NEW_TYPE, product).first().footprint))["coordinates"][0])
    assert n(SCENES) == 6
    assert n({**SCENES, "storage": {"resolution": {"x": 10, "y": -30}}}) == 5  # 2.5 off
    assert n({**SCENES, "storage": {"resolution": {"x": 5, "y": -5}}}) == 6
    assert extents.tolerance({"name": "p"}) is None


def test_documents_of_one_file_are_summed_in_many_tasks(spark, tmp_path):
    import duckdb

    from eocatalog.plans import registry

    path = f"{tmp_path}/events.parquet"
    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(i::INTEGER) AS ts, i % 5 AS user_id, ['click', 'view', 'signup'][1 + i % 3] AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM range(300) t(i)) TO '{path}' (FORMAT parquet)")
    docs = registry._documents(spark, str(tmp_path))
    assert docs.select(F.spark_partition_id()).distinct().count() > 1
    got = registry.queries()["documents_to_summary"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(registry.oracle_sql()["documents_to_summary"]).fetchall())
