"""Items, catalogues, written documents and reference systems on small tables."""

import csv
import datetime as dt
import json

import pytest
import yaml
from pyspark.sql import functions as F

from eocatalog import settings
from eocatalog.operators import extents as ext
from eocatalog.operators import facts, items, lookups, stac, systems
from eocatalog.functions import fields, texts, times
from eocatalog.operators import aggregates as agg
from eocatalog.operators import geometry, refresh
from eocatalog.sources import documents, formats, tables

from .test_catalogue import NEW_TYPE, OLD_TYPE

T = dt.datetime(2020, 5, 5, 1, 2, 3)


def placed(spark, rows):
    """id, product, doc, uri, label and place of datasets, as items take them."""
    schema = "id string, product string, doc string, uri string"
    docs = spark.createDataFrame([(i, p, d if d is None or isinstance(d, str) else json.dumps(d), u) for i, p, d, u in rows], schema)
    told = items.described(docs, [(NEW_TYPE, {"name": "new"}), (OLD_TYPE, {"name": "old"})])
    t = F.lit(T).cast("timestamp_ntz")
    outline = F.when(F.col("id") == "a", '{"type":"Polygon","coordinates":[[[0,0],[2,0],[0,1],[0,0]]]}')
    box = [F.when(F.col("id") == "a", F.lit(v)).alias(n) for n, v in (("xmin", 0.0), ("ymin", 0.0), ("xmax", 2.0), ("ymax", 1.0))]
    return told.select("*", t.alias("center_time"), t.alias("creation_time"), F.lit("r").alias("region_code"), outline.alias("outline"), *box)


def test_items_of_odd_documents(spark):
    new = {"label": "", "properties": {"eo:cloud_cover": 1.5, "datetime": "x", "eo:instrument": "A_B", "n": {"k": [1, None]}, "none": None}, "measurements": {"m": {"path": "m.tif"}, "bad": {}}, "accessories": {"m": {"path": "x"}, "c": {"path": "c.sha1"}}, "lineage": {"l": ["1", "2"], "e": None}}
    old = {"platform": {"code": "SAT_5"}, "browse": {"full": {"path": "q.jpg"}}, "image": {"bands": {"1": {"path": "b.tif"}}}, "checksum_path": "s.sha1", "ga_label": "named"}
    rows = [("a", "new", new, "file:///d/x.yaml"), ("b", "old", old, "s3://k/f/ga-metadata.yaml"), ("c", "new", "not json", None), ("d", "old", None, None), ("e", "unknown", new, "file:///d/y.json")]
    got = {r.id: json.loads(r.item) for r in items.items(placed(spark, rows)).collect()}
    assert len(got) == 5
    a, b, c, d, e = (got[k] for k in "abcde")
    assert a["geometry"] == {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [0, 1], [0, 0]]]} and a["bbox"] == [0, 0, 2, 1]
    assert a["properties"] == {"created": "2020-05-05T01:02:03Z", "cubedash:region_code": "r", "datetime": "2020-05-05T01:02:03Z", "eo:cloud_cover": 1.5, "instruments": ["a", "b"], "n": {"k": [1, None]}, "odc:product": "new", "title": "x"}
    assert a["assets"] == {"m": {"href": "file:///d/m.tif", "title": "m", "type": "image/tiff; application=geotiff", "roles": ["data"], "eo:bands": [{"name": "m"}]}, "c": {"href": "file:///d/c.sha1", "title": "c", "roles": ["metadata"]}}
    assert [x["href"] for x in a["links"] if x["rel"] == "derived_from"] == ["/dataset/1", "/dataset/2"]
    assert b["properties"]["platform"] == "sat-5" and b["properties"]["title"] == "named" and "geometry" not in b
    assert sorted(b["assets"]) == ["1", "checksum:sha1", "thumbnail:full"] and b["assets"]["thumbnail:full"]["roles"] == ["thumbnail"]
    assert b["links"][-1] == {"rel": "canonical", "href": "https://k.s3.amazonaws.com/f/ga-metadata.yaml", "type": "text/yaml"}
    assert c["assets"] == d["assets"] == e["assets"] == {} and [x["properties"]["title"] for x in (c, d, e)] == ["c", "d", "y"]
    assert items.items(placed(spark, [])).count() == 0


def test_pages_of_months_and_arrivals(spark):
    rows = [(str(k), "p", T.replace(day=1 + k // 2), T.replace(day=1 + k // 3)) for k in range(7)]
    table = spark.createDataFrame(rows, "id string, product string, center_time timestamp_ntz, added timestamp_ntz").withColumn("label", F.concat(F.lit("l"), "id"))
    whole = spark.createDataFrame([("p", "month", dt.date(2020, 5, 1), 7)], "product string, period_type string, start_day date, dataset_count long")
    seen, after = [], None
    for _ in range(9):
        page = json.loads(items.month_page(table, whole, "p", 2020, 5, times.period_bounds(2020, 5), 3, after).first().catalogue)
        seen += [x["href"].rsplit("/", 1)[1] for x in page["links"] if x["rel"] == "item"]
        assert page["numberMatched"] == 7
        following = [x["href"] for x in page["links"] if x["rel"] == "next"]
        if not following:
            break
        at, id_ = following[0].split("after=")[1].split(",")
        after = (dt.datetime.fromisoformat(at.rstrip("Z")), id_)
    assert seen == [str(k) for k in range(7)]
    assert items.month_page(table, whole, "p", 2020, 6, times.period_bounds(2020, 6)).count() == 0
    made = table.select("id", F.col("label").alias("item"))
    first = items.arrivals_page(table, made, 2).collect()
    assert [r.id for r in first] == ["6", "3", "4"]
    assert [r.id for r in items.arrivals_page(table, made, 2, (first[1].added, first[1].id)).collect()] == ["4", "5", "0"]
    assert [x["rel"] for x in items.arrivals_catalogue()["links"]] == ["root", "self", "items"]


def test_regions_and_products_without_cells(spark):
    regions = spark.createDataFrame([("p", "2", 5, "b", '{"type":"Point","coordinates":[1,2]}'), ("p", "1", 4, "a", '{"type":"Point","coordinates":[0,0]}'), ("p", "3", 1, "c", None)], "product string, region_code string, n long, label string, geometry string")
    found = json.loads(items.region_collection(regions).first().collection)
    assert [(f["id"], f["properties"]["count"], f["geometry"]["coordinates"]) for f in found["features"]] == [("1", 4, [0, 0]), ("2", 5, [1, 2])]
    none = spark.createDataFrame([], "product string, period_type string, begin timestamp_ntz, end timestamp_ntz, xmin double, ymin double, xmax double, ymax double, timeline array<struct<key:date,n:bigint>>")
    products = spark.createDataFrame([("p", None, "About", None)], "product string, title string, description string, licence string")
    doc = json.loads(items.collections(none, products, default_licence="CC0").first().collection)
    assert doc["license"] == "CC0" and doc["extent"]["spatial"]["bbox"] == [[-180, -90, 180, 90]] and doc["title"] == "p"
    assert [x["rel"] for x in doc["links"]][:3] == ["root", "self", "items"]


DOCS = [
    {"lineage": {"source_datasets": {"l": {"id": "s1", "extent": 1}}}, "properties": {"z": 1e-10, "a": 2.0}, "extent": {}, "grid_spatial": {}, "id": "1", "$schema": "https://schemas.opendatacube.org/dataset"},
    {"$schema": "https://schemas.opendatacube.org/eo3", "lineage": {"source_datasets": {"l": {"id": "s1"}}}, "zzz": "Ünï", "label": "x", "extent": {}, "grid_spatial": {}, "id": "2"},
    {"image": {"b": [1, 2.5, None, True]}, "lineage": {"source_datasets": {"l": {"lineage": {"source_datasets": {}, "machine": 1}, "id": "s"}}, "algorithm": "2020-01-01"}, "id": "3", "name": "yes"},
    {"id": "4", "metadata": {"zoo": 1, "name": "n"}, "description": "multi\nline: text", "name": "p"},
]


def test_documents_in_order():
    one, two, three, four = (formats.ordered(d) for d in DOCS)
    assert list(two) == ["$schema", "id", "label", "lineage", "zzz"] and two["lineage"] == {"l": ["s1"]}
    assert list(one) == ["$schema", "id", "properties", "extent", "grid_spatial", "lineage"] and list(one["properties"]) == ["z", "a"]
    assert list(three) == ["name", "id", "image", "lineage"] and list(three["lineage"]) == ["algorithm", "source_datasets"]
    assert list(three["lineage"]["source_datasets"]["l"]["lineage"]) == ["machine", "source_datasets"]
    assert list(four) == ["name", "description", "metadata", "id"] and list(four["metadata"]) == ["name", "zoo"]
    assert formats.ordered({"id": 1}, ["a"]) == {"id": 1, "location": "a"} and list(formats.ordered({"id": 1}, ["a", "b"])) == ["id", "locations"]
    assert formats.header(DOCS[0], "u") == "# EO1 Dataset\n# url: u\n" and formats.header(DOCS[1]) == ""
    text = formats.as_yaml([{"a": 1e-10, "b": 2.0, "c": float("nan"), "d": 1e20, "e": 3}])
    back = next(yaml.safe_load_all(text))
    assert back["a"] == 1e-10 and back["d"] == 1e20 and isinstance(back["b"], float) and isinstance(back["e"], int) and back["c"] != back["c"]


@pytest.mark.parametrize(("form", "compressed"), [("yaml", False), ("yaml", True), ("json", True)])
def test_documents_round_trip(spark, tmp_path, form, compressed):
    docs = spark.createDataFrame([(json.dumps(d),) for d in DOCS] + [(None,)], "doc string").repartition(3)
    path = f"file://{tmp_path}/out"
    formats.write(docs, path, form, compressed)
    formats.write(docs.limit(0), path, form, compressed)
    back = formats.read(spark, path)
    assert sorted(json.dumps(json.loads(r.doc), sort_keys=True) for r in back.collect()) == sorted(json.dumps(formats.ordered(d), sort_keys=True) for d in DOCS)
    assert back.rdd.getNumPartitions() == len([f for f in (tmp_path / "out").iterdir()]) and not list((tmp_path / "out").glob("_*"))
    formats.write(docs.where(F.col("doc").contains("Ün") | F.get_json_object("doc", "$.id").isin("2")), path, form, compressed, mode="overwrite")
    assert [r.id for r in formats.read(spark, path).collect()] == ["2"]


def test_a_lost_write_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([("{}",), ("no json",)], "doc string").repartition(2)
    with pytest.raises(Exception, match="(?i)json|Expecting"):
        formats.write(bad, f"file://{tmp_path}/out")
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []
    with pytest.raises(Exception, match="neither yaml nor json"):
        formats.write(bad, f"file://{tmp_path}/out", "xml")


def test_tables_as_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id int, t string").repartition(2)
    tables.write_csv(df, str(tmp_path / "csv"))
    rows = [r for f in (tmp_path / "csv").glob("*.csv") for r in csv.DictReader(f.read_text().splitlines(), escapechar="\\")]
    assert sorted((r["id"], r["t"]) for r in rows) == [("1", 'a "b", c'), ("2", "")]
    tables.write_lines(df, str(tmp_path / "lines"))
    assert sorted(x for f in (tmp_path / "lines").glob("*.txt") for x in f.read_text().split()) == ["1", "2"]
    tables.write_features(df.select(F.col("t").alias("feature")), str(tmp_path / "f"))
    assert len([x for f in (tmp_path / "f").glob("*.txt") for x in f.read_text().splitlines()]) == 1
    kept = tables.stored(df, "kept")
    assert kept.count() == 2
    tables.drop(kept)
    with pytest.raises(Exception, match="(?i)exist|PATH_NOT_FOUND"):
        spark.read.parquet(kept._stored_path).count()


def test_reference_systems_by_dictionary(spark):
    entries = spark.createDataFrame([(1, "EPSG", 4326, "WGS 84", "GEOGCS[ \"WGS 84\" ]"), (2, "EPSG", 28355, None, None), (3, "ESRI", 4326, "wgs84", None)], "srid int, auth_name string, auth_srid int, name string, text string")
    rows = [("epsg:4326", None, None, 1), ("ESRI:4326", None, None, 3), ("wgs 84", None, None, 1), ('GEOGCS["WGS 84"]', None, None, 1), ('X["y",AUTHORITY["EPSG","28355"]]', None, None, 2), ("EPSG:1", None, None, None), (None, "GDA94", "-55", 2), (None, "GDA94", "x", None), (None, None, None, 9), ("EPSG:4326", "GDA94", "55", 1)]
    table = spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(rows)], "id int, reference string, datum string, zone string")
    got = systems.with_srid(table, systems.dictionary(entries), "reference", "datum", "zone", 9)
    assert got.columns == ["id", "reference", "datum", "zone", "srid"]
    assert {r.id: r.srid for r in got.collect()} == {k: r[3] for k, r in enumerate(rows)}
    assert systems.with_srid(table, systems.dictionary(entries.limit(0)), "reference").where("srid IS NOT NULL").count() == 0


def test_small_functions(spark):
    types = spark.createDataFrame([("b",), ("a",)], "name string")
    assert [r.name for r in lookups.metadata_types(types).collect()] == ["a", "b"]
    labelled = spark.createDataFrame([("1", "z"), ("2", "y")], "id string, label string")
    assert [r.id for r in lookups.by_label(labelled).collect()] == ["2", "1"]
    xy = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "x double, y double").select(geometry.point(F.col("x"), F.col("y")).alias("p")).collect()
    assert tuple(xy[0].p) == (1, 2) and xy[1].p is None
    old = spark.createDataFrame([("p", "all", dt.date(1900, 1, 1), 1), ("q", "all", dt.date(1900, 1, 1), 1)], "product string, period_type string, start_day date, n int")
    assert {(r["product"], r.n) for r in refresh.put_cells(old, old.where("product = 'p'").withColumn("n", F.lit(2))).collect()} == {("p", 2), ("q", 1)}
    rows = spark.createDataFrame([("1", "p"), ("2", "p")], "id string, product string")
    assert [r.id for r in ext.delete_orphans(rows, spark.createDataFrame([("1", "p"), ("2", "q")], "id string, product string")).collect()] == ["1"]
    assert agg.empty_cell(spark, "p").first().dataset_count == 0
    assert fields.searchable(NEW_TYPE, {"region_code": "x"}) == ["cloud_cover"]
    at = spark.createDataFrame([(T,)], "t timestamp_ntz").select(times.add_default_zone(F.col("t"), "Australia/Darwin").alias("t")).first().t
    assert at == T - dt.timedelta(hours=9, minutes=30)
    names = spark.createDataFrame([("n", "f/x.yaml", "i"), (None, "f/x.yaml", "i"), ("", None, "i")], "l string, u string, i string")
    assert [r[0] for r in names.select(texts.dataset_label(F.col("l"), F.col("u"), F.col("i"))).collect()] == ["n", "x", "i"]
    doc = json.dumps({"platform": {"code": "SAT_5"}, "image": {"satellite_ref_point_start": {"x": 90, "y": 80}, "satellite_ref_point_end": {"y": 81}}})
    got = spark.createDataFrame([(doc,)], "doc string").select(*(v.alias(k.replace(":", "_")) for k, v in stac.eo1_properties(F.col("doc")).items())).first()
    assert (got.platform, got.landsat_wrs_path, got.landsat_wrs_row, got.odc_row_range) == ("sat-5", 90, None, "80/81")
    products = spark.createDataFrame([("p", "new"), ("q", "old"), ("r", "new")], "product string, metadata_type string")
    assert sorted(r["product"] for r in facts.products_with_metadata_type(products, "new").collect()) == ["p", "r"]
    assert facts.block_sample(spark.range(1000).withColumn("product", F.lit("p")), 50.0).count() <= 1000


def test_settings_and_addresses(spark):
    assert settings.of_session(spark) == settings.Settings()
    spark.conf.set("spark.eocatalog.page_size", "7")
    spark.conf.set("spark.eocatalog.change_overlap", "60")
    try:
        own = settings.of_session(spark)
        assert (own.page_size, own.change_overlap) == (7, dt.timedelta(minutes=1))
        spark.conf.set("spark.eocatalog.nothing", "1")
        with pytest.raises(ValueError, match="nothing"):
            settings.of_session(spark)
    finally:
        for name in ("page_size", "change_overlap", "nothing"):
            spark.conf.unset(f"spark.eocatalog.{name}")
    own = settings.of_lines("# comment\nexport EOCATALOG_GROUPING_TIMEZONE='UTC'\nOTHER=1\nEOCATALOG_DATA_LOCATIONS={\"b\": \"site\"}\n")
    assert (own.grouping_timezone, own.data_locations) == ("UTC", {"b": "site"})
    for bad in ("EOCATALOG_PAGE_SIZE=0", "EOCATALOG_DATA_LOCATIONS=[]", "EOCATALOG_X=1", "EOCATALOG_GROUPING_TIMEZONE=No/Where"):
        with pytest.raises((ValueError, KeyError)):
            settings.of_lines(bad)
    uris = ["s3://some-data/L2/x/doc.yaml", "s3://b/L2/x/doc.yaml", "file:///g/x.yaml", "rel/path.txt", None]
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    got = [tuple(r) for r in df.select(texts.external_url(F.col("u"), "r-1", {"b": "site"}), texts.external_url(F.col("u"), "r-1", {"b": "site"}, True)).collect()]
    assert [g[0] for g in got] == ["https://some-data.s3.r-1.amazonaws.com/L2/x/doc.yaml", "https://site/L2/x/doc.yaml", "file:///g/x.yaml", "rel/path.txt", None]
    assert got[1][1] == "https://site/?prefix=L2/x/" and got[2][1] == "file:///g/x.yaml"


def test_times_as_text_and_boxes(spark):
    now = dt.datetime(2024, 1, 31, 12)
    ago = {0: "just now", 59: "just now", 60: "1 minute ago", 7200: "2 hours ago", 86_400: "1 day ago", 40 * 86_400: "1 month ago", 800 * 86_400: "2 years ago", -7200: "in 2 hours"}
    df = spark.createDataFrame([(now - dt.timedelta(seconds=s), s) for s in ago] + [(None, None)], "t timestamp_ntz, s long")
    got = df.select(times.since(F.col("t"), F.lit(now).cast("timestamp_ntz")).alias("x"), "s").collect()
    assert {r.s: r.x for r in got} == ago | {None: None}
    durations = {0: "PT0S", 4: "PT4S", 93_784: "P1DT2H3M4S", 86_400: "P1D", -60: "-PT1M"}
    df = spark.createDataFrame([(s,) for s in durations], "s long")
    assert {r.s: r.x for r in df.select("s", times.iso_duration(F.col("s")).alias("x")).collect()} == durations
    boxes = spark.createDataFrame([("BOX(1 2,3.5 4e1)",), ("box",), (None,)], "b string")
    assert [r.x and tuple(r.x) for r in boxes.select(geometry.parse_box(F.col("b")).alias("x")).collect()] == [(1, 2, 3.5, 40), None, None]
    assert spark.range(1).select(times.month_name(F.make_date(F.lit(2024), F.lit(2), F.lit(1))).alias("x")).first().x == "February 2024"


def test_texts_of_odd_documents(spark):
    docs = spark.createDataFrame([("1", json.dumps(DOCS[1])), ("2", "no json"), ("3", None), ("4", "[1]"), ("5", "{}")], "id string, doc string")
    got = {r.id: r.text for r in formats.texts(docs, "u/{id}").collect()}
    assert got["1"].startswith("# url: u/1\n$schema:") and got["2"] is got["3"] is got["4"] is None and got["5"] == "# EO1 Dataset\n# url: u/5\n{}\n"


def test_filter_systems():
    from eocatalog.operators import search

    class Rows:
        columns: list = []

    for name in ("http://www.opengis.net/def/crs/OGC/1.3/CRS84", "EPSG:4326", "http://www.opengis.net/def/crs/EPSG/0/4326"):
        search.apply_filters(Rows(), search.Search(filter_crs=name))
    with pytest.raises(search.SearchError):
        search.apply_filters(Rows(), search.Search(filter_crs="EPSG:3577"))


def test_usual_documents_are_written_and_read_without_the_library(monkeypatch):
    import yaml

    doc = {"id": "7", "a:b": [[1.0, -2], [{"x": "2024-01-01", "y": []}, "it's"]], "none": None, "7": {"on": True, "e": 1e-10}, "said": "two words", "deep": {"list": ["#1", {"k": {}}]}}
    text = formats.as_yaml([doc, doc])

    class Plain(yaml.SafeDumper):
        def ignore_aliases(self, data):
            return True

    assert text == "".join("---\n" + yaml.dump(doc, Dumper=Plain, sort_keys=False) for _ in range(2))
    assert documents.parse(text.encode(), "x.yaml") == [doc, doc]
    for odd in ("a: >\n  b\n---\nyes: 1\n1: 2\n", "%YAML 1.1\n---\na: &x 1\nb: *x\n...\n---\nc: 2020-01-01\n", "a: b\n  c\n---\n---\nd: 'e\n  f'\n"):
        assert documents.parse(odd.encode(), "x.yaml") == [documents._plain(d) for d in yaml.safe_load_all(odd) if d is not None]
    documents.parse(text.encode(), "x.yaml")  # what is asked of the library only once

    def never(*_, **__):
        raise AssertionError("the library is slow")

    for name in ("dump", "load", "load_all"):
        monkeypatch.setattr(yaml, name, never)
    assert formats.as_yaml([doc]) == text[: len(text) // 2] and documents.parse(text.encode(), "x.yaml") == [doc, doc]


def test_large_files_are_read_document_by_document():
    import io

    source = io.BytesIO(b"---\na: 1\n" * 100_000)
    assert next(documents.parsed(source, "x.yaml")) == {"a": 1} and source.tell() < 100_000


def test_documents_shown_are_dealt_to_tasks_and_equal_the_library(spark, tmp_path):
    from eocatalog.plans import registry

    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(k, at, k, "view", 1.0, "{}") for k in range(64)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = registry.queries()["documents_as_text"](spark, str(tmp_path))
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    shown = "\n".join(x for x in out.where("id = '7'").first().text.split("\n") if not x.startswith("#"))
    assert yaml.safe_load(shown) == {"id": "d7", "size_bytes": 7, "extent": {"a": 1e-10}, "lineage": {"machine": "m", "source_datasets": {}}, "zoo": [1, 2.5]}
