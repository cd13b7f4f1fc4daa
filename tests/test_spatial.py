"""Exact spatial predicates, quad keys, and searches that use both."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from eocatalog.functions import shapes, spatial, texts
from eocatalog.operators import cql2, search

OPS = ["intersects", "disjoint", "within", "contains", "equals", "touches", "overlaps", "crosses"]


def ring(x, y, w, clockwise=False):
    r = [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]
    return r[::-1] if clockwise else r


def polygon(*rings):
    return {"type": "Polygon", "coordinates": list(rings)}


def told(spark, rows, shape):
    """For each row the names of the predicates that hold."""
    df = spark.createDataFrame([(k, json.dumps(g) if g else None) for k, g in enumerate(rows)], "id int, g string").withColumn("rings", spatial.rings(F.col("g"))).cache()
    got = df.select("id", *(spatial.predicate(f"s_{op}", shape, F.col("rings")).alias(op) for op in OPS)).orderBy("id").collect()
    return [None if r.intersects is None else {op for op in OPS if r[op]} for r in got]


def test_areas(spark):
    frame = polygon(ring(0, 0, 8), ring(2, 2, 4))
    two = {"type": "MultiPolygon", "coordinates": [[ring(0, 0, 1, True)], [ring(5, 5, 1)]]}
    rows = [polygon(ring(0, 0, 4)), polygon(ring(1, 1, 1, True)), polygon(ring(4, 0, 2)), polygon(ring(4, 4, 1)), polygon(ring(3, 3, 4)), polygon(ring(9, 9, 1)), polygon(ring(-1, -1, 9)), frame, two, None]
    both = {"intersects", "overlaps"}
    assert told(spark, rows, polygon(ring(0, 0, 4, True))) == [
        {"intersects", "within", "contains", "equals"}, {"intersects", "within"}, {"intersects", "touches"}, {"intersects", "touches"}, both, {"disjoint"}, {"intersects", "contains"}, both, both, None,
    ]
    # in a frame's hole, filling it, beside its inner edge, and around it
    rows = [polygon(ring(3, 3, 1)), polygon(ring(2, 2, 4)), polygon(ring(2, 2, 1)), polygon(ring(0, 0, 8)), polygon(ring(1, 1, 2)), frame]
    assert told(spark, rows, frame) == [{"disjoint"}, {"intersects", "touches"}, {"intersects", "touches"}, {"intersects", "contains"}, both, {"intersects", "within", "contains", "equals"}]


def test_lines_and_points(spark):
    rows = [polygon(ring(0, 0, 4)), polygon(ring(0, 0, 8), ring(2, 2, 4)), polygon(ring(20, 0, 1))]
    line = lambda *p: {"type": "LineString", "coordinates": [list(x) for x in p]}
    assert told(spark, rows, line((1, 1), (3, 3))) == [{"intersects", "contains"}, {"intersects", "crosses"}, {"disjoint"}]
    assert told(spark, rows, line((-1, 1), (9, 1))) == [{"intersects", "crosses"}, {"intersects", "crosses"}, {"disjoint"}]
    assert told(spark, rows, line((4, -1), (4, 5))) == [{"intersects", "touches"}, {"intersects", "crosses"}, {"disjoint"}]
    assert told(spark, rows, {"type": "Point", "coordinates": [3, 3]}) == [{"intersects", "contains"}, {"disjoint"}, {"disjoint"}]
    assert told(spark, rows, {"type": "Point", "coordinates": [0, 2]}) == [{"intersects", "touches"}, {"intersects", "touches"}, {"disjoint"}]
    assert told(spark, rows, {"type": "MultiPoint", "coordinates": [[1, 1], [9, 9]]})[0] == {"intersects", "crosses"}
    collection = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [20, 0]}, line((1, 1), (3, 3))]}
    df = spark.createDataFrame([(json.dumps(g),) for g in rows], "g string")
    assert [r[0] for r in df.select(spatial.predicate("s_intersects", collection, spatial.rings(F.col("g")))).collect()] == [True, True, True]
    with pytest.raises(ValueError):
        spatial.predicate("s_within", collection, F.col("g"))


def plainly_inside(x, y, rings):
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_stars_against_samples(spark):
    """Areas that meet, by points of a fine grid that lies on no vertex: what the grid shows, the predicates know."""
    import math

    rng = random.Random(2)

    def star(cx, cy):
        n = rng.randint(5, 9)
        points = [[round(cx + (s := rng.uniform(0.5, 3)) * math.cos(2 * math.pi * k / n), 3), round(cy + s * math.sin(2 * math.pi * k / n), 3)] for k in range(n)]
        return polygon([*points, points[0]])

    shape = star(0, 0)
    rows = [star(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(40)]
    grid = [(x / 9 + 0.0123, y / 9 + 0.0077) for x in range(-70, 70) for y in range(-70, 70)]
    inside = [plainly_inside(x, y, shape["coordinates"]) for x, y in grid]
    for row, names in zip(rows, told(spark, rows, shape), strict=True):
        own = [plainly_inside(x, y, row["coordinates"]) for x, y in grid]
        if any(a and b for a, b in zip(own, inside, strict=True)):
            assert "intersects" in names and "touches" not in names
        if any(a and not b for a, b in zip(own, inside, strict=True)):
            assert not names & {"within", "equals"}
        if any(b and not a for a, b in zip(own, inside, strict=True)):
            assert not names & {"contains", "equals"}
        assert len(names & {"disjoint", "touches", "within", "contains", "overlaps"}) == 1


def test_quad_keys_lose_nothing(spark):
    rng = random.Random(7)
    boxes = [(k, x := rng.uniform(-185, 180), y := rng.uniform(-91, 90), x + rng.choice([0, 0.001, 1, 30]), y + rng.choice([0, 0.001, 1, 30])) for k in range(600)] + [(900, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "id int, xmin double, ymin double, xmax double, ymax double")
    df = df.withColumn("cell", spatial.quad_key(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))))
    rows = {r.id: r.cell for r in df.collect()}
    assert rows[900] is None and all(v is not None for k, v in rows.items() if k != 900)
    df = df.cache()
    for _ in range(8):
        x, y = rng.uniform(-180, 170), rng.uniform(-90, 80)
        some = (x, y, x + rng.choice([0.0, 0.01, 5, 100]), y + rng.choice([0.0, 0.01, 5]))
        plain = {r.id for r in df.where(search.bbox_filter(*some)).collect()}
        pruned = {r.id for r in df.where(spatial.near(F.col("cell"), *some)).collect()}
        assert plain <= pruned and len(spatial.covering(*some)) <= 4
        if some[2] - some[0] < 1:
            assert len(pruned) < 400


def test_searches_use_areas(spark):
    rows = [("a", polygon([[0, 0], [4, 0], [0, 4], [0, 0]])), ("b", polygon(ring(0, 0, 4)))]
    df = spark.createDataFrame([(i, json.dumps(g)) for i, g in rows], "id string, g string").withColumn("rings", spatial.rings(F.col("g")))
    df = df.select("id", "rings", spatial.box(F.col("rings")).alias("b")).select("id", "rings", "b.*")
    ids = lambda **x: {r.id for r in search.apply_filters(df, search.Search(**x)).collect()}
    corner = polygon(ring(3, 3, 1))  # in both boxes, but beyond the triangle's long side
    assert ids(intersects=corner) == {"b"}
    assert ids(filter="S_CONTAINS(geometry, POINT(3 3))") == {"b"} == ids(filter="S_WITHIN(POINT(3 3), geometry)")
    assert ids(filter="S_DISJOINT(geometry, POLYGON((3 3, 4 3, 4 4, 3 4, 3 3)))") == {"a"}
    assert ids(bbox=(3, 3, 4, 4)) == {"a", "b"}
    with pytest.raises(cql2.FilterError):
        cql2.compile_filter("S_WITHIN(geometry, GEOMETRYCOLLECTION(POINT(1 1)))", {}, tuple(F.lit(0.0) for _ in range(4)), exact=lambda op, s: spatial.predicate(op, s, F.col("rings")))


def test_labels_and_prefixes(spark):
    labels = {
        "/tmp/some/ls7_wofs_1234.nc": "ls7_wofs_1234.nc",
        "file:///g/data/rs0/LS7_ETM_NBAR/10_-24/LS7_3577_10_-24_1999_v1.nc#part=0": "LS7_3577_10_-24_1999_v1.nc#part=0",
        "file:///tmp/ls7_nbar_20120403_c1/ga-metadata.yaml": "ls7_nbar_20120403_c1",
        "s3://bucket/mosaic/2017/N05E040/N05E040_2017.yaml": "N05E040_2017",
        "file:///g/data/S2A_T53HQA_N02.06/ARD-METADATA.yaml": "S2A_T53HQA_N02.06",
        "https://host/cogs/2020/S2B_36PTU_0_L2A/": "S2B_36PTU_0_L2A",
        "x/scene.odc-metadata.yaml": "scene.odc-metadata",
        "ga-metadata.yaml": None,
    }
    df = spark.createDataFrame([(u,) for u in labels], "u string")
    assert {r.u: r.l for r in df.select("u", texts.file_label(F.col("u")).alias("l")).collect()} == labels
    ends = [("file:///a/thing-1.txt",) * 2, ("file:///a/1.txt", "file:///a/3.txt"), ("file:///a/thing-1.txt", "file:///a/thing-3.txt"), ("http://h/things/",) * 2, ("http://h/others/", "http://h/things/")]
    df = spark.createDataFrame(ends, "a string, b string")
    assert [r[0] for r in df.select(texts.shared_prefix(F.col("a"), F.col("b"))).collect()] == ["file:///a/thing-1.txt", "file:///a/", "file:///a/", "http://h/things/", "http://h/"]


@pytest.mark.parametrize(
    ("shape", "valid"),
    [
        (polygon(ring(0, 0, 4), ring(1, 1, 1)), True),
        (polygon(ring(0, 0, 4), ring(0, 0, 1)), False),  # shares edges with the shell
        (polygon(ring(0, 0, 4), ring(6, 6, 1)), False),  # a hole outside
        (polygon(ring(0, 0, 4), [[0, 2], [1, 1], [1, 3], [0, 2]]), True),  # a hole that touches at a point
        (polygon(ring(0, 0, 8), ring(1, 1, 3), ring(2, 2, 3)), False),  # holes that overlap
        (polygon(ring(0, 0, 8), ring(1, 1, 4), ring(2, 2, 1)), False),  # a hole in a hole
        (polygon([[0, 0], [4, 0], [4, 4], [2, 0], [0, 4], [0, 0]]), False),  # a vertex on another edge
        (polygon([[0, 0], [4, 0], [2, 0], [2, 4], [0, 0]]), False),  # back along its own edge
        (polygon([[0, 0], [4, 4], [4, 0], [0, 4], [0, 0]]), False),
        ({"type": "MultiPolygon", "coordinates": [[ring(0, 0, 4), ring(1, 1, 2)], [ring(1, 1, 1)]]}, False),
        ({"type": "MultiPolygon", "coordinates": [[ring(0, 0, 8), ring(1, 1, 4)], [ring(2, 2, 1)]]}, True),
        ({"type": "MultiPolygon", "coordinates": [[ring(0, 0, 4)], [ring(4, 4, 1)]]}, True),
        ({"type": "MultiPolygon", "coordinates": [[ring(0, 0, 4)], [ring(3, 3, 4)]]}, False),
        ({"type": "Point", "coordinates": [1, 2]}, True),
    ],
)
def test_validity(shape, valid):
    assert shapes.is_valid(shape) is valid


def test_url_filters(spark):
    rows = [(1, 5, "a", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 5)), (2, 9, "b", dt.datetime(2020, 1, 4), dt.datetime(2020, 1, 9)), (3, None, "b", None, None)]
    df = spark.createDataFrame(rows, "id int, orbit int, kind string, b timestamp_ntz, e timestamp_ntz")
    columns = {"orbit": F.col("orbit"), "kind": F.col("kind"), "time": F.struct(F.col("b").alias("begin"), F.col("e").alias("end"))}
    kinds = {"orbit": "integer", "kind": "string", "time": "datetime-range"}
    ids = lambda **x: {r.id for r in df.where(search.url_filters({k.replace("_", "-"): v for k, v in x.items()}, columns, kinds)).collect()}
    assert search.field_groups({"lat-begin": "1", "lat-end": "2", "orbit": 3, "x": ""}) == {"lat": {"begin": "1", "end": "2"}, "orbit": {"val": 3}}
    assert ids() == {1, 2, 3} and ids(orbit="5") == {1} and ids(orbit_begin="9", orbit_end="6") == {2} and ids(orbit_end="8") == {1}
    assert ids(kind="b") == {2, 3} and ids(time="2020-01-05T00:00:00Z") == {1, 2} and ids(time_begin="2020-01-06") == {2}
    for bad in ({"none": "1"}, {"orbit": "x"}, {"orbit-from": "1"}, {"a-b-c": "1"}):
        with pytest.raises(search.SearchError):
            search.url_filters(bad, columns, kinds)
