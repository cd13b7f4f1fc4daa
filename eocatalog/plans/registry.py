"""Every catalogue query by name, with the SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eocatalog.functions import crs, regions, spatial, texts, times
from eocatalog.operators import aggregates as agg
from eocatalog.operators import catalogue, cells, cql2, extents, facts, geometry, items, job, lookups, refresh, search, stac, systems
from eocatalog.plans import mapping as m
from eocatalog.sources import formats, tables

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

JAN = (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20))
_DARWIN = "interval '9 hours 30 minutes'"
_EVENTS = "(SELECT event_id::VARCHAR AS id, event_type AS product, ts AS center_time, ts AS added, user_id::VARCHAR AS region_code, value AS size_bytes, props AS doc FROM events)"
_BOXES = "(SELECT vec_id AS id, label AS srid, least(embedding[1], embedding[3])::DOUBLE AS xmin, least(embedding[2], embedding[4])::DOUBLE AS ymin, greatest(embedding[1], embedding[3])::DOUBLE AS xmax, greatest(embedding[2], embedding[4])::DOUBLE AS ymax FROM embeddings)"


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        _queries[name] = fn
        if oracle:
            _oracles[name] = oracle
        return fn

    return add


def queries() -> dict[str, Query]:
    return _queries


def oracle_sql() -> dict[str, str]:
    return _oracles


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all periods with each month's busiest local day."""
    datasets = m.events(spark, sf_dir)
    days = agg.day_histogram(datasets).groupBy("product", F.to_date(F.trunc("day", "month")).alias("start_day")).agg(F.max_by("day", F.struct("n", "day")).alias("busiest_day"))
    return agg.period_rollup(datasets).join(days, ["product", "start_day"], "left")


# --- aggregates


@query("day_histogram_tz", f"SELECT product, (center_time + {_DARWIN})::DATE AS day, count(*)::BIGINT AS n FROM {_EVENTS} GROUP BY 1, 2")
def _(spark, d):
    return agg.day_histogram(m.events(spark, d))


@query(
    "timeline_zero_filled",
    f"""WITH days AS (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS day),
        e AS (SELECT product, (center_time + {_DARWIN})::DATE AS day FROM {_EVENTS})
        SELECT p.product, days.day, count(e.day)::BIGINT AS n FROM (SELECT DISTINCT product FROM e) p, days
        LEFT JOIN e ON e.product = p.product AND e.day = days.day GROUP BY 1, 2""",
)
def _(spark, d):
    return agg.timeline(m.events(spark, d), dt.date(2023, 12, 25), dt.date(2024, 2, 5))


@query(
    "timeline_coarsened",
    """WITH b AS (SELECT o_orderpriority AS product, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2),
       s AS (SELECT product, count(*) > 366 AS wide FROM b GROUP BY 1)
       SELECT product, CASE WHEN wide THEN 'month' ELSE 'day' END AS unit,
              CASE WHEN wide THEN date_trunc('month', day)::DATE ELSE day END AS day, sum(n)::BIGINT AS n
       FROM b JOIN s USING (product) GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return agg.coarsen(agg.day_histogram(m.orders(spark, d), "UTC"))


_ROLLUP = """SELECT o_orderpriority AS product,
  CASE grouping(o_orderpriority, year(o_orderdate), month(o_orderdate)) WHEN 3 THEN 'all' WHEN 1 THEN 'year' ELSE 'month' END AS period_type,
  make_date(coalesce(year(o_orderdate), 1900)::INTEGER, coalesce(month(o_orderdate), 1)::INTEGER, 1) AS start_day,
  count(*)::BIGINT AS dataset_count, round(sum(o_totalprice::DECIMAL(18, 2)), 2)::DOUBLE AS size_bytes
  FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, year(o_orderdate)), (o_orderpriority, year(o_orderdate), month(o_orderdate)))"""


def _orders_rollup(spark, d):
    size = F.sum(F.col("size_bytes").cast("decimal(18,2)")).cast("double")
    return agg.period_rollup(m.orders(spark, d), None, {"size_bytes": size})


query("period_rollup", _ROLLUP)(_orders_rollup)


@query(
    "period_summary",
    """SELECT CASE WHEN srid % 2 = 0 THEN 'even' ELSE 'odd' END AS product, count(*)::BIGINT AS dataset_count,
       list_sort(list(DISTINCT srid)) AS srids, sum(id)::BIGINT AS size_bytes, max(id) AS newest_creation_time
       FROM """ + _BOXES + " WHERE srid IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    f = m.footprints(spark, d).where("srid IS NOT NULL")
    return agg.period_summary(f.select(F.when(F.col("srid") % 2 == 0, "even").otherwise("odd").alias("product"), "srid", F.col("id").alias("size_bytes"), F.col("id").alias("creation_time")))


@query("region_histogram", f"SELECT product, CASE WHEN region_code LIKE '%7' THEN NULL ELSE region_code END AS region_code, count(*)::BIGINT AS n FROM {_EVENTS} GROUP BY 1, 2")
def _(spark, d):
    return agg.region_histogram(m.events(spark, d).withColumn("region_code", F.when(~F.col("region_code").like("%7"), F.col("region_code"))))


@query("product_extent", f"SELECT product, min(center_time) AS time_earliest, max(center_time) AS time_latest, count(*)::BIGINT AS dataset_count FROM {_EVENTS} GROUP BY 1")
def _(spark, d):
    return agg.product_extent(m.events(spark, d))


@query("all_period_counts", f"SELECT product, year(nullif(start_day, DATE '1900-01-01')) AS year, CASE period_type WHEN 'month' THEN month(start_day) END AS month, dataset_count FROM ({_ROLLUP})")
def _(spark, d):
    return agg.period_counts(_orders_rollup(spark, d))


@query("total_dataset_count", f"SELECT sum(dataset_count)::BIGINT AS n FROM ({_ROLLUP}) WHERE period_type = 'all'")
def _(spark, d):
    return agg.total_count(_orders_rollup(spark, d))


@query("common_period", "SELECT o_orderpriority AS product, CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN min(year(o_orderdate)) END AS year, CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) AND min(month(o_orderdate)) = max(month(o_orderdate)) THEN min(month(o_orderdate)) END AS month, NULL::BIGINT AS day FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1")
def _(spark, d):
    days = m.orders(spark, d).where("year(center_time) = 1996").select("product", F.to_date("center_time").alias("day"))
    out = agg.common_period(days)
    return out.select("product", *[F.col(c).cast("long").alias(c) for c in ("year", "month", "day")])


@query("bar_heights", f"SELECT product, day, n, round(100.0 * n / max(n) OVER (PARTITION BY product), 6)::DOUBLE AS height FROM (SELECT product, center_time::DATE AS day, count(*)::BIGINT AS n FROM {_EVENTS} GROUP BY 1, 2)")
def _(spark, d):
    out = agg.bar_heights(agg.day_histogram(m.events(spark, d), "UTC"))
    return out.withColumn("height", F.round("height", 6).cast("double"))


_REGION_COUNTS = f"(SELECT product, region_code, count(*)::BIGINT AS n FROM {_EVENTS} GROUP BY 1, 2)"


@query("colour_bins", f"SELECT product, region_code, n, (CASE WHEN hi = lo THEN 0 ELSE least(floor((n - lo) * 5 / (hi - lo)::DOUBLE), 4) END)::INTEGER AS bin FROM (SELECT *, min(n) OVER (PARTITION BY product) AS lo, max(n) OVER (PARTITION BY product) AS hi FROM {_REGION_COUNTS})")
def _(spark, d):
    return agg.colour_bins(agg.region_histogram(m.events(spark, d)))


@query("region_min_max", f"SELECT product, min(n) AS min_n, max(n) AS max_n FROM {_REGION_COUNTS} GROUP BY 1")
def _(spark, d):
    return agg.min_max(agg.region_histogram(m.events(spark, d)))


@query("crs_set", "SELECT r_name AS product, list_sort(list(DISTINCT 'EPSG:' || (32600 + n_nationkey)::VARCHAR)) AS crs_list FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, d):
    nation, region = m.read(spark, d, "nation"), m.read(spark, d, "region")
    datasets = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("product"), F.col("n_nationkey").alias("srid"))
    names = nation.select(F.col("n_nationkey").alias("srid"), F.lit("EPSG").alias("auth_name"), (F.col("n_nationkey") + 32600).alias("auth_srid"))
    return agg.crs_names(datasets, names)


# --- searches


_CONDITION = "center_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' AND product IN ('click', 'purchase')"
_PRODUCTS = ["click", "purchase"]


@query("search_default_page", f"SELECT id, product, center_time FROM {_EVENTS} WHERE {_CONDITION} ORDER BY center_time NULLS LAST, id LIMIT 21 OFFSET 40")
def _(spark, d):
    return search.search(m.events(spark, d), search.Search(time=JAN, products=_PRODUCTS, limit=20, offset=40)).select("id", "product", "center_time")


@query("search_after_key", f"SELECT id, center_time FROM {_EVENTS} WHERE (center_time > TIMESTAMP '2024-01-15' OR (center_time = TIMESTAMP '2024-01-15' AND id > '500')) ORDER BY center_time, id LIMIT 21")
def _(spark, d):
    rest = search.after(m.events(spark, d), dt.datetime(2024, 1, 15), "500")
    return search.search(rest, search.Search(limit=20)).select("id", "center_time")


@query("search_ids", f"SELECT id, product FROM {_EVENTS} WHERE id IN ('5', '77', '901', 'none')")
def _(spark, d):
    return search.search(m.events(spark, d), search.Search(ids=["5", "77", "901", "none"])).select("id", "product")


@query("search_ids_empty", f"SELECT id, product FROM {_EVENTS} WHERE false")
def _(spark, d):
    return search.search(m.events(spark, d), search.Search(ids=[])).select("id", "product")


@query("search_bbox", f"SELECT id, xmin, xmax FROM {_BOXES} WHERE xmin <= 0.05 AND xmax >= -0.05 AND ymin <= 0.02 AND ymax >= -0.1")
def _(spark, d):
    return search.apply_filters(m.footprints(spark, d), search.Search(bbox=(-0.05, -0.1, 0.05, 0.02))).select("id", "xmin", "xmax")


@query("search_intersects", f"SELECT id FROM {_BOXES} WHERE xmin <= 0.3 AND xmax >= 0.1 AND ymin <= 0.4 AND ymax >= 0.0")
def _(spark, d):
    shape = {"type": "Polygon", "coordinates": [[[0.1, 0.0], [0.3, 0.1], [0.2, 0.4], [0.1, 0.0]]]}
    return search.apply_filters(m.footprints(spark, d), search.Search(intersects=shape)).select("id")


@query("search_count", f"SELECT count(*)::BIGINT AS n FROM {_EVENTS} WHERE {_CONDITION}")
def _(spark, d):
    return search.apply_filters(m.events(spark, d), search.Search(time=JAN, products=_PRODUCTS)).agg(F.count(F.lit(1)).alias("n"))


@query("search_sortby_desc", f"SELECT id, size_bytes FROM {_EVENTS} ORDER BY size_bytes DESC NULLS FIRST, id LIMIT 51")
def _(spark, d):
    return search.search(m.events(spark, d), search.Search(sortby=search.parse_sortby("-size_bytes"), limit=50)).select("id", "size_bytes")


@query("search_recent", f"SELECT id, added FROM {_EVENTS} ORDER BY added DESC NULLS FIRST, id LIMIT 21")
def _(spark, d):
    return search.search(m.events(spark, d), search.Search(order="recent")).select("id", "added")


_REGION = "region_code = '3' AND center_time > TIMESTAMP '2024-01-10' AND center_time < TIMESTAMP '2024-01-20'"


@query("search_region", f"SELECT id, center_time FROM {_EVENTS} WHERE product = 'click' AND {_REGION} ORDER BY center_time DESC NULLS LAST, id LIMIT 50")
def _(spark, d):
    return search.by_region(m.events(spark, d), "click", "3", *JAN).select("id", "center_time")


@query("products_for_region", f"SELECT DISTINCT product FROM {_EVENTS} WHERE {_REGION} ORDER BY product LIMIT 50")
def _(spark, d):
    return search.products_for_region(m.events(spark, d), "3", *JAN)


@query("range_completion", f"SELECT id FROM {_EVENTS} WHERE size_bytes >= 10 AND size_bytes <= 20 AND center_time >= (SELECT min(ts) FROM events) AND center_time <= TIMESTAMP '2024-01-08'")
def _(spark, d):
    e = m.events(spark, d)
    first, last = e.agg(F.min("center_time"), F.max("center_time")).first()
    begin, end = times.shift_open_range(None, dt.datetime(2024, 1, 8), first, last)
    return e.where(search.field_predicate(F.col("size_bytes"), 20, 10) & search.time_filter(begin, end)).select("id")


@query("union_limited", f"SELECT id, product FROM (SELECT id, product, row_number() OVER (PARTITION BY product ORDER BY center_time, id) AS k FROM {_EVENTS}) WHERE k <= 7")
def _(spark, d):
    return facts.first_rows(m.events(spark, d), "product", [F.col("center_time").asc(), F.col("id").asc()], 7).select("id", "product")


# --- CQL2


_CQL_SQL = f"SELECT id FROM {_EVENTS} WHERE (product = 'click' OR product LIKE 'pur%') AND size_bytes BETWEEN 5 AND 60.5 AND NOT region_code IN ('1', '2') AND region_code::DOUBLE * 2 > 9 AND center_time < TIMESTAMP '2024-01-25'"
CQL_TEXT = "(collection = 'click' OR properties.product LIKE 'pur%') AND size_bytes BETWEEN 5 AND 60.5 AND region_code NOT IN ('1','2') AND region_code * 2 > 9 AND T_BEFORE(datetime, TIMESTAMP('2024-01-25T00:00:00Z'))"
CQL_JSON = {
    "op": "and",
    "args": [
        {"op": "or", "args": [{"op": "=", "args": [{"property": "collection"}, "click"]}, {"op": "like", "args": [{"property": "product"}, "pur%"]}]},
        {"op": "between", "args": [{"property": "size_bytes"}, 5, 60.5]},
        {"op": "not", "args": [{"op": "in", "args": [{"property": "region_code"}, ["1", "2"]]}]},
        {"op": ">", "args": [{"op": "*", "args": [{"property": "region_code"}, 2]}, 9]},
        {"op": "t_before", "args": [{"property": "datetime"}, {"timestamp": "2024-01-25T00:00:00Z"}]},
    ],
}


@query("cql2_text", _CQL_SQL)
def _(spark, d):
    return search.apply_filters(m.events(spark, d), search.Search(filter=CQL_TEXT)).select("id")


@query("cql2_json", _CQL_SQL)
def _(spark, d):
    return search.apply_filters(m.events(spark, d), search.Search(filter=CQL_JSON)).select("id")


@query("cql2_undefined", f"SELECT id FROM {_EVENTS} WHERE product = 'click'")
def _(spark, d):
    return search.apply_filters(m.events(spark, d), search.Search(filter="collection = 'click' AND (no:such > 5 OR no:such IS NULL)")).select("id")


@query("cql2_spatial", f"SELECT id FROM {_BOXES} WHERE srid > 2 AND xmin <= 0.2 AND xmax >= -0.1 AND ymin <= 0.1 AND ymax >= -0.1")
def _(spark, d):
    return search.apply_filters(m.footprints(spark, d), search.Search(filter="srid > 2 AND S_INTERSECTS(geometry, POLYGON((-0.1 -0.1, 0.2 -0.1, 0.2 0.1, -0.1 0.1, -0.1 -0.1)))")).select("id")


#: Triangles on a grid, so that many touch, share edges or are equal to others.
_GRID = ", ".join(f"floor(embedding[{2 * k + 1}] * 32) / 4 AS x{k}, floor(embedding[{2 * k + 2}] * 32) / 4 AS y{k}" for k in range(3))
_TRIANGLES = f"(SELECT * FROM (SELECT vec_id AS id, {_GRID} FROM embeddings) WHERE (x1 - x0) * (y2 - y0) <> (x2 - x0) * (y1 - y0))"
_SHAPE = ((-1.0, -1.0), (1.5, -0.5), (0.0, 1.25))
_SHAPE_WKT = f"POLYGON(({', '.join(f'{x} {y}' for x, y in (*_SHAPE, _SHAPE[0]))}))"


def _triangle_points(spark, d) -> DataFrame:
    v = lambda i: F.floor(F.get("embedding", F.lit(i)).cast("double") * 32) / 4
    names = [f"{a}{k}" for k in range(3) for a in "xy"]
    t = m.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *(v(i).alias(n) for i, n in enumerate(names)))
    return t.where((F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) != (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def _triangles(spark, d) -> DataFrame:
    t = _triangle_points(spark, d)
    ring = F.array(*(F.struct(F.col(f"x{k % 3}").alias("x"), F.col(f"y{k % 3}").alias("y")) for k in range(4)))
    t = t.withColumn("rings", F.array(spatial.oriented(ring, F.lit(False)))).withColumn("_box", spatial.box(F.col("rings")))
    bounds = [F.col(f"_box.{x}") for x in ("xmin", "ymin", "xmax", "ymax")]
    return tables.stored(t.select("id", "rings", *bounds, spatial.quad_key(*bounds).alias("cell")), "triangles")


def _separation_sql(columns: str, where: str = "true") -> str:
    """Triangles beside the shape by separating axes: meets, inner (their insides meet), within, contains."""
    own, other = [(f"x{k}", f"y{k}") for k in range(3)], [(f"{x}::DOUBLE", f"{y}::DOUBLE") for x, y in _SHAPE]
    sides = [(a, b) for t in (own, other) for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
    along = lambda t, nx, ny: [f"({nx}) * {x} + ({ny}) * {y}" for x, y in t]
    axes = [(f"{b[1]} - {a[1]}", f"{a[0]} - {b[0]}") for a, b in sides]
    reach = [(f"greatest({', '.join(along(own, *n))})", f"least({', '.join(along(own, *n))})", f"greatest({', '.join(along(other, *n))})", f"least({', '.join(along(other, *n))})") for n in axes]
    turn = lambda a, b, p: f"({b[0]} - {a[0]}) * ({p[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({p[0]} - {a[0]})"
    inside = lambda t, points, sign: " AND ".join(f"({sign}) * ({turn(a, b, p)}) >= 0" for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])) for p in points)
    meets, inner = (" AND ".join(f"{h} {op} {l2} AND {h2} {op} {l}" for h, l, h2, l2 in reach) for op in (">=", ">"))
    told = f"SELECT id, ({meets}) AS meets, ({inner}) AS inn, ({inside(other, own, '1')}) AS within, ({inside(own, other, f'sign({turn(*own)})')}) AS contains FROM {_TRIANGLES}"
    return f"SELECT {columns} FROM ({told}) WHERE {where}"


@query(
    "cql2_exact_predicates",
    _separation_sql("id, meets AS s_intersects, NOT meets AS s_disjoint, within AS s_within, contains AS s_contains, within AND contains AS s_equals, meets AND NOT inn AS s_touches, inn AND NOT within AND NOT contains AS s_overlaps, false AS s_crosses, within AS contained_in_shape, contains AS shape_within"),
)
def _(spark, d):
    """Every spatial predicate between rows' triangles and one more, and two of them with the shape first."""
    t = _triangles(spark, d)
    bounds = tuple(F.col(n) for n in ("xmin", "ymin", "xmax", "ymax"))
    told = lambda text: cql2.compile_filter(text, {}, bounds, exact=search.exact_filter(t))
    ops = ("intersects", "disjoint", "within", "contains", "equals", "touches", "overlaps", "crosses")
    return t.select("id", *(told(f"S_{op.upper()}(geometry, {_SHAPE_WKT})").alias(f"s_{op}") for op in ops), told(f"S_CONTAINS({_SHAPE_WKT}, geometry)").alias("contained_in_shape"), told(f"S_WITHIN({_SHAPE_WKT}, geometry)").alias("shape_within"))


@query("search_exact", _separation_sql("id", "meets AND NOT within"))
def _(spark, d):
    """A search by a shape and a filter: quad keys, then boxes, then the areas themselves."""
    shape = {"type": "Polygon", "coordinates": [[*_SHAPE, _SHAPE[0]]]}
    return search.apply_filters(_triangles(spark, d), search.Search(intersects=shape, filter=f"NOT S_WITHIN(geometry, {_SHAPE_WKT})")).select("id")


# --- facts of products


@query(
    "arrivals",
    f"""WITH r AS (SELECT added::DATE AS day, product, id FROM {_EVENTS} WHERE added::DATE > (SELECT max(added)::DATE - 14 FROM {_EVENTS}))
        SELECT day, product, count(*)::BIGINT AS n, list_sort(list(id))[1:3] AS sample_ids FROM r GROUP BY 1, 2""",
)
def _(spark, d):
    return facts.arrivals(m.events(spark, d))


@query(
    "quality_stats",
    """SELECT source AS product, count(*)::BIGINT AS n, (count(*) FILTER (text IS NULL))::BIGINT AS missing_footprint, sum(strlen(text))::BIGINT AS footprint_size,
       round(stddev_samp(strlen(text)), 4) AS footprint_stddev, (count(*) FILTER (quality IS NULL))::BIGINT AS missing_srid, count(n_chars)::BIGINT AS has_file_size, count(lang)::BIGINT AS has_region
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def _(spark, d):
    docs = m.read(spark, d, "documents").join(m.read(spark, d, "labels"), "doc_id", "left")
    out = facts.quality_stats(docs.select(F.col("source").alias("product"), F.col("text").alias("footprint"), F.col("quality").alias("srid"), F.col("n_chars").alias("size_bytes"), F.col("lang").alias("region_code")))
    return out.withColumn("footprint_stddev", F.round("footprint_stddev", 4))


_FIXED = ("lang", "toxic", "kind")


@query(
    "fixed_metadata",
    """WITH r AS (SELECT source AS product, doc_id AS id, lang, toxic::VARCHAR AS toxic, left(source, 3) AS kind FROM documents LEFT JOIN labels USING (doc_id)),
       f AS (SELECT product, min_by(lang, id) AS l, arg_min_null(toxic, id) AS t, min_by(kind, id) AS k FROM r GROUP BY 1),
       j AS (SELECT r.*, l, t, k FROM r JOIN f USING (product))
       SELECT product, 'lang' AS field, any_value(l) AS value, coalesce(bool_and(lang = l), false) AS is_fixed FROM j GROUP BY 1
       UNION ALL SELECT product, 'toxic', any_value(t), coalesce(bool_and(CASE WHEN t IS NULL THEN toxic IS NULL ELSE toxic = t END), false) FROM j GROUP BY 1
       UNION ALL SELECT product, 'kind', any_value(k), coalesce(bool_and(kind = k), false) FROM j GROUP BY 1""",
)
def _(spark, d):
    docs = m.read(spark, d, "documents").join(m.read(spark, d, "labels"), "doc_id", "left")
    rows = docs.select(F.col("source").alias("product"), F.col("doc_id").alias("id"), "lang", "toxic", F.left("source", F.lit(3)).alias("kind"))
    return facts.fixed_fields(rows, list(_FIXED))


@query(
    "linked_products",
    """SELECT p_brand AS product, coalesce(string_agg(DISTINCT n_name, ',' ORDER BY n_name), '') AS linked
       FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
)
def _(spark, d):
    items = m.read(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("dataset_ref"), F.concat(F.lit("s"), "l_suppkey").alias("source_ref"))
    parts = m.read(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("product"))
    suppliers = m.read(spark, d, "supplier").join(m.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("n_name").alias("product"))
    linked = facts.linked_products(items, parts.unionByName(suppliers))
    return parts.select("product").distinct().join(linked, "product").select("product", F.array_join("linked", ",").alias("linked"))


@query("months_needing_update", f"SELECT product, date_trunc('month', center_time + {_DARWIN})::DATE AS month, count(*)::BIGINT AS n FROM {_EVENTS} WHERE added > TIMESTAMP '2024-01-20' GROUP BY 1, 2")
def _(spark, d):
    return facts.months_needing_update(m.events(spark, d), dt.datetime(2024, 1, 20), agg.GROUPING_TZ, "added")


@query(
    "years_needing_update",
    """WITH o AS (SELECT o_custkey AS key, year(o_orderdate)::BIGINT AS year, o_totalprice AS p, o_orderstatus AS s FROM orders),
       years AS (SELECT key, year, max(p) AS generated FROM o WHERE s = 'F' GROUP BY 1, 2), months AS (SELECT key, year, p AS generated FROM o WHERE s = 'O')
       SELECT DISTINCT key, year FROM o WHERE NOT EXISTS (SELECT 1 FROM years y WHERE y.key = o.key AND y.year = o.year)
       UNION SELECT key, year FROM years y WHERE EXISTS (SELECT 1 FROM months m WHERE m.key = y.key AND m.year = y.year AND m.generated > y.generated)""",
)
def _(spark, d):
    o = m.orders(spark, d).select(F.col("region_code").alias("key"), F.year("center_time").cast("long").alias("year"), F.col("size_bytes").alias("generated"), "status")
    years = o.where("status = 'F'").groupBy("key", "year").agg(F.max("generated").alias("generated"))
    return facts.years_needing_update(o.select("key", "year").distinct(), years, o.where("status = 'O'").select("key", "year", "generated"))


@query("needs_refresh", f"SELECT product, max(added) > TIMESTAMP '2024-01-29 12:00:00' AS needs_refresh FROM {_EVENTS} GROUP BY 1")
def _(spark, d):
    e = m.events(spark, d)
    products = e.select("product").distinct().withColumn("last_refresh", F.lit(dt.datetime(2024, 1, 29, 12)).cast("timestamp_ntz"))
    return facts.needs_refresh(facts.most_recent_change(e, "added"), products)


@query("orphan_rows", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995)")
def _(spark, d):
    c = m.read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return extents.delete_archived(c, m.orders(spark, d).where("year(center_time) = 1995").select(F.col("region_code").alias("id")))


@query("upsert_extents", "SELECT c_custkey AS id, coalesce(n.bal, c_acctbal) AS bal FROM customer LEFT JOIN (SELECT c_custkey AS k, c_acctbal + 1 AS bal FROM customer WHERE c_nationkey < 5) n ON k = c_custkey UNION ALL SELECT -1, 0.5")
def _(spark, d):
    c = m.read(spark, d, "customer")
    new = c.where("c_nationkey < 5").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") + 1).alias("bal"))
    more = spark.createDataFrame([(-1, 0.5)], "id long, bal double")
    return extents.upsert(c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")), new.unionByName(more))


@query("changed_time", "SELECT l_orderkey AS id, l_linenumber AS line, greatest(l_shipdate, CASE WHEN l_returnflag <> 'N' THEN l_shipdate + INTERVAL 3 DAY END) AS changed FROM lineitem")
def _(spark, d):
    li = m.read(spark, d, "lineitem").withColumn("updated", F.when(F.col("l_returnflag") != "N", F.col("l_shipdate") + F.expr("INTERVAL 3 DAYS")))
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), facts.changed_time("l_shipdate", "updated").alias("changed"))


@query("creation_time", f"SELECT id, coalesce(CASE WHEN id::BIGINT % 3 = 0 THEN center_time END, CASE WHEN id::BIGINT % 3 = 1 THEN center_time + INTERVAL 1 HOUR END, added + INTERVAL 1 DAY) AS created FROM {_EVENTS}")
def _(spark, d):
    kind = F.col("id").cast("long") % 3
    text = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    doc = F.to_json(F.struct(F.when(kind == 0, text(F.col("center_time"))).alias("created"), F.when(kind == 1, text(F.col("center_time") + F.expr("INTERVAL 1 HOUR"))).alias("creation_dt")))
    e = m.events(spark, d).select("id", doc.alias("doc"), (F.col("added") + F.expr("INTERVAL 1 DAY")).alias("added"))
    md = {"dataset": {"creation_dt": ["creation_dt"], "search_fields": {"created": {"offset": ["created"], "type": "string"}}}}
    from eocatalog.functions import fields

    own = fields.compile_fields(F.col("doc"), md)
    return e.select("id", extents.creation_time(F.col("doc"), md, own, F.col("added")).alias("created"))


@query("center_time", "SELECT l_orderkey AS id, l_linenumber AS line, make_timestamp((epoch_us(o_orderdate) + epoch_us(l_shipdate)) // 2) AS center_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, d):
    j = m.read(spark, d, "lineitem").join(m.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), times.midpoint(F.col("o_orderdate"), F.col("l_shipdate")).alias("center_time"))


@query("json_field", f"SELECT id, (doc->>'$.k')::INTEGER AS k FROM {_EVENTS}")
def _(spark, d):
    from eocatalog.functions import fields

    return m.events(spark, d).select("id", fields.field(F.col("doc"), {"offset": ["k"], "type": "integer"}).alias("k"))


@query(
    "srid_resolution",
    """SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 32600 + n_nationkey WHEN 1 THEN 3577 WHEN 2 THEN ('283' || (50 + n_nationkey % 6))::INTEGER ELSE 4326 END::INTEGER AS srid FROM nation""",
)
def _(spark, d):
    key = F.col("n_nationkey")
    reference = F.when(key % 4 == 0, F.concat(F.lit("EPSG:"), (key + 32600).cast("string"))).when(key % 4 == 1, F.lit('PROJCS["GDA94 / Australian Albers",AUTHORITY["EPSG","3577"]]'))
    datum = F.when(key % 4 == 2, "GDA94")
    return m.read(spark, d, "nation").select(key.alias("id"), crs.srid(reference, datum, (-(key % 6) - 50).cast("string"), 4326).alias("srid"))


@query("tile_code", "SELECT p_partkey AS id, floor((p_retailprice - 1200) / 100.0)::BIGINT || '_' || floor((p_size - 25) / 7.0)::BIGINT AS region_code FROM part")
def _(spark, d):
    return m.read(spark, d, "part").select(F.col("p_partkey").alias("id"), regions.tile_code(F.col("p_retailprice"), F.col("p_size"), 100.0, 7.0, 1200.0, 25.0).alias("region_code"))


@query("scene_code", "SELECT l_orderkey AS path, CASE WHEN min(l_linenumber) = max(l_linenumber) THEN l_orderkey || '_' || min(l_linenumber) ELSE l_orderkey::VARCHAR END AS region_code FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = m.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    return rows.select("path", regions.scene_code(F.col("path"), F.col("lo"), F.col("hi")).alias("region_code"))


@query("equal_area_y", "WITH c AS (SELECT s_suppkey AS id, s_acctbal / 200.0 AS lat, sqrt((1 / 298.257223563) * (2 - 1 / 298.257223563)) AS e FROM supplier), k AS (SELECT *, sin(radians(lat)) AS s, cos(radians(30.0)) / sqrt(1 - (e * sin(radians(30.0))) ** 2) AS k0 FROM c) SELECT id, round(6378137.0 * (1 - e * e) * (s / (1 - (e * s) ** 2) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) / (2 * k0), 3) AS y FROM k")
def _(spark, d):
    lat = F.col("s_acctbal") / 200.0
    return m.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round(geometry.equal_area_xy(F.lit(0.0), lat)[1], 3).alias("y"))


_LOCATIONS = "(SELECT CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS product, url AS uri FROM pages WHERE url IS NOT NULL)"


def _locations(spark, d):
    return m.read(spark, d, "pages").where("url IS NOT NULL").select(F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("product"), F.col("url").alias("uri"))


@query("location_samples", f"SELECT product, uri FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY uri) AS k FROM {_LOCATIONS}) WHERE k <= 3")
def _(spark, d):
    return facts.location_samples(_locations(spark, d))


@query(
    "uri_common_prefix",
    rf"""WITH g AS (SELECT product, regexp_extract(uri, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) AS scheme, count(*)::BIGINT AS n, min(uri) AS first_uri, max(uri) AS last_uri FROM {_LOCATIONS} GROUP BY 1, 2)
        SELECT *, CASE WHEN first_uri = last_uri THEN first_uri ELSE regexp_extract(left(first_uri, len(list_filter(range(1, least(length(first_uri), length(last_uri)) + 1), lambda i: left(first_uri, i) = left(last_uri, i)))), '^(.*/)', 1) END AS prefix FROM g""",
)
def _(spark, d):
    return facts.uri_prefixes(_locations(spark, d))


@query("file_label", r"SELECT page_id AS id, regexp_replace(list_filter([p[-1], p[-2], p[-3], array_to_string(p[1:len(p) - 3], '/')], lambda x: x <> '' AND x NOT IN ('ga-metadata.yaml', 'agdc-metadata.yaml', 'ARD-METADATA.yaml'))[1], '(^|\.)(yaml|json)$', '') AS label FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)")
def _(spark, d):
    return m.read(spark, d, "pages").select(F.col("page_id").alias("id"), texts.file_label(F.col("url")).alias("label"))


@query(
    "product_grouping",
    """WITH p AS (SELECT DISTINCT p_type AS product FROM part),
       g AS (SELECT product, CASE WHEN regexp_matches(product, '^STANDARD') THEN 'Standard' WHEN regexp_matches(product, 'BRASS|STEEL') THEN 'Metal' ELSE 'Other' END AS group_name FROM p)
       SELECT product, group_name, count(*) OVER (PARTITION BY group_name)::BIGINT AS group_size,
              (CASE WHEN group_name = 'Other' THEN (row_number() OVER (PARTITION BY group_name ORDER BY product) - 1) // 5 ELSE 0 END)::INTEGER AS chunk FROM g""",
)
def _(spark, d):
    return facts.group_products(m.read(spark, d, "part").select(F.col("p_type").alias("product")).distinct(), [("Standard", "^STANDARD"), ("Metal", "BRASS|STEEL")])


@query("lineage_overflow", "SELECT l_orderkey AS dataset_ref, array_to_string(list_sort(list(l_partkey))[1:3], ',') AS shown, greatest(count(*) - 3, 0)::BIGINT AS remaining FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1")
def _(spark, d):
    edges = m.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("dataset_ref"), F.col("l_partkey").alias("source_ref")).distinct()
    return facts.overflow(edges, 3).withColumn("shown", F.array_join(F.transform("shown", lambda x: x.cast("string")), ","))


@query("unsummarised_products", "SELECT p_brand AS product FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 45)")
def _(spark, d):
    part = m.read(spark, d, "part")
    cells = part.where("p_size > 45").select(F.col("p_brand").alias("product"), F.lit("all").alias("period_type")).distinct()
    return facts.unsummarised(part.select(F.col("p_brand").alias("product")).distinct(), cells)


@query("products_with_summaries", "SELECT p.product, n FROM (SELECT DISTINCT p_brand AS product FROM part) p LEFT JOIN (SELECT p_brand AS product, count(*)::BIGINT AS n FROM part WHERE p_size > 45 GROUP BY 1) s USING (product)")
def _(spark, d):
    part = m.read(spark, d, "part").withColumnRenamed("p_brand", "product")
    return facts.with_summaries(part.select("product").distinct(), part.where("p_size > 45").groupBy("product").agg(F.count(F.lit(1)).alias("n")))


@query("newest_indexed", "SELECT o_orderpriority AS product, max(l_shipdate) AS newest FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, d):
    li = m.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("added"))
    return facts.newest_indexed(m.orders(spark, d).select("id", "product"), li)


@query("region_coverage_counts", f"SELECT product, region_code, n, box FROM (SELECT product, region_code, n FROM {_REGION_COUNTS}) c JOIN (SELECT n_nationkey::VARCHAR AS code, n_name AS box FROM nation) r ON r.code = c.region_code")
def _(spark, d):
    known = m.read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("region_code"), F.col("n_name").alias("geometry"))
    return stac.region_features(agg.region_histogram(m.events(spark, d)), known).withColumnRenamed("geometry", "box")


@query("timeline_json", f"SELECT product, '{{' || string_agg('\"' || day::VARCHAR || '\":' || n::VARCHAR, ',' ORDER BY day) || '}}' AS timeline FROM (SELECT product, center_time::DATE AS day, count(*) AS n FROM {_EVENTS} GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return stac.timeline_json(agg.day_histogram(m.events(spark, d), "UTC"))


@query("largest_footprints", "SELECT doc_id AS id, strlen(text)::INTEGER AS size FROM documents ORDER BY size DESC, id LIMIT 15")
def _(spark, d):
    docs = m.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").alias("size"))
    return facts.largest(docs, 15)


@query("item_by_id", f"SELECT id, product, center_time FROM {_EVENTS} WHERE id = '1234'")
def _(spark, d):
    return search.item(m.events(spark, d), "1234").select("id", "product", "center_time")


@query("sample_row_per_product", f"SELECT product, min(id) AS id FROM {_EVENTS} GROUP BY 1")
def _(spark, d):
    return facts.first_rows(m.events(spark, d), "product", [F.col("id").asc()], 1).select("product", "id")


@query("derived_products", "SELECT p_mfgr AS product, linked FROM (SELECT n_name AS p_mfgr, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS linked FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)")
def _(spark, d):
    items = m.read(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("dataset_ref"), F.concat(F.lit("s"), "l_suppkey").alias("source_ref"))
    parts = m.read(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("product"))
    suppliers = m.read(spark, d, "supplier").join(m.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("n_name").alias("product"))
    linked = facts.linked_products(items, parts.unionByName(suppliers), "derived").where(F.size("linked") > 0)
    return linked.select("product", F.array_join("linked", ",").alias("linked"))


@query("region_codes_split", "SELECT p_partkey AS id, floor((p_retailprice - 1200) / 100.0)::INTEGER AS x, floor((p_size - 25) / 7.0)::INTEGER AS y FROM part")
def _(spark, d):
    code = regions.tile_code(F.col("p_retailprice"), F.col("p_size"), 100.0, 7.0, 1200.0, 25.0)
    x, y = regions.split_code(code)
    return m.read(spark, d, "part").select(F.col("p_partkey").alias("id"), x.alias("x"), y.alias("y"))


@query("period_cells_by_size", f"SELECT product, start_day, dataset_count FROM ({_ROLLUP}) WHERE period_type = 'month' QUALIFY row_number() OVER (PARTITION BY product ORDER BY dataset_count DESC, start_day) <= 3")
def _(spark, d):
    months = _orders_rollup(spark, d).where("period_type = 'month'")
    return facts.first_rows(months, "product", [F.col("dataset_count").desc(), F.col("start_day").asc()], 3).select("product", "start_day", "dataset_count")


# --- what SQL can't express


@query("sample_fixed_metadata")
def _(spark, d):
    rows = m.read(spark, d, "documents").select(F.col("source").alias("product"), F.col("doc_id").alias("id"), "lang")
    return facts.fixed_fields(facts.hash_sample(rows, 1000), ["lang"])


def _rectangles(spark, d):
    f = m.footprints(spark, d).where("srid IS NOT NULL")
    ring = F.transform(geometry.bounds_polygon(*[F.col(c) * 10 + 135 if c[0] == "x" else F.col(c) * 10 - 25 for c in ("xmin", "ymin", "xmax", "ymax")]), lambda p: F.array(p["x"], p["y"]))
    text = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    return f.select("id", (F.col("srid") % 3).alias("product"), F.lit(4326).alias("srid"), geometry.geojson_to_wkb(text).alias("footprint"))


@query("footprint_union")
def _(spark, d):
    return geometry.union_by(_rectangles(spark, d), ["product"])


@query("footprint_valid", f"SELECT id, xmin <> xmax AND ymin <> ymax AS valid, round(100 * (xmax - xmin) * (ymax - ymin), 6) AS area FROM {_BOXES} WHERE srid IS NOT NULL")
def _(spark, d):
    return _rectangles(spark, d).select("id", geometry.is_valid("footprint").alias("valid"), F.round(geometry.area("footprint"), 6).alias("area"))


@query("footprint_transform")
def _(spark, d):
    return _rectangles(spark, d).select("id", geometry.transform(F.col("footprint"), F.col("srid"), 3577).alias("footprint"))


@query("geojson_features")
def _(spark, d):
    f = m.footprints(spark, d).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("product"), F.lit(dt.datetime(2024, 1, 1)).alias("center_time"), F.col("srid").cast("string").alias("region_code"), "xmin", "ymin", "xmax", "ymax")
    return stac.features(f)


def _number(x: str) -> str:
    return f"regexp_replace(({x})::DOUBLE::VARCHAR, '\\.0$', '')"


_BOUNDS = [f"{f}(x0, x1, x2)" if k % 2 == 0 else f"{f}(y0, y1, y2)" for k, f in enumerate(("least", "least", "greatest", "greatest"))]


@query(
    "features_of_outlines",
    f"""SELECT id::VARCHAR AS id, '{{"type":"Feature","id":"' || id || '","bbox":[' || {" || ',' || ".join(f"{b}::DOUBLE" for b in _BOUNDS)} || '],"geometry":{{"coordinates":[[' || {" || ',' || ".join(f"'[' || {_number(f'x{k % 3}')} || ',' || {_number(f'y{k % 3}')} || ']'" for k in range(4))} || ']],"type":"Polygon"}},"properties":{{"datetime":"2024-01-01T00:00:00Z","odc:product":"p"}}}}' AS feature FROM {_TRIANGLES}""",
)
def _(spark, d):
    """GeoJSON features with rows' own outlines."""
    t = _triangle_points(spark, d)
    ring = F.array(*(F.array(f"x{k % 3}", f"y{k % 3}") for k in range(4)))
    outline = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    ends = {f"{a}{end}": f(*(f"{a}{k}" for k in range(3))) for end, f in (("min", F.least), ("max", F.greatest)) for a in "xy"}
    at = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    return stac.features(t.select(F.col("id").cast("string").alias("id"), F.lit("p").alias("product"), at.alias("center_time"), F.lit(None).cast("string").alias("region_code"), outline.alias("outline"), *(v.alias(k) for k, v in ends.items())))


_ITEM_LINKS = """[{"rel":"self","href":"/collections/' || product || '/items/' || id || '"},{"rel":"collection","href":"/collections/' || product || '"}"""


@query(
    "stac_items",
    f"""SELECT id, '{{"type":"Feature","stac_version":"1.0.0","id":"' || id || '","collection":"' || product || '","properties":{{"datetime":"' || strftime(center_time, '%Y-%m-%dT%H:%M:%SZ') || '","created":"' || strftime(center_time, '%Y-%m-%dT%H:%M:%SZ') || '","odc:product":"' || product || '","odc:region_code":"' || region_code || '"' || coalesce(',"k":"' || (doc::JSON ->> 'k') || '"', '') || '}},"links":{_ITEM_LINKS}],"assets":{{}}}}' AS item FROM {_EVENTS}""",
)
def _(spark, d):
    e = m.events(spark, d)
    nowhere = [F.lit(None).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    return stac.items(e.select("*", *nowhere), {"k": F.get_json_object("doc", "$.k")})


@query(
    "stac_items_with_assets",
    f"""SELECT id, '{{"blue":{{"href":"https://b.s3.amazonaws.com/' || product || '/' || id || '/blue.tif","title":"blue","type":"image/tiff; application=geotiff","roles":["data"]}},"thumbnail":{{"href":"https://b.s3.amazonaws.com/' || product || '/' || id || '/t.jpg","title":"thumbnail","type":"image/jpeg","roles":["thumbnail"]}}}}' AS assets,
        '{_ITEM_LINKS},{{"rel":"derived_from","href":"/dataset/s' || id || '"}},{{"rel":"canonical","href":"https://b.s3.amazonaws.com/' || product || '/' || id || '/doc.json"}}]' AS links FROM {_EVENTS}""",
)
def _(spark, d):
    nowhere = [F.lit(None).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    files = F.lit('{"measurements":{"blue":{"path":"blue.tif"}},"accessories":{"thumbnail":{"path":"t.jpg"}},"lineage":{"level1":["s')
    doc = F.concat(files, F.col("id"), F.lit('"]}}'))
    e = m.events(spark, d).withColumn("doc", doc).withColumn("uri", F.concat(F.lit("s3://b/"), "product", F.lit("/"), "id", F.lit("/doc.json")))
    out = stac.items(e.select("*", *nowhere), doc="doc", uri="uri")
    return out.select("id", F.get_json_object("item", "$.assets").alias("assets"), F.get_json_object("item", "$.links").alias("links"))


#: A metadata type and products of the newer dialect, in which _documents writes events.
_EVENT_TYPE = {
    "name": "event",
    "dataset": {
        "measurements": ["measurements"],
        "grid_spatial": ["grid_spatial", "projection"],
        "creation_dt": ["properties", "odc:processing_datetime"],
        "search_fields": {"region_code": {"offset": ["properties", "odc:region_code"]}, "size_bytes": {"offset": ["size_bytes"]}},
    },
}
_EVENT_PRODUCTS = ("click", "error", "purchase", "view")


def _dealt(spark, d) -> DataFrame:
    """Events dealt out by id: what is done to documents takes far longer than moving rows, and a file's one row group is one task.

    The number is the session's own; without one, adaptive execution would put small rows together again.
    """
    return m.events(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")


def _documents(spark, d):
    """Events as dataset documents; every seventh is archived, and places come from the grid."""
    e = _dealt(spark, d)
    n = F.col("id").cast("long") % 50
    grid = F.struct(F.array(F.lit(1), F.lit(2)).alias("shape"), F.array(F.lit(1.0), F.lit(0.0), n.cast("double"), F.lit(0.0), F.lit(-1.0), F.lit(0.0)).alias("transform"))
    properties = F.struct(stac.iso(F.col("center_time")).alias("datetime"), F.col("region_code").alias("odc:region_code"))
    doc = F.to_json(F.struct(F.lit("epsg:4326").alias("crs"), F.struct(grid.alias("default")).alias("grids"), properties.alias("properties"), F.lit(10).alias("size_bytes")))
    return e.select("id", "product", doc.alias("doc"), "added", F.when(F.col("id").cast("long") % 7 == 0, F.col("added")).alias("archived"))


def _definitions():
    return [(_EVENT_TYPE, {"name": p}) for p in _EVENT_PRODUCTS]


_LIVE = f"(SELECT *, date_trunc('second', center_time) AS t FROM {_EVENTS} WHERE id::BIGINT % 7 <> 0 AND product IN ('click', 'error', 'purchase', 'view'))"


@query("documents_to_extents", f"SELECT id, product, t AS center_time, added AS creation_time, region_code, 10::BIGINT AS size_bytes, 4326 AS srid, (id::BIGINT % 50)::DOUBLE AS xmin, -1.0::DOUBLE AS ymin, (id::BIGINT % 50 + 2)::DOUBLE AS xmax, 0.0::DOUBLE AS ymax FROM {_LIVE}")
def _(spark, d):
    made = job.extents_of(_documents(spark, d), _definitions())
    box = geometry.envelope("footprint")
    return made.withColumn("box", box).select("id", "product", "center_time", "creation_time", "region_code", "size_bytes", "srid", *[F.col(f"box.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


#: What a query of whole cells returns.
_CELL = ("dataset_count", "size_bytes", "newest_creation_time", "footprint_count", "begin", "end", "xmin", "ymin", "xmax", "ymax", "timeline_unit")


def _cell_rows(found: DataFrame) -> DataFrame:
    """Cells with their histograms as text."""
    srids = F.array_join(F.transform("srids", lambda x: x.cast("string")), ",")
    return found.select("product", "period_type", "start_day", *(F.col(c).alias({"begin": "first_time", "end": "last_time"}.get(c, c)) for c in _CELL), cells.histogram_text("timeline").alias("timeline"), cells.histogram_text("regions").alias("regions"), srids.alias("srids"))


def _cell_sql(rows: str) -> str:
    """The same in SQL, of rows(product, center_time, creation_time, size_bytes, region_code, srid, xmin, ymin, xmax, ymax)."""
    keys = "product, period_type, start_day"
    text = lambda name, key, n="count(*)": f"{name} AS (SELECT {keys}, string_agg(coalesce({key}::VARCHAR, '') || ':' || n, ',' ORDER BY {key} NULLS FIRST) AS {name} FROM (SELECT {keys}, {key}, {n} AS n FROM p GROUP BY ALL) GROUP BY ALL)"
    return f"""WITH k AS (SELECT *, (center_time + {_DARWIN})::DATE AS day FROM ({rows})),
        p AS (SELECT *, 'all' AS period_type, DATE '1900-01-01' AS start_day FROM k UNION ALL SELECT *, 'year', date_trunc('year', day)::DATE FROM k UNION ALL SELECT *, 'month', date_trunc('month', day)::DATE FROM k),
        {text("timeline", "day")}, {text("regions", "region_code")},
        systems AS (SELECT {keys}, string_agg(srid::VARCHAR, ',' ORDER BY srid) AS srids FROM (SELECT DISTINCT {keys}, srid FROM p WHERE srid IS NOT NULL) GROUP BY ALL),
        c AS (SELECT {keys}, count(*)::BIGINT AS dataset_count, coalesce(sum(size_bytes), 0)::BIGINT AS size_bytes, max(creation_time) AS newest_creation_time, count(xmin)::BIGINT AS footprint_count,
              min(center_time) AS first_time, max(center_time) AS last_time, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, 'day' AS timeline_unit FROM p GROUP BY ALL)
        SELECT c.*, timeline, regions, coalesce(srids, '') AS srids FROM c JOIN timeline USING ({keys}) JOIN regions USING ({keys}) LEFT JOIN systems USING ({keys})"""


@query("documents_to_cells", _cell_sql(f"SELECT product, t AS center_time, added AS creation_time, 10 AS size_bytes, region_code, 4326 AS srid, (id::BIGINT % 50)::DOUBLE AS xmin, -1.0::DOUBLE AS ymin, (id::BIGINT % 50 + 2)::DOUBLE AS xmax, 0.0::DOUBLE AS ymax FROM {_LIVE}"))
def _(spark, d):
    made = job.placed(job.extents_of(_documents(spark, d), _definitions()))
    return _cell_rows(refresh.roll_up(refresh.month_cells(made, agg.GROUPING_TZ)))


@query(
    "documents_to_summary",
    f"""WITH l AS (SELECT product, id::BIGINT % 50 AS k, t FROM {_LIVE}),
        lanes AS (SELECT DISTINCT product, unnest([k, k + 1]) AS lane FROM l)
        SELECT product, count(*)::BIGINT AS dataset_count, (10 * count(*))::BIGINT AS size_bytes, '4326' AS srids, (SELECT count(*) FROM lanes WHERE lanes.product = l.product)::DOUBLE AS area,
               (SELECT count(DISTINCT (t + {_DARWIN})::DATE) FROM l AS x WHERE x.product = l.product)::BIGINT AS days FROM l GROUP BY 1""",
)
def _(spark, d):
    whole = job.period_summary(tables.stored(job.extents_of(_documents(spark, d), _definitions()), "extents"), 4326)
    return whole.select("product", "dataset_count", "size_bytes", F.array_join(F.transform("srids", lambda s: s.cast("string")), ",").alias("srids"), F.round(geometry.area("footprint"), 6).alias("area"), F.size("timeline").cast("long").alias("days"))


@query(
    "documents_to_regions",
    f"""WITH l AS (SELECT product, region_code, id::BIGINT % 50 AS k FROM {_LIVE}),
        lanes AS (SELECT product, region_code, count(DISTINCT lane)::DOUBLE AS area FROM (SELECT product, region_code, unnest([k, k + 1]) AS lane FROM l) GROUP BY 1, 2)
        SELECT product, region_code, n, area FROM (SELECT product, region_code, count(*)::BIGINT AS n FROM l GROUP BY 1, 2) JOIN lanes USING (product, region_code)""",
)
def _(spark, d):
    regions_ = geometry.region_coverage(tables.stored(job.extents_of(_documents(spark, d), _definitions()), "extents"))
    return regions_.select("product", "region_code", "n", F.round(geometry.area("footprint"), 6).alias("area"))


#: Datasets after the changes that _datasets makes; of those that are gone, nothing counts.
_AFTER = f"""SELECT id, CASE WHEN i % 11 = 3 AND early THEN 'click' ELSE product END AS product, CASE WHEN i % 9 = 1 AND early THEN center_time + INTERVAL 36 HOUR ELSE center_time END AS center_time, added AS creation_time, added,
    i * 7 % 1000 AS size_bytes, CASE WHEN i % 13 <> 0 THEN region_code END AS region_code, CASE WHEN i % 3 > 0 THEN (32750 + i % 3)::INTEGER END AS srid,
    (i % 50)::DOUBLE AS xmin, (i % 20)::DOUBLE AS ymin, (i % 50 + 1)::DOUBLE AS xmax, (i % 20 + 2)::DOUBLE AS ymax, i % 10 = 0 AND early AS gone,
    CASE WHEN early AND i % 10 = 0 THEN TIMESTAMP '2024-01-25' WHEN early AND (i % 9 = 1 OR i % 11 = 3) THEN TIMESTAMP '2024-01-26' ELSE added END AS changed
    FROM (SELECT *, id::BIGINT AS i, added < TIMESTAMP '2024-01-21' AS early FROM {_EVENTS})"""


#: An older type, in which _both_dialects writes purchases and errors.
_OLDER_TYPE = {
    "name": "older",
    "dataset": {
        "measurements": ["image", "bands"],
        "grid_spatial": ["grid_spatial", "projection"],
        "creation_dt": ["creation_dt"],
        "search_fields": {
            "time": {"type": "datetime-range", "min_offset": [["extent", "from_dt"]], "max_offset": [["extent", "to_dt"]]},
            "platform": {"offset": ["platform", "code"]},
            "instrument": {"offset": ["instrument", "name"]},
            "sat_path": {"type": "integer", "offset": ["image", "path"]},
            "sat_row": {"type": "numeric-range", "min_offset": [["image", "row"]], "max_offset": [["image", "last_row"]]},
        },
    },
}


def _both_dialects(spark, d) -> DataFrame:
    """Clicks and views in the newer dialect, purchases and errors in the older, with triangles as outlines."""
    e = _dealt(spark, d)
    n = F.col("id").cast("long") % 50
    x, when = n.cast("double"), stac.iso(F.col("center_time"))
    ring = F.array(*(F.array(a, b) for a, b in ((x, F.lit(0.0)), (x + 2, F.lit(0.0)), (x, F.lit(1.0)), (x, F.lit(0.0)))))
    outline = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    named = lambda name, path: F.create_map(F.lit(name), F.struct(path.alias("path")))
    properties = F.struct(when.alias("datetime"), F.lit("sat-1").alias("eo:platform"), F.lit("A_B").alias("eo:instrument"), (n / 2).alias("eo:cloud_cover"), F.col("region_code").alias("odc:region_code"), F.lit(None).cast("string").alias("nothing"))
    newer = F.struct(
        F.col("id"), F.when(n % 2 == 0, F.concat(F.lit("label-"), "id")).alias("label"), F.lit("epsg:4326").alias("crs"), outline.alias("geometry"), properties.alias("properties"),
        named("blue", F.lit("blue.tif")).alias("measurements"), named("thumbnail:nbart", F.lit("t.jpg")).alias("accessories"), F.create_map(F.lit("level1"), F.array(F.concat(F.lit("s"), "id"))).alias("lineage"), F.lit(10).alias("size_bytes"),
    )
    spatial_ = F.struct(F.struct(F.lit("EPSG:4326").alias("spatial_reference"), outline.alias("valid_data")).alias("projection"))
    image = F.struct(named("7", F.lit("b7.tif")).alias("bands"), (n + 1).alias("path"), F.lit(80).alias("row"), (F.lit(80) + n % 2).alias("last_row"))
    older = F.struct(
        F.col("id"), when.alias("creation_dt"), F.struct(F.lit("SAT_2").alias("code")).alias("platform"), F.struct(F.lit("OLI").alias("name")).alias("instrument"), F.struct(when.alias("from_dt"), when.alias("to_dt")).alias("extent"),
        spatial_.alias("grid_spatial"), image.alias("image"), named("full", F.lit("q.jpg")).alias("browse"), F.lit("sums.sha1").alias("checksum_path"), F.lit(10).alias("size_bytes"),
    )
    is_newer = F.col("product").isin("click", "view")
    doc = F.when(is_newer, F.to_json(newer)).otherwise(F.to_json(older))
    uri = F.concat(F.lit("s3://b/"), "product", F.lit("/d"), "id", F.when(is_newer, "/x.odc-metadata.yaml").otherwise("/ga-metadata.yaml"))
    return e.where(F.col("product").isin(*_EVENT_PRODUCTS)).select("id", "product", doc.alias("doc"), uri.alias("uri"), "added", F.lit(None).cast("timestamp_ntz").alias("archived"))


def _dialects():
    return [(_EVENT_TYPE if p in ("click", "view") else _OLDER_TYPE, {"name": p}) for p in _EVENT_PRODUCTS]


_ITEM_ROWS = f"""SELECT *, id::BIGINT % 50 AS n, product IN ('click', 'view') AS newer, strftime(center_time, '%Y-%m-%dT%H:%M:%SZ') AS t FROM {_EVENTS} WHERE product IN ('click', 'error', 'purchase', 'view')"""
_GEOMETRY = """'{"coordinates":[[[' || n || ',0],[' || (n + 2) || ',0],[' || n || ',1],[' || n || ',0]]],"type":"Polygon"}'"""
_ITEM_SQL = f"""SELECT id, product,
    '{{"type":"Feature","stac_version":"1.0.0","id":"' || id || '","collection":"' || product || '","bbox":[' || n::DOUBLE || ',0.0,' || (n + 2)::DOUBLE || ',1.0],"geometry":' || {_GEOMETRY} || ',"properties":{{'
    || CASE WHEN newer THEN '"created":"' || strftime(added, '%Y-%m-%dT%H:%M:%SZ') ELSE '"created":"' || t END || '","cubedash:region_code":' || CASE WHEN newer THEN '"' || region_code || '"' ELSE '"' || (n + 1) || CASE WHEN n % 2 = 0 THEN '_80' ELSE '' END || '"' END
    || ',"datetime":"' || t || '"' || CASE WHEN newer THEN ',"eo:cloud_cover":' || CASE WHEN n % 2 = 0 THEN (n // 2)::VARCHAR ELSE (n / 2)::DOUBLE::VARCHAR END || ',"instruments":["a","b"]' ELSE ',"instruments":["oli"],"landsat:wrs_path":' || (n + 1) || CASE WHEN n % 2 = 0 THEN ',"landsat:wrs_row":80' ELSE '' END END
    || ',"odc:product":"' || product || '"' || CASE WHEN newer THEN ',"odc:region_code":"' || region_code || '"' WHEN n % 2 = 1 THEN ',"odc:sat_row":[80,81]' ELSE '' END
    || ',"platform":"' || CASE WHEN newer THEN 'sat-1' ELSE 'sat-2' END || '","title":"' || CASE WHEN newer AND n % 2 = 0 THEN 'label-' || id WHEN newer THEN 'x.odc-metadata' ELSE 'd' || id END || '"}}'
    || ',"links":[{{"rel":"self","href":"/collections/' || product || '/items/' || id || '","type":"application/geo+json"}},{{"rel":"collection","href":"/collections/' || product || '","type":"application/json"}},{{"rel":"root","href":"/","type":"application/json"}}'
    || CASE WHEN newer THEN ',{{"rel":"derived_from","href":"/dataset/s' || id || '","type":"application/json"}}' ELSE '' END || ',{{"rel":"canonical","href":"https://b.s3.amazonaws.com/' || product || '/d' || id || CASE WHEN newer THEN '/x.odc-metadata.yaml' ELSE '/ga-metadata.yaml' END || '","type":"text/yaml"}}]'
    || ',"assets":{{' || CASE WHEN newer THEN '"blue":{{"href":"https://b.s3.amazonaws.com/' || product || '/d' || id || '/blue.tif","title":"blue","type":"image/tiff; application=geotiff","roles":["data"],"eo:bands":[{{"name":"blue"}}]}},"thumbnail:nbart":{{"href":"https://b.s3.amazonaws.com/' || product || '/d' || id || '/t.jpg","title":"thumbnail:nbart","type":"image/jpeg","roles":["thumbnail"]}}'
    ELSE '"7":{{"href":"https://b.s3.amazonaws.com/' || product || '/d' || id || '/b7.tif","title":"7","type":"image/tiff; application=geotiff","roles":["data"],"eo:bands":[{{"name":"7"}}]}},"thumbnail:full":{{"href":"https://b.s3.amazonaws.com/' || product || '/d' || id || '/q.jpg","title":"thumbnail:full","type":"image/jpeg","roles":["thumbnail"]}},"checksum:sha1":{{"href":"https://b.s3.amazonaws.com/' || product || '/d' || id || '/sums.sha1","title":"checksum:sha1","roles":["metadata"]}}' END || '}}}}' AS item
    FROM ({_ITEM_ROWS})"""


def _described(spark, d) -> DataFrame:
    docs = _both_dialects(spark, d)
    placed = job.placed(job.extents_of(docs, _dialects()))
    return items.described(docs.select("id", "product", "doc", "uri"), _dialects()).drop("doc", "product").join(placed, "id")


@query("items_of_both_dialects", _ITEM_SQL)
def _(spark, d):
    return items.items(_described(spark, d))


@query("arrivals_items", f"SELECT added, id, item FROM ({_ITEM_SQL}) JOIN (SELECT id, added FROM {_EVENTS} WHERE product IN ('click', 'error', 'purchase', 'view') AND (added < TIMESTAMP '2024-01-20' OR (added = TIMESTAMP '2024-01-20' AND id > '500')) ORDER BY added DESC, id LIMIT 11) USING (id)")
def _(spark, d):
    """The page of ten after a key, of what was added last."""
    return items.arrivals_page(_both_dialects(spark, d), items.items(_described(spark, d)), 10, (dt.datetime(2024, 1, 20), "500"))


_MONTHS = f"SELECT product, date_trunc('month', center_time + {_DARWIN})::DATE AS month, count(*) AS n FROM {_EVENTS} GROUP BY 1, 2"


@query(
    "collection_documents",
    f"""WITH c AS (SELECT product, string_agg('{{"rel":"child","href":"/catalogs/' || product || '/' || year(month) || '-' || month(month) || '","title":"' || strftime(month, '%Y-%m') || '"}}', ',' ORDER BY month) AS children FROM ({_MONTHS}) GROUP BY 1),
        w AS (SELECT product, strftime(min(center_time), '%Y-%m-%dT%H:%M:%SZ') AS first, strftime(max(center_time), '%Y-%m-%dT%H:%M:%SZ') AS last FROM {_EVENTS} GROUP BY 1)
        SELECT product, '{{"type":"Collection","stac_version":"1.0.0","id":"' || product || '","title":"' || CASE product WHEN 'click' THEN 'Clicks' ELSE product END || '","description":"","license":"' || CASE product WHEN 'click' THEN 'CC-BY-4.0' ELSE 'various' END || '","extent":{{"spatial":{{"bbox":[[-180.0,-90.0,180.0,90.0]]}},"temporal":{{"interval":[["' || first || '","' || last || '"]]}}}},'
        || '"links":[{{"rel":"root","href":"/"}},{{"rel":"self","href":"/collections/' || product || '"}},{{"rel":"items","href":"/collections/' || product || '/items"}},{{"rel":"http://www.opengis.net/def/rel/ogc/1.0/queryables","href":"/collections/' || product || '/queryables"}},' || children || ']}}' AS collection FROM c JOIN w USING (product)""",
)
def _(spark, d):
    e = m.events(spark, d)
    is_click = F.col("product") == "click"
    products = e.select("product").distinct().select("product", F.when(is_click, "Clicks").alias("title"), F.lit(None).cast("string").alias("description"), F.when(is_click, "CC-BY-4.0").alias("licence"))
    return items.collections(cells.roll_up(cells.month_cells(e, agg.GROUPING_TZ)), products)


@query(
    "month_catalogue",
    f"""WITH r AS (SELECT id, center_time, row_number() OVER (ORDER BY center_time, id) AS k FROM {_EVENTS} WHERE product = 'view' AND center_time >= TIMESTAMP '2023-12-31 14:30:00' AND center_time < TIMESTAMP '2024-01-31 14:30:00' AND (center_time > TIMESTAMP '2024-01-05' OR (center_time = TIMESTAMP '2024-01-05' AND id > '7'))),
        s AS (SELECT * FROM r WHERE k <= 20), l AS (SELECT string_agg('{{"rel":"item","href":"/collections/view/items/' || id || '","title":"label ' || id || '"}}', ',' ORDER BY k) AS links, arg_max(id, k) AS id, max(center_time) AS t, count(*) AS n FROM s)
        SELECT '{{"type":"Catalog","stac_version":"1.0.0","id":"view-2024-1","description":"view for January 2024","links":[{{"rel":"self","href":"/catalogs/view/2024-1"}},' || links || CASE WHEN (SELECT count(*) FROM r) > 20 THEN ',{{"rel":"next","href":"/catalogs/view/2024-1?after=' || strftime(t, '%Y-%m-%dT%H:%M:%SZ') || ',' || id || '"}}' ELSE '' END || '],"numberReturned":' || n || ',"numberMatched":' || (SELECT n FROM ({_MONTHS}) WHERE product = 'view' AND month = DATE '2024-01-01') || '}}' AS catalogue FROM l""",
)
def _(spark, d):
    """The page of twenty after a key of a product's month."""
    e = m.events(spark, d)
    labelled = e.select("id", "product", "center_time", F.concat(F.lit("label "), "id").alias("label"))
    whole = cells.roll_up(cells.month_cells(e, agg.GROUPING_TZ))
    return items.month_page(labelled, whole, "view", 2024, 1, times.period_bounds(2024, 1, tz=agg.GROUPING_TZ), 20, (dt.datetime(2024, 1, 5), "7"))


@query("month_page_starts", f"SELECT product, month, page, min(center_time) AS first_time, arg_min(id, k) AS first_id, count(*)::BIGINT AS n FROM (SELECT *, ((k - 1) // 500)::INTEGER AS page FROM (SELECT product, date_trunc('month', center_time + {_DARWIN})::DATE AS month, center_time, id, row_number() OVER (PARTITION BY product, date_trunc('month', center_time + {_DARWIN}) ORDER BY center_time, id) AS k FROM {_EVENTS})) GROUP BY 1, 2, 3")
def _(spark, d):
    return items.month_pages(m.events(spark, d), agg.GROUPING_TZ)


@query(
    "footprint_features",
    f"""SELECT product, period_type, start_day, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' || xmin || ',' || ymin || '],[' || xmax || ',' || ymin || '],[' || xmax || ',' || ymax || '],[' || xmin || ',' || ymax || '],[' || xmin || ',' || ymin || ']]]}},"properties":{{"dataset_count":' || dataset_count || ',"product_name":"' || product || '","time_spec":['
        || CASE period_type WHEN 'all' THEN 'null,null,null' WHEN 'year' THEN year(start_day) || ',null,null' ELSE year(start_day) || ',' || month(start_day) || ',null' END || '],"begin":"' || strftime(first_time, '%Y-%m-%dT%H:%M:%SZ') || '","end":"' || strftime(last_time, '%Y-%m-%dT%H:%M:%SZ') || '"}}}}' AS feature FROM ({_cell_sql(f"SELECT * FROM ({_AFTER}) WHERE NOT gone")})""",
)
def _(spark, d):
    live = _datasets(spark, d, True).where(F.col("archived").isNull())
    return items.footprint_features(cells.roll_up(cells.month_cells(live, agg.GROUPING_TZ)))


# --- lookups


def _products(spark, d):
    return m.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("product"), F.col("n_regionkey").cast("string").alias("metadata_type"))


def _store_regions(spark, d):
    """Customers' segments as regions of their nations; those with few customers have no outline."""
    c = m.read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.col("c_nationkey").alias("product"), F.col("c_mktsegment").alias("region_code"), F.when(F.col("n") > 8, F.lit("outline")).alias("footprint"), "n")


@query("product_by_name", "SELECT n_nationkey AS id, n_name AS product FROM nation WHERE n_nationkey = 3")
def _(spark, d):
    return lookups.product_by_id(_products(spark, d), 3).select("id", "product")


@query("cells_of_products", "SELECT n_name AS product, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    cells = m.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("product_ref")).agg(F.count(F.lit(1)).alias("n"))
    return lookups.cells_of_products(cells, _products(spark, d)).select("product", "n")


@query("of_product_by_name", "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 4)")
def _(spark, d):
    products = _products(spark, d)
    name = products.orderBy("id").offset(4).first().product
    return lookups.of_product(m.read(spark, d, "supplier").withColumnRenamed("s_nationkey", "product_ref"), products, name).select(F.col("s_suppkey").alias("id"))


@query("with_product_names", "SELECT s_suppkey AS id, (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) AS product FROM supplier")
def _(spark, d):
    return lookups.with_product_names(m.read(spark, d, "supplier").withColumnRenamed("s_nationkey", "product_ref"), _products(spark, d)).select(F.col("s_suppkey").alias("id"), "product")


@query("product_regions", "SELECT c_mktsegment AS region_code, count(*)::BIGINT AS n FROM customer WHERE c_nationkey = 7 GROUP BY 1 HAVING count(*) > 8")
def _(spark, d):
    return lookups.product_regions(_store_regions(spark, d), 7).select("region_code", "n")


@query("region_labels", "SELECT p_partkey AS id, printf('Tile %+d, %+d', floor((p_retailprice - 1200) / 100.0)::INTEGER, floor((p_size - 25) / 7.0)::INTEGER) AS label FROM part")
def _(spark, d):
    code = regions.tile_code(F.col("p_retailprice"), F.col("p_size"), 100.0, 7.0, 1200.0, 25.0)
    return m.read(spark, d, "part").select(F.col("p_partkey").alias("id"), lookups.region_label(code, "tile").alias("label"))


@query("put_regions", "SELECT c_nationkey AS product, c_mktsegment AS region_code, count(*)::BIGINT AS n FROM customer WHERE c_nationkey % 3 <> 0 OR c_mktsegment <> 'BUILDING' GROUP BY 1, 2")
def _(spark, d):
    """Every third product is summarised again, and has no region BUILDING any more."""
    old = _store_regions(spark, d)
    again = old.where("product % 3 = 0")
    return lookups.put_regions(old, again.where("region_code <> 'BUILDING'"), again.select("product")).select("product", "region_code", "n")


@query("put_product_summaries", "SELECT n_nationkey AS id, n_name AS product, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM nation")
def _(spark, d):
    products = _products(spark, d).select("id", "product")
    old = products.where("id < 20").withColumn("n", F.lit(1))
    new = products.where("id % 2 = 0 OR id >= 20").select(F.when(F.col("id") < 20, F.lit(-1)).otherwise(F.col("id")).alias("id"), "product", F.when(F.col("id") % 2 == 0, 2).otherwise(1).alias("n"))
    return lookups.put_product_summaries(old, new)


_SPANS = "(SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate END AS gone FROM lineitem)"


def _order_locations(spark, d):
    li = m.read(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.concat_ws("/", F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_linenumber")).alias("uri"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_shipdate")).alias("archived"))


@query("active_locations", f"SELECT o_orderpriority AS product, count(*)::BIGINT AS n, min(l_returnflag || '/' || l_orderkey || '/' || l_linenumber) AS first_uri FROM {_SPANS} JOIN orders ON o_orderkey = l_orderkey WHERE gone IS NULL AND o_orderstatus <> 'F' GROUP BY 1")
def _(spark, d):
    datasets = m.orders(spark, d).withColumn("archived", F.when(F.col("status") == "F", F.col("center_time")))
    return lookups.active_locations(_order_locations(spark, d), datasets).groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.min("uri").alias("first_uri"))


@query("product_locations", f"SELECT uri FROM (SELECT l_returnflag || '/' || l_orderkey || '/' || l_linenumber AS uri FROM {_SPANS} JOIN orders ON o_orderkey = l_orderkey WHERE gone IS NULL AND o_orderpriority = '2-HIGH' AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01') ORDER BY uri LIMIT 100")
def _(spark, d):
    datasets = m.orders(spark, d).withColumn("archived", F.lit(None).cast("timestamp_ntz"))
    active = lookups.active_locations(_order_locations(spark, d), datasets)
    return lookups.product_locations(active, "2-HIGH", dt.datetime(1995, 1, 1), dt.datetime(1996, 1, 1)).select("uri")


@query("archived_location_times", f"SELECT l_returnflag || '/' || l_orderkey || '/' || l_linenumber AS uri, gone AS archived FROM {_SPANS} WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_linenumber = 3) AND gone IS NOT NULL")
def _(spark, d):
    locations = _order_locations(spark, d)
    id_ = m.read(spark, d, "lineitem").where("l_linenumber = 3").agg(F.min("l_orderkey").alias("id")).first().id
    return lookups.archived_location_times(locations, id_)


@query("cell_of_a_day", f"SELECT 'view' AS product, DATE '2024-01-12' AS start_day, count(*)::BIGINT AS dataset_count, round(sum(size_bytes), 2) AS size_bytes FROM {_EVENTS} WHERE product = 'view' AND (center_time + {_DARWIN})::DATE = DATE '2024-01-12'")
def _(spark, d):
    return lookups.cell(None, m.events(spark, d), "view", 2024, 1, 12).withColumn("size_bytes", F.round("size_bytes", 2))


@query("middle_day_counts", f"WITH b AS (SELECT product, (min(center_time) + (max(center_time) - min(center_time)) / 2)::DATE AS day FROM {_EVENTS} GROUP BY 1) SELECT product, day, (SELECT count(*) FROM {_EVENTS} e WHERE e.product = b.product AND e.center_time::DATE = b.day)::BIGINT AS n FROM b")
def _(spark, d):
    return lookups.middle_days(m.events(spark, d))


@query("slowest_responses", "SELECT event_id AS id, value AS seconds FROM events ORDER BY seconds DESC NULLS LAST, id LIMIT 15")
def _(spark, d):
    return lookups.slowest(m.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("seconds")), 15)


@query("search_hard_limit", f"SELECT id, center_time FROM {_EVENTS} WHERE {_CONDITION} ORDER BY center_time NULLS LAST, id LIMIT 151")
def _(spark, d):
    return search.hard_limited(m.events(spark, d), search.Search(time=JAN, products=_PRODUCTS), 150).select("id", "center_time")


@query("timeline_years", """WITH b AS (SELECT p_brand AS product, make_date((1000 + p_partkey // 12)::INTEGER, (1 + p_partkey % 12)::INTEGER, 1) AS day, count(*)::BIGINT AS n FROM part GROUP BY 1, 2), s AS (SELECT product, count(*) > 60 AS wide FROM b GROUP BY 1)
   SELECT product, CASE WHEN wide THEN 'year' ELSE 'month' END AS unit, CASE WHEN wide THEN date_trunc('year', day)::DATE ELSE day END AS day, sum(n)::BIGINT AS n FROM b JOIN s USING (product) GROUP BY 1, 2, 3""")
def _(spark, d):
    k = F.col("p_partkey").cast("int")
    months = m.read(spark, d, "part").groupBy(F.col("p_brand").alias("product"), F.make_date(F.lit(1000) + F.floor(k / 12).cast("int"), k % 12 + 1, F.lit(1)).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return agg.coarsen(months.withColumn("unit", F.lit("month")), 60)


@query("unsummarised_types", "SELECT DISTINCT p_brand || p_type AS product FROM part WHERE p_brand || p_type NOT IN (SELECT p_brand || p_type FROM part WHERE p_size > 45)")
def _(spark, d):
    part = m.read(spark, d, "part").withColumn("product", F.concat("p_brand", "p_type"))
    return facts.unsummarised(part.select("product").distinct(), part.where("p_size > 45").select("product", F.lit("all").alias("period_type")).distinct())


@query("incremental_refresh", f"SELECT product, 'month' AS period_type, date_trunc('month', center_time + {_DARWIN})::DATE AS start_day, count(*)::BIGINT AS dataset_count FROM {_EVENTS} WHERE NOT (id::BIGINT % 10 = 0 AND center_time > TIMESTAMP '2024-01-20') GROUP BY 1, 3")
def _(spark, d):
    """A refresh of all but the last days, then of the changes of these days, a tenth of them archivals."""
    cut = F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz")
    e = m.events(spark, d)
    old = e.where(F.col("center_time") <= cut)
    archived = F.when(F.col("id").cast("long") % 10 == 0, F.col("added"))
    changes = refresh.changes_since(e.withColumn("updated", F.lit(None).cast("timestamp_ntz")).withColumn("archived", archived), dt.datetime(2024, 1, 20))
    affected = refresh.affected_months(old, changes, agg.GROUPING_TZ)
    new = refresh.apply_changes(old, changes)
    cells = refresh.refresh_months(refresh.month_cells(old, agg.GROUPING_TZ), new, affected, agg.GROUPING_TZ)
    return refresh.roll_up(cells).where("period_type = 'month'").select("product", "period_type", "start_day", "dataset_count")


def _datasets(spark, d, after: bool) -> DataFrame:
    """Datasets made of events: of the first three weeks, or all of them after some early ones moved in time, to another product, or were archived."""
    e = m.events(spark, d).withColumn("i", F.col("id").cast("long")).withColumn("early", F.col("added") < F.lit(dt.datetime(2024, 1, 21)).cast("timestamp_ntz"))
    at = lambda day: F.lit(dt.datetime(2024, 1, day)).cast("timestamp_ntz")
    moved, sold, gone = (F.lit(after) & F.col("early") & (F.col("i") % n == k) for n, k in ((9, 1), (11, 3), (10, 0)))
    rows = e if after else e.where("early")
    i = F.col("i")
    return rows.select(
        "id", F.when(sold, "click").otherwise(F.col("product")).alias("product"), F.when(moved, F.col("center_time") + F.expr("INTERVAL 36 HOURS")).otherwise(F.col("center_time")).alias("center_time"),
        F.col("added").alias("creation_time"), (i * 7 % 1000).alias("size_bytes"), F.when(i % 13 != 0, F.col("region_code")).alias("region_code"), F.when(i % 3 > 0, (32750 + i % 3).cast("int")).alias("srid"),
        (i % 50).cast("double").alias("xmin"), (i % 20).cast("double").alias("ymin"), (i % 50 + 1).cast("double").alias("xmax"), (i % 20 + 2).cast("double").alias("ymax"),
        "added", F.when(~gone & (moved | sold), at(26)).alias("updated"), F.when(gone, at(25)).alias("archived"),
    )


def _refreshed_twice(spark, d):
    stored = catalogue.Catalogue(spark, tables.work_path(spark, "catalogue"))
    stored.refresh(_datasets(spark, d, False), now=dt.datetime(2024, 1, 21))
    return stored, stored.refresh(_datasets(spark, d, True), now=dt.datetime(2024, 2, 10))


@query("refresh_two_runs", _cell_sql(f"SELECT * FROM ({_AFTER}) WHERE NOT gone"))
def _(spark, d):
    """Cells after a refresh of early datasets and a second one that takes what has changed since."""
    return _cell_rows(_refreshed_twice(spark, d)[0].cells())


@query(
    "refresh_positions",
    f"""WITH b AS (SELECT * FROM ({_AFTER})), n AS (SELECT product, count(*) AS n FROM b WHERE changed >= TIMESTAMP '2024-01-21' GROUP BY 1)
        SELECT product, 'updated' AS result, n::BIGINT AS changed, TIMESTAMP '2024-02-10' AS last_refresh, max(added) AS newest_added, min(center_time) FILTER (NOT gone) AS time_earliest, max(center_time) FILTER (NOT gone) AS time_latest, count(*) FILTER (NOT gone)::BIGINT AS dataset_count
        FROM b JOIN n USING (product) GROUP BY 1, 3""",
)
def _(spark, d):
    """What the second run did to each product, and where it left them; what the overlap reads again hasn't changed."""
    stored, result = _refreshed_twice(spark, d)
    return result.join(stored.products(), "product").select("product", "result", "changed", "last_refresh", "newest_added", "time_earliest", "time_latest", "dataset_count")


@query("changes_in_any_order", _cell_sql(f"SELECT * FROM ({_AFTER}) WHERE NOT gone"))
def _(spark, d):
    """Changes in batches that go back in time, some of them twice: old states after new ones, archivals before the datasets."""
    stored = catalogue.Catalogue(spark, tables.work_path(spark, "catalogue"))
    after, before = _datasets(spark, d, True), _datasets(spark, d, False)
    batches = [after.where("pmod(id, 2) = 0"), before, after.where("pmod(id, 2) = 1").unionByName(before.where("pmod(id, 3) = 0")), after.where("pmod(id, 5) = 0")]
    for k, batch in enumerate(batches):
        stored.apply(batch, f"batch-{k}", now=dt.datetime(2024, 2, 10))
    return _cell_rows(stored.cells())


@query("fields_projection", f"""SELECT id, '{{"id":"' || id || '","properties":{{"odc:product":"' || product || '","odc:region_code":"' || region_code || '"}}}}' AS item FROM {_EVENTS}""")
def _(spark, d):
    return stac.projected(m.events(spark, d), ["id", "no.such", "properties.odc:product", "properties.odc:region_code"])


@query("stream_refresh", f"SELECT product, date_trunc('month', center_time + {_DARWIN})::DATE AS month, count(*)::BIGINT AS dataset_count FROM {_EVENTS} GROUP BY 1, 2")
def _(spark, d):
    """Month cells kept by a stream that reads the events as dataset changes."""
    from eocatalog.streaming.refresh import StreamingRefresh

    raw = spark.readStream.schema(m.read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    none = F.lit(None).cast("timestamp_ntz")
    changes = raw.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("product"), F.col("ts").alias("center_time"), F.col("ts").alias("creation_time"), F.col("value").alias("size_bytes"), F.col("ts").alias("added"), none.alias("updated"), none.alias("archived"))
    path = tables.work_path(spark, "stream")
    stream = StreamingRefresh(spark, path)
    stream.start(changes, f"{path}/progress").awaitTermination()
    return stream.cells().select("product", "month", "dataset_count")


@query("cell_lookup", f"SELECT dataset_count, size_bytes FROM ({_ROLLUP}) WHERE product = '1-URGENT' AND period_type = 'month' AND start_day = DATE '1996-03-01'")
def _(spark, d):
    kind, start = times.encode_period(1996, 3)
    cells = _orders_rollup(spark, d)
    return cells.where((F.col("product") == "1-URGENT") & (F.col("period_type") == kind) & (F.col("start_day") == F.lit(start))).select("dataset_count", "size_bytes")


@query("complete_products", "SELECT DISTINCT p_brand AS product FROM part WHERE p_size > 45")
def _(spark, d):
    part = m.read(spark, d, "part")
    cells = part.where("p_size > 45").select(F.col("p_brand").alias("product"), F.lit("all").alias("period_type"))
    return facts.complete_products(part.select(F.col("p_brand").alias("product")).distinct(), cells)


@query("active_scan", f"SELECT id, product FROM {_EVENTS} WHERE product = 'view' AND NOT (id::BIGINT % 4 = 0)")
def _(spark, d):
    e = m.events(spark, d).withColumn("archived", F.when(F.col("id").cast("long") % 4 == 0, F.col("added")))
    return extents.active(e, "view").select("id", "product")


@query("data_sizes", "SELECT doc_id AS id, CASE WHEN n_chars >= 1073741824 THEN printf('%.1f GiB', n_chars / 1073741824.0) WHEN n_chars >= 1048576 THEN printf('%.1f MiB', n_chars / 1048576.0) WHEN n_chars >= 1024 THEN printf('%.1f KiB', n_chars / 1024.0) ELSE printf('%d B', n_chars) END AS size FROM documents")
def _(spark, d):
    docs = m.read(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), texts.data_size(F.col("n_chars")).alias("size"))


# --- sources, sinks and reference systems


@query("documents_written_and_read", f"SELECT id, product, strftime(center_time, '%Y-%m-%dT%H:%M:%SZ') AS time, CASE WHEN product IN ('click', 'view') THEN (id::BIGINT % 50 / 2)::DOUBLE ELSE id::BIGINT % 50 + 1 END AS number FROM {_EVENTS} WHERE product IN ('click', 'error', 'purchase', 'view')")
def _(spark, d):
    """Documents of both dialects, written as files of many YAML documents each, a file for each task, and read from these."""
    path = tables.work_path(spark, "documents")
    docs = _both_dialects(spark, d)
    named = docs.withColumn("doc", F.concat(F.expr("left(doc, length(doc) - 1)"), F.lit(',"product":"'), F.col("product"), F.lit('"}')))
    formats.write(named, path, compressed=True)
    at = lambda *p: F.coalesce(*(F.get_json_object("doc", x) for x in p))
    return formats.read(spark, path).select("id", at("$.product").alias("product"), at("$.properties.datetime", "$.extent.from_dt").alias("time"), at("$.properties['eo:cloud_cover']", "$.image.path").cast("double").alias("number"))


@query("srid_dictionary", "SELECT s_suppkey AS id, (CASE s_suppkey % 7 WHEN 4 THEN NULL WHEN 6 THEN CASE WHEN s_nationkey % 2 = 0 AND s_nationkey >= 10 THEN 1000 + s_nationkey WHEN s_nationkey % 2 = 1 THEN 4326 END ELSE 1000 + s_nationkey END)::INTEGER AS srid FROM supplier")
def _(spark, d):
    """Numbers of systems that are named by code, text, name, zone, or not at all, from a dictionary made of nations."""
    nation = m.read(spark, d, "nation")
    code = F.col("n_nationkey") + 32600
    zone = F.col("n_nationkey") >= 10
    entries = nation.select((F.col("n_nationkey") + 1000).cast("int").alias("srid"), F.lit("EPSG").alias("auth_name"), code.alias("auth_srid"), F.initcap(F.lower("n_name")).alias("name"), F.concat(F.lit("zone text "), F.col("n_nationkey")).alias("text"))
    zones = nation.where(zone).select((F.col("n_nationkey") + 1000).cast("int").alias("srid"), F.lit("EPSG").alias("auth_name"), (F.col("n_nationkey") + 28300).alias("auth_srid"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("text"))
    k, n = F.col("s_suppkey") % 7, F.col("s_nationkey")
    told = m.read(spark, d, "supplier").join(nation, n == F.col("n_nationkey"))
    own = F.when(k == 0, F.concat(F.lit("EPSG:"), n + 32600)).when(k == 1, F.concat(F.lit(" epsg: "), n + 32600)).when(k == 2, F.concat(F.lit('PROJCS["zone",AUTHORITY["EPSG","'), n + 32600, F.lit('"]]')))
    own = own.when(k == 3, F.col("n_name")).when(k == 4, F.concat(F.lit("EPSG:99"), n)).when(k == 5, F.concat(F.lit("Zone Text "), n))
    by_zone = (k == 6) & (n % 2 == 0)
    rows = told.select(F.col("s_suppkey").alias("id"), own.alias("reference"), F.when(by_zone, "GDA94").alias("datum"), F.when(by_zone, (-n).cast("string")).alias("zone"))
    return systems.with_srid(rows, systems.dictionary(entries.unionByName(zones)), "reference", "datum", "zone", 4326).select("id", "srid")


@query("url_field_filters", f"SELECT id FROM {_EVENTS} WHERE size_bytes BETWEEN 20 AND 60.5 AND product = 'view' AND region_code::INTEGER >= 12 AND center_time <= TIMESTAMP '2024-01-20 10:00:00'")
def _(spark, d):
    e = m.events(spark, d)
    columns = {"size": F.col("size_bytes"), "kind": F.col("product"), "user": F.col("region_code").cast("int"), "time": F.struct(F.col("center_time").alias("begin"), F.col("center_time").alias("end"))}
    args = {"size-begin": "60.5", "size-end": "20", "kind": "view", "user-begin": "12", "user-end": "", "time-end": "2024-01-20T10:00:00Z"}
    return e.where(search.url_filters(args, columns, {"size": "double", "kind": "string", "user": "integer", "time": "datetime-range"})).select("id")


@query("documents_as_text", f"""SELECT id, '# EO1 Dataset\n# url: /dataset/' || id || '.yaml\nid: d' || id || '\nsize_bytes: ' || id || '\nextent:\n  a: 1.0e-10\nlineage:\n  machine: m\n  source_datasets: {{}}\nzoo:\n- 1\n- 2.5\n' AS text FROM {_EVENTS}""")
def _(spark, d):
    """Documents as they are shown: in order, with comments above."""
    doc = F.concat(F.lit('{"zoo":[1,2.5],"lineage":{"source_datasets":{},"machine":"m"},"extent":{"a":1e-10},"size_bytes":'), F.col("id"), F.lit(',"id":"d'), F.col("id"), F.lit('"}'))
    return formats.texts(_dealt(spark, d).select("id", doc.alias("doc")), "/dataset/{id}.yaml")


@query(
    "product_listing",
    f"""WITH live AS (SELECT * FROM ({_AFTER}) WHERE NOT gone)
        SELECT product, count(*)::BIGINT AS dataset_count, sum(size_bytes)::BIGINT AS size_bytes, min(center_time) AS first_time, max(center_time) AS last_time, count(DISTINCT region_code)::BIGINT AS regions, count(DISTINCT srid)::BIGINT AS systems,
               count(DISTINCT date_trunc('month', center_time + {_DARWIN}))::BIGINT AS months, TIMESTAMP '2024-02-10' AS last_refresh FROM live GROUP BY 1""",
)
def _(spark, d):
    stored, _ = _refreshed_twice(spark, d)
    return facts.product_listing(stored.cells(), stored.products())


@query(
    "region_collections",
    f"""WITH r AS (SELECT product, region_code, count(*) AS n FROM {_EVENTS} GROUP BY 1, 2)
        SELECT product, '{{"type":"FeatureCollection","features":[' || string_agg('{{"type":"Feature","id":"' || region_code || '","geometry":{{"coordinates":[' || region_code || ',1],"type":"Point"}},"properties":{{"count":' || n || ',"label":"Region ' || region_code || '","region_code":"' || region_code || '"}}}}', ',' ORDER BY region_code) || ']}}' AS collection FROM r GROUP BY 1""",
)
def _(spark, d):
    counts = agg.region_histogram(m.events(spark, d))
    place = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("region_code"), F.lit(",1]}"))
    return items.region_collection(counts.select("product", "region_code", "n", F.concat(F.lit("Region "), "region_code").alias("label"), place.alias("geometry")))
