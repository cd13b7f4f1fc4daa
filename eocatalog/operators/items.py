"""Items of datasets from documents of both dialects, and collections and catalogues that lead to them.

Both dialects are read into the same Columns (label, properties, assets, sources); properties keep the types that a document
gives them. What stands in JSON is put together at the end, a row each; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eocatalog.functions import fields, texts
from eocatalog.operators import stac

#: Names of properties in items, of those that documents name otherwise.
ITEM_NAMES = {
    "dtr:start_datetime": "start_datetime", "dtr:end_datetime": "end_datetime", "eo:platform": "platform", "eo:instrument": "instruments", "eo:constellation": "constellation",
    "eo:gsd": "gsd", "eo:off_nadir": "view:off_nadir", "eo:azimuth": "view:azimuth", "eo:sun_azimuth": "view:sun_azimuth", "eo:sun_elevation": "view:sun_elevation",
    "odc:processing_datetime": "created",
}
_ENTRY = "struct<key:string,value:struct<path:string,layer:string>>"
_ASSET = "map<string,struct<href:string,title:string,type:string,roles:array<string>,`eo:bands`:array<struct<name:string>>>>"
_PROPERTIES = "map<string,variant>"


def _variant(value: Column) -> Column:
    return value.cast("variant")


def _entries(doc: Column, path: list[str]) -> Column:
    """The named files of a section of a document."""
    found = F.from_json(fields.json_path(doc, path), "map<string,struct<path:string,layer:string>>")
    return F.filter(F.coalesce(F.map_entries(found), F.array().cast(f"array<{_ENTRY}>")), lambda e: e["value"]["path"].isNotNull())


def _asset(entry: Column, uri: Column, role: Column, band: bool) -> Column:
    path = entry["value"]["path"]
    href = texts.web_url(F.coalesce(texts.resolve(uri, path), path))
    bands = F.array(F.struct(entry["key"].alias("name"))) if band else F.lit(None).cast("array<struct<name:string>>")
    return F.struct(entry["key"].alias("key"), F.struct(href.alias("href"), entry["key"].alias("title"), stac.media_type(path).alias("type"), F.array(role).alias("roles"), bands.alias("eo:bands")).alias("value"))


def _assets(measured: Column, extra: Column, uri: Column) -> Column:
    """Assets by name; a name that both have is the measurement's."""
    taken = F.transform(measured, lambda e: e["key"])
    data = F.transform(measured, lambda e: _asset(e, uri, F.lit("data"), True))
    more = F.transform(F.filter(extra, lambda e: ~F.array_contains(taken, e["key"])), lambda e: _asset(e, uri, F.when(e["key"].startswith("thumbnail"), "thumbnail").otherwise("metadata"), False))
    return F.map_from_entries(F.concat(data, more)).cast(_ASSET)


def _renamed(properties: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ITEM_NAMES.items() for x in pair])
    return F.transform_keys(properties, lambda k, _: F.coalesce(F.try_element_at(names, k), k))


def _newer(doc: Column, uri: Column) -> dict[str, Column]:
    found = F.coalesce(F.try_variant_get(F.try_parse_json(doc), "$.properties", _PROPERTIES), F.create_map().cast(_PROPERTIES))
    told = F.map_filter(found, lambda k, v: ~F.is_variant_null(v))
    # instruments are a list in items
    listed = F.transform_values(told, lambda k, v: F.when(k == "eo:instrument", F.to_variant_object(F.split(F.lower(v.cast("string")), "_"))).otherwise(v))
    kinds = F.map_entries(F.from_json(fields.json_path(doc, ["lineage"]), "map<string,array<string>>"))
    return {
        "label": fields.json_path(doc, ["label"]),
        "properties": _renamed(listed),
        "assets": _assets(_entries(doc, ["measurements"]), _entries(doc, ["accessories"]), uri),
        "sources": F.flatten(F.transform(kinds, lambda e: F.coalesce(e["value"], F.array().cast("array<string>")))),
    }


def _older(doc: Column, uri: Column, metadata_type: dict, product: dict) -> dict[str, Column]:
    """Properties of an older document by its fields; files by its measurements, browse images and checksum."""
    own = fields.compile_fields(doc, metadata_type)
    told: list[tuple[str, Column]] = []
    if "platform" in own:
        told.append(("platform", F.replace(F.lower(own["platform"]), F.lit("_"), F.lit("-"))))
    if "instrument" in own:
        told.append(("instruments", F.array(F.lower(own["instrument"]))))
    for name, kind in (("sat_path", "landsat:wrs_path"), ("sat_row", "landsat:wrs_row")):
        if name in own:
            ranged = "min_offset" in metadata_type["dataset"]["search_fields"][name]
            begin, end = (own[name]["begin"], own[name]["end"]) if ranged else (own[name], own[name])
            single = end.isNull() | (begin == end)
            told += [(kind, F.when(single, begin.cast("int"))), (f"odc:{name}", F.when(~single, F.array(begin.cast("int"), end.cast("int"))))]
    as_variant = lambda v, key: F.to_variant_object(v) if key in ("instruments", "odc:sat_path", "odc:sat_row") else _variant(v)
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.when(v.isNotNull(), as_variant(v, k)).alias("value")) for k, v in told)) if told else F.array().cast("array<struct<key:string,value:variant>>")
    browse = F.transform(_entries(doc, ["browse"]), lambda e: F.struct(F.concat(F.lit("thumbnail:"), e["key"]).alias("key"), e["value"].alias("value")))
    checksum = fields.json_path(doc, ["checksum_path"])
    sums = F.when(checksum.isNotNull(), F.array(F.struct(F.lit("checksum:sha1").alias("key"), F.struct(checksum.alias("path"), F.lit(None).cast("string").alias("layer")).alias("value"))))
    label = fields.json_path(doc, metadata_type["dataset"].get("label") or ["ga_label"])
    return {
        "label": label,
        "properties": F.map_filter(F.map_from_entries(entries), lambda k, v: v.isNotNull()),
        "assets": _assets(_entries(doc, metadata_type["dataset"].get("measurements") or ["image", "bands"]), F.concat(browse, F.coalesce(sums, F.array().cast(f"array<{_ENTRY}>"))), uri),
        "sources": F.array().cast("array<string>"),
    }


def described(datasets: DataFrame, definitions: list[tuple[dict, dict]]) -> DataFrame:
    """datasets(id, product, doc, uri, ...) with label, properties, assets and sources, in one pass over all products.

    Each row is read as its product's type says. Documents that can't be read have no properties, assets or
    sources; those of products without a definition neither. A dataset without a label has its file's, else its id.
    """
    doc, uri = F.col("doc"), F.col("uri")
    by_type: dict[str, tuple[dict, dict, list[str]]] = {}
    for metadata_type, product in definitions:
        by_type.setdefault(metadata_type["name"], (metadata_type, product, []))[2].append(product["name"])
    cases = [(F.col("product").isin(names), _newer(doc, uri) if fields.is_eo3(t) else _older(doc, uri, t, p)) for t, p, names in by_type.values()]
    none = {"properties": F.create_map().cast(_PROPERTIES), "assets": F.create_map().cast(_ASSET), "sources": F.array().cast("array<string>")}
    out = {}
    for name in ("label", "properties", "assets", "sources"):
        found = F.lit(None)
        for is_own, read in cases:
            found = F.when(is_own, read[name]).otherwise(found)
        out[name] = texts.dataset_label(found.cast("string"), uri, F.col("id")) if name == "label" else F.coalesce(found, none[name])
    return datasets.withColumns(out)


def items(placed: DataFrame, root: str = "") -> DataFrame:
    """id, product, item: the whole item of each dataset, of rows that have been placed (job.placed) and described.

    geometry is the dataset's own outline; datasets without a place have neither geometry nor bbox.
    """
    link = lambda rel, href, kind="application/json", title=None: F.struct(F.lit(rel).alias("rel"), href.alias("href"), F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), (F.lit(None).cast("string") if title is None else title).alias("title"))
    collection_at = F.concat(F.lit(f"{root}/collections/"), F.col("product"))
    links = F.array(link("self", F.concat(collection_at, F.lit("/items/"), F.col("id")), "application/geo+json"), link("collection", collection_at), link("root", F.lit(f"{root}/")))
    sources = F.transform("sources", lambda i: link("derived_from", F.concat(F.lit(f"{root}/dataset/"), i)))
    document = F.when(F.col("uri").isNotNull(), F.array(link("canonical", texts.web_url(F.col("uri")), F.when(F.col("uri").endswith("json"), "application/json").otherwise("text/yaml"))))
    links = F.concat(links, sources, F.coalesce(document, F.array().cast("array<struct<rel:string,href:string,type:string,title:string>>")))
    always = {"datetime": _variant(stac.iso(F.col("center_time"))), "created": _variant(stac.iso(F.col("creation_time"))), "title": _variant(F.col("label")), "cubedash:region_code": _variant(F.col("region_code")), "odc:product": _variant(F.col("product"))}
    given = F.map_filter("properties", lambda k, _: ~k.isin(*always))
    own = F.map_filter(F.create_map(*[x for k, v in always.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    properties = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(own, given)), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    here = F.col("xmin").isNotNull()
    whole = F.struct(
        F.lit("Feature").alias("type"), F.lit(stac.STAC_VERSION).alias("stac_version"), F.col("id"), F.col("product").alias("collection"),
        F.when(here, stac.box_array()).alias("bbox"), F.when(here, F.try_parse_json("outline")).alias("geometry"), properties.alias("properties"), links.alias("links"), F.col("assets"),
    )
    return placed.select("id", "product", F.to_json(whole, {"ignoreNullFields": "true"}).alias("item"))


def collections(cells: DataFrame, products: DataFrame, root: str = "", default_licence: str | None = None) -> DataFrame:
    """product, collection: one document a product, of the cells of all time (see cells.roll_up).

    products(product, title, description, licence). A product without a cell, or without a place, has the whole
    world as its extent; a child stands for each month with datasets.
    """
    whole = cells.where("period_type = 'all'").select("product", "begin", "end", "xmin", "ymin", "xmax", "ymax", "timeline")
    at = F.concat(F.lit(f"{root}/collections/"), F.col("product"))
    link = lambda rel, href, title=None: F.struct(F.lit(rel).alias("rel"), href.alias("href"), (F.lit(None).cast("string") if title is None else title).alias("title"))
    months = F.array_sort(F.array_distinct(F.transform(F.filter("timeline", lambda d: (d.n > 0) & d.key.isNotNull()), lambda d: F.trunc(d.key, "month"))))
    month_at = lambda d: F.concat(F.lit(f"{root}/catalogs/"), F.col("product"), F.lit("/"), F.date_format(d, "yyyy-M"))
    children = F.coalesce(F.transform(months, lambda d: link("child", month_at(d), F.date_format(d, "yyyy-MM"))), F.array().cast("array<struct<rel:string,href:string,title:string>>"))
    links = F.concat(F.array(link("root", F.lit(f"{root}/")), link("self", at), link("items", F.concat(at, F.lit("/items"))), link("http://www.opengis.net/def/rel/ogc/1.0/queryables", F.concat(at, F.lit("/queryables")))), children)
    world = F.array(*(F.lit(v) for v in (-180.0, -90.0, 180.0, 90.0)))
    box = F.when(F.col("xmin").isNotNull(), stac.box_array()).otherwise(world)
    extent = F.struct(F.struct(F.array(box).alias("bbox")).alias("spatial"), F.struct(F.array(F.array(stac.iso(F.col("begin")), stac.iso(F.col("end")))).alias("interval")).alias("temporal"))
    doc = F.struct(
        F.lit("Collection").alias("type"), F.lit(stac.STAC_VERSION).alias("stac_version"), F.col("product").alias("id"), F.coalesce("title", "product").alias("title"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce(F.col("licence"), F.lit(default_licence), F.lit("various")).alias("license"), extent.alias("extent"), links.alias("links"),
    )
    return products.join(whole, "product", "left").select("product", F.to_json(doc).alias("collection"))


def month_page(labelled: DataFrame, cells: DataFrame, product: str, year: int, month: int, tz_bounds: tuple, limit: int = stac.MONTH_PAGE, after: tuple | None = None, root: str = "") -> DataFrame:
    """One row: the catalogue page of a product's month, with a link to each item and to the next page.

    labelled(id, product, center_time, label). A page begins after the key (center time, id) of the page before, so late
    pages cost what early ones do; only limit + 1 rows leave their tasks. A month without a cell gives no row.
    """
    begin, end = (F.lit(t.replace(tzinfo=None)).cast("timestamp_ntz") for t in tz_bounds)
    t = F.col("center_time")
    rows = labelled.where((F.col("product") == product) & (t >= begin) & (t < end))
    if after is not None:
        from_ = F.lit(after[0]).cast("timestamp_ntz")
        rows = rows.where((t > from_) | ((t == from_) & (F.col("id") > after[1])))
    some = rows.orderBy("center_time", "id").limit(limit + 1).select("id", "center_time", "label")
    page = some.agg(F.array_sort(F.collect_list(F.struct("center_time", "id", "label"))).alias("rows"))
    cell = cells.where((F.col("product") == product) & (F.col("period_type") == "month") & (F.col("start_day") == F.make_date(F.lit(year), F.lit(month), F.lit(1)))).select("dataset_count")
    shown = F.slice("rows", 1, limit)
    here = f"{root}/catalogs/{product}/{year}-{month}"
    link = lambda rel, href, title=None: F.struct(F.lit(rel).alias("rel"), href.alias("href"), (F.lit(None).cast("string") if title is None else title).alias("title"))
    last = F.get(shown, F.size(shown) - 1)
    following = F.concat(F.lit(f"{here}?after="), stac.iso(last.center_time), F.lit(","), last.id)
    links = F.concat(F.array(link("self", F.lit(here))), F.transform(shown, lambda r: link("item", F.concat(F.lit(f"{root}/collections/{product}/items/"), r.id), r.label)), F.when(F.size("rows") > limit, F.array(link("next", following))).otherwise(F.array().cast("array<struct<rel:string,href:string,title:string>>")))
    day = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    doc = F.struct(
        F.lit("Catalog").alias("type"), F.lit(stac.STAC_VERSION).alias("stac_version"), F.lit(f"{product}-{year}-{month}").alias("id"), F.concat(F.lit(f"{product} for "), F.date_format(day, "MMMM yyyy")).alias("description"),
        links.alias("links"), F.size(shown).alias("numberReturned"), F.col("dataset_count").alias("numberMatched"),
    )
    return cell.crossJoin(page).select(F.to_json(doc).alias("catalogue"))  # one row beside one


def month_pages(labelled: DataFrame, tz: str, limit: int = stac.MONTH_PAGE) -> DataFrame:
    """product, month, page, first_time, first_id, n: where the pages of all months begin, for catalogues that are written out."""
    from eocatalog.operators.cells import month_of

    rows = labelled.select("product", month_of(tz).alias("month"), "center_time", "id")
    at = F.row_number().over(W.partitionBy("product", "month").orderBy("center_time", "id")) - 1
    paged = rows.withColumn("page", F.floor(at / limit).cast("int"))
    first = F.min(F.struct("center_time", "id"))
    return paged.groupBy("product", "month", "page").agg(first.alias("f"), F.count(F.lit(1)).alias("n")).select("product", "month", "page", F.col("f.center_time").alias("first_time"), F.col("f.id").alias("first_id"), "n")


def arrivals_catalogue(root: str = "") -> dict:
    """The virtual catalogue of what was indexed last."""
    here = f"{root}/catalogs/arrivals"
    return {"type": "Catalog", "stac_version": stac.STAC_VERSION, "id": "arrivals", "title": "Dataset Arrivals", "description": "The most recently added Items to this index", "links": [{"rel": "root", "href": f"{root}/"}, {"rel": "self", "href": here}, {"rel": "items", "href": f"{here}/items"}]}


def arrivals_page(added: DataFrame, made: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """added, id, item of the newest limit + 1 datasets, the newest first; the last one only shows that more follow.

    added(id, added) are chosen first, so items(id, item) are put together for those alone. A page begins after the key
    (added, id) of the one before.
    """
    rows = added.select("id", "added")
    if after is not None:
        t = F.lit(after[0]).cast("timestamp_ntz")
        rows = rows.where((F.col("added") < t) | ((F.col("added") == t) & (F.col("id") > after[1])))
    some = rows.orderBy(F.desc_nulls_last("added"), "id").limit(limit + 1)
    return made.join(F.broadcast(some), "id").select("added", "id", "item").orderBy(F.desc_nulls_last("added"), "id")  # limit + 1 rows


def footprint_features(cells: DataFrame) -> DataFrame:
    """product, period_type, start_day, feature: each cell as GeoJSON, its box as the place; those without one have none."""
    part = lambda kinds, value: F.when(F.col("period_type").isin(*kinds), value)
    spec = F.array(part(("year", "month", "day"), F.year("start_day")), part(("month", "day"), F.month("start_day")), part(("day",), F.dayofmonth("start_day")))
    properties = F.struct("dataset_count", F.col("product").alias("product_name"), spec.alias("time_spec"), stac.iso(F.col("begin")).alias("begin"), stac.iso(F.col("end")).alias("end"))
    feature = F.struct(F.lit("Feature").alias("type"), F.when(F.col("xmin").isNotNull(), stac.box_geometry()).alias("geometry"), properties.alias("properties"))
    return cells.select("product", "period_type", "start_day", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def region_collection(regions: DataFrame) -> DataFrame:
    """product, collection: a feature collection of a product's regions (region_code, n, label, geometry as GeoJSON text).

    A product's regions are bounded in number, as its cells' histograms are.
    """
    properties = F.struct(F.col("n").alias("count"), F.col("label"), F.col("region_code"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("region_code").alias("id"), F.try_parse_json("geometry").alias("geometry"), properties.alias("properties"))
    text = F.to_json(feature)
    listed = regions.where(F.col("geometry").isNotNull()).groupBy("product").agg(F.array_sort(F.collect_list(F.struct("region_code", text.alias("f")))).alias("fs"))
    return listed.select("product", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("fs.f", ","), F.lit("]}")).alias("collection"))
