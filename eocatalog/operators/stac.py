"""Items, pages, collections and GeoJSON, as JSON text in DataFrames or as dicts on the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eocatalog.functions import texts

STAC_VERSION = "1.0.0"
MONTH_PAGE = 500


def iso(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def box_array() -> Column:
    return F.array("xmin", "ymin", "xmax", "ymax")


def box_geometry() -> Column:
    p = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"), p("xmin", "ymin"))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def geometry_of(extents: DataFrame) -> Column:
    if "outline" not in extents.columns:
        return box_geometry()
    return F.coalesce(F.try_parse_json("outline"), F.parse_json(F.to_json(box_geometry())))


def features(extents: DataFrame) -> DataFrame:
    """id, feature: a GeoJSON feature of each extent that has a place: its outline (GeoJSON text), or its box where it has none."""
    properties = F.struct(iso(F.col("center_time")).alias("datetime"), F.col("product").alias("odc:product"), F.col("region_code").alias("odc:region_code"))
    whole = F.struct(F.lit("Feature").alias("type"), F.col("id"), box_array().alias("bbox"), geometry_of(extents).alias("geometry"), properties.alias("properties"))
    return extents.where(F.col("xmin").isNotNull()).select("id", F.to_json(whole).alias("feature"))


#: Media types of files by their ending.
MEDIA_TYPES = {"tif": "image/tiff; application=geotiff", "tiff": "image/tiff; application=geotiff", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "json": "application/json", "geojson": "application/geo+json", "yaml": "text/yaml", "yml": "text/yaml", "txt": "text/plain", "xml": "application/xml", "html": "text/html", "h5": "application/x-hdf5", "nc": "application/x-netcdf"}


def media_type(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair]), lambda k, _: k == ending)), F.lit(0))


def _asset(entry: Column, uri: Column, role: Column) -> Column:
    path = entry["value"]["path"]
    href = texts.web_url(F.coalesce(texts.resolve(uri, path), path))
    return F.struct(entry["key"].alias("key"), F.struct(href.alias("href"), entry["key"].alias("title"), media_type(path).alias("type"), F.array(role).alias("roles")).alias("value"))


def _measured(uri: Column):
    return lambda entry: _asset(entry, uri, F.lit("data"))


def _accessory(uri: Column):
    return lambda entry: _asset(entry, uri, F.when(entry["key"].startswith("thumbnail"), "thumbnail").otherwise("metadata"))


def assets(doc: Column, uri: Column) -> Column:
    """name to {href, title, type, roles} of a document's measurements and accessories, addresses resolved against uri."""
    out = []
    for section, measured in (("measurements", True), ("accessories", False)):
        found = F.from_json(F.get_json_object(doc, f"$.{section}"), "map<string,struct<path:string>>")
        named = F.filter(F.coalesce(F.map_entries(found), F.array().cast("array<struct<key:string,value:struct<path:string>>>")), lambda e: e["value"]["path"].isNotNull())
        out.append(F.transform(named, _measured(uri) if measured else _accessory(uri)))
    # a name in both sections is the measurement's
    measured, extra = out
    taken = F.transform(measured, lambda e: e["key"])
    return F.map_from_entries(F.concat(measured, F.filter(extra, lambda e: ~F.array_contains(taken, e["key"]))))


def lineage_links(doc: Column, root: str = "") -> Column:
    """A derived_from link for each source in a document's lineage, by kind of source."""
    kinds = F.map_entries(F.from_json(F.get_json_object(doc, "$.lineage"), "map<string,array<string>>"))
    ids = F.flatten(F.transform(kinds, lambda e: F.coalesce(e["value"], F.array().cast("array<string>"))))
    return F.coalesce(F.transform(ids, lambda i: F.struct(F.lit("derived_from").alias("rel"), F.concat(F.lit(f"{root}/dataset/"), i).alias("href"))), F.array().cast("array<struct<rel:string,href:string>>"))


def items(extents: DataFrame, extra: dict[str, Column] | None = None, root: str = "", doc: str | None = None, uri: str | None = None) -> DataFrame:
    """id, item: a STAC item of each extent, its properties taken from Columns.

    With the names of the columns of documents and addresses, items have assets, links to their sources and
    a canonical link to the document itself.
    """
    properties = F.struct(iso(F.col("center_time")).alias("datetime"), iso(F.col("creation_time")).alias("created"), F.col("product").alias("odc:product"), F.col("region_code").alias("odc:region_code"), *[c.alias(n) for n, c in (extra or {}).items()])
    link = lambda rel, href: F.struct(F.lit(rel).alias("rel"), href.alias("href"))
    own = F.concat(F.lit(f"{root}/collections/"), F.col("product"), F.lit("/items/"), F.col("id"))
    links = F.array(link("self", own), link("collection", F.concat(F.lit(f"{root}/collections/"), F.col("product"))))
    found = F.create_map().cast("map<string,string>")
    if doc is not None:
        at = F.col(uri) if uri else F.lit(None).cast("string")
        found, links = assets(F.col(doc), at), F.concat(links, lineage_links(F.col(doc), root))
        links = F.concat(links, F.when(at.isNotNull(), F.array(link("canonical", texts.web_url(at)))).otherwise(F.array().cast("array<struct<rel:string,href:string>>")))
    whole = F.struct(
        F.lit("Feature").alias("type"),
        F.lit(STAC_VERSION).alias("stac_version"),
        F.col("id"),
        F.col("product").alias("collection"),
        F.when(F.col("xmin").isNotNull(), box_array()).alias("bbox"),
        F.when(F.col("xmin").isNotNull(), box_geometry()).alias("geometry"),
        properties.alias("properties"),
        links.alias("links"),
        found.alias("assets"),
    )
    return extents.select("id", F.to_json(whole, {"ignoreNullFields": "true"}).alias("item"))


def projected(extents: DataFrame, include: list[str]) -> DataFrame:
    """id, item: only the chosen ones of an item's fields, in the order given; others aren't even read."""
    known = {"id": F.col("id"), "collection": F.col("product"), "bbox": box_array() if "xmin" in extents.columns else None}
    known |= {"properties.datetime": iso(F.col("center_time")), "properties.odc:product": F.col("product"), "properties.odc:region_code": F.col("region_code")}
    chosen = [n for n in include if known.get(n) is not None]
    top = [known[n].alias(n) for n in chosen if "." not in n]
    nested = [known[n].alias(n.split(".", 1)[1]) for n in chosen if "." in n]
    whole = [*top, F.struct(*nested).alias("properties")] if nested else top
    return extents.select("id", F.to_json(F.struct(*whole)).alias("item"))


def eo1_properties(doc: Column) -> dict[str, Column]:
    """Item properties of an older document: platform, instrument, path and row (a single row under its WRS name)."""
    at = lambda *p: F.get_json_object(doc, "$" + "".join(f"['{x}']" for x in p))
    first, last = at("image", "satellite_ref_point_start", "y"), at("image", "satellite_ref_point_end", "y")
    single = F.coalesce(first == last, last.isNull())
    return {
        "platform": F.replace(F.lower(at("platform", "code")), F.lit("_"), F.lit("-")),
        "instruments": F.lower(at("instrument", "name")),
        "landsat:wrs_path": at("image", "satellite_ref_point_start", "x").try_cast("int"),
        "landsat:wrs_row": F.when(single, first.try_cast("int")),
        "odc:row_range": F.when(~single, F.concat_ws("/", first, last)),
    }


def page(rows: list[dict], limit: int, offset: int, matched: int | None, address: str, post: dict | None = None) -> dict:
    """A feature collection of up to limit items of limit + 1 that were asked for; the last shows that more follow."""
    shown = rows[:limit]
    out = {"type": "FeatureCollection", "features": shown, "numberReturned": len(shown), "context": {"page": offset // limit, "limit": limit, "returned": len(shown)}, "links": []}
    if matched is not None:
        out["numberMatched"] = out["context"]["matched"] = matched
    if len(rows) > limit:
        nxt = {"rel": "next", "href": f"{address}{'&' if '?' in address else '?'}limit={limit}&_o={offset + limit}"}
        if post is not None:
            nxt = {"rel": "next", "href": address, "method": "POST", "merge": True, "body": {"_o": offset + limit}}
        out["links"].append(nxt)
    return out


def collection(product: str, bbox, first, last, months: list[tuple[int, int, int]], licence: str | None = None) -> dict:
    """A collection document, with a child for each month that has datasets."""
    links = [{"rel": "child", "title": f"{y}-{m:02d}", "href": f"/catalogs/{product}/{y}-{m}"} for y, m, n in months if n > 0]
    return {"type": "Collection", "stac_version": STAC_VERSION, "id": product, "license": licence or "various", "extent": {"spatial": {"bbox": [list(bbox)] if bbox else []}, "temporal": {"interval": [[first, last]]}}, "links": links}


def root_catalog(products: list[str], title: str) -> dict:
    return {"type": "Catalog", "stac_version": STAC_VERSION, "id": "catalog", "title": title, "links": [{"rel": "child", "title": p, "href": f"/collections/{p}"} for p in products]}


def queryables(fields: dict[str, str]) -> dict:
    """Names and kinds of what filters may name."""
    kinds = {"double": "number", "numeric": "number", "integer": "integer", "datetime": "string"}
    return {"$schema": "https://json-schema.org/draft/2019-09/schema", "type": "object", "properties": {n: {"title": n, "type": kinds.get(k, "string")} for n, k in sorted(fields.items())}}


def region_features(counts: DataFrame, regions: DataFrame) -> DataFrame:
    """product, region_code, n and geometry where the region is known; a null region has none.

    Regions without a column product are the same for all products.
    """
    keys = [k for k in ("product", "region_code") if k in regions.columns]
    return counts.join(regions.select(*keys, "geometry"), keys).select("product", "region_code", "n", "geometry")


def timeline_json(histogram: DataFrame) -> DataFrame:
    """product, timeline: {"yyyy-mm-dd": n}, days in order; a histogram has a bounded number of days."""
    packed = histogram.groupBy("product").agg(F.array_sort(F.collect_list(F.struct(F.col("day").cast("string"), "n"))).alias("days"))
    return packed.select("product", F.to_json(F.map_from_entries("days")).alias("timeline"))


def parse_list(text) -> list[str]:
    """A list as JSON or with commas between."""
    if isinstance(text, list):
        return text
    return json.loads(text) if text.lstrip().startswith("[") else [x.strip() for x in text.split(",") if x.strip()]


def parse_bool(text) -> bool:
    if isinstance(text, bool):
        return text
    if text.lower() in ("1", "true", "on", "yes"):
        return True
    if text.lower() in ("0", "false", "off", "no"):
        return False
    raise ValueError(f"neither true nor false: {text!r}")


def parse_fields(text) -> tuple[list[str], list[str]]:
    """``a,-b,+c`` or {"include": [], "exclude": []}"""
    if isinstance(text, dict):
        return text.get("include") or [], text.get("exclude") or []
    parts = parse_list(text)
    return [p.lstrip("+ ") for p in parts if p[0] != "-"], [p[1:] for p in parts if p[0] == "-"]


def licence(product: dict, default: str | None = None) -> str | None:
    return product.get("license") or default


def to_yaml(docs: list[dict]) -> str:
    """Several documents of one file, in the order of their keys."""
    import yaml

    return "---\n" + "---\n".join(yaml.safe_dump(d, sort_keys=False) for d in docs)
