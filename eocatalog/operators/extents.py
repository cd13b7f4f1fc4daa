"""Dataset documents to extent rows.

One select for all products, made of Columns compiled from their metadata types: center time, creation time, size,
region, reference system and footprint. Values that can't be read are null and fail nothing else.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eocatalog.functions import crs, fields, regions, spatial
from eocatalog.operators import geometry

_time = lambda c: fields.as_type(c, "datetime")


def center_time(doc: Column, metadata_type: dict, own: dict[str, Column]) -> Column:
    """The document's instant, or the middle of its time range."""
    if fields.is_eo3(metadata_type):
        at = lambda name: _time(fields.json_path(doc, ["properties", name]))
        return F.coalesce(at("datetime"), at("dtr:start_datetime"))
    if "time" not in own:
        return F.lit(None).cast("timestamp_ntz")
    from eocatalog.functions import times

    return times.midpoint(own["time"]["begin"], own["time"]["end"])


def creation_time(doc: Column, metadata_type: dict, own: dict[str, Column], added: Column) -> Column:
    """The field ``created``, else the document's creation path, else when it was added."""
    path = metadata_type["dataset"].get("creation_dt")
    named = own["created"].cast("string") if "created" in own else F.lit(None).cast("string")
    written = fields.json_path(doc, path) if path else F.lit(None).cast("string")
    return F.coalesce(_time(named), _time(written), added)


def size_bytes(doc: Column, own: dict[str, Column]) -> Column:
    field = own["size_bytes"].cast("string") if "size_bytes" in own else F.lit(None).cast("string")
    return F.coalesce(field, fields.json_path(doc, ["size_bytes"])).try_cast("long")


def _spatial_path(metadata_type: dict) -> list[str] | None:
    """Where a document tells its place; None for a type that isn't spatial."""
    return metadata_type["dataset"].get("grid_spatial")


def srid(doc: Column, metadata_type: dict, default: int | None) -> Column:
    if fields.is_eo3(metadata_type):
        return crs.srid(fields.json_path(doc, ["crs"]), F.lit(None), F.lit(None), default)
    if not _spatial_path(metadata_type):
        return F.lit(None).cast("int")
    at = lambda name: fields.json_path(doc, [*_spatial_path(metadata_type), name])
    return crs.srid(at("spatial_reference"), at("datum"), at("zone"), default)


def corner(doc: Column, metadata_type: dict, name: str, axis: str) -> Column:
    if not _spatial_path(metadata_type):
        return F.lit(None).cast("double")
    return fields.json_path(doc, [*_spatial_path(metadata_type), "geo_ref_points", name, axis]).try_cast("double")


def grid_ring(doc: Column) -> Column:
    """The outline of a newer document's default grid: its four corners through the grid's affine transform."""
    number = lambda path: F.get_json_object(doc, "$.grids.default." + path).try_cast("double")
    numbers = F.array(*map(number, ("shape[0]", "shape[1]", *(f"transform[{i}]" for i in range(6)))))

    def corners(found: Column) -> Column:
        rows, cols, a, b, c, d, e, f = (F.get(found, F.lit(i)) for i in range(8))
        at = lambda x, y: F.array(a * x + b * y + c, d * x + e * y + f)
        zero = F.lit(0.0)
        return F.array(at(zero, rows), at(zero, zero), at(cols, zero), at(cols, rows), at(zero, rows))

    return spatial.let(numbers, corners)  # each number is read from the document once


def footprint_geojson(doc: Column, metadata_type: dict) -> Column:
    """The document's own outline, else its corners (newer documents: its default grid's) as a polygon, else null."""
    if fields.is_eo3(metadata_type):
        outline, ring = fields.json_path(doc, ["geometry"]), grid_ring(doc)
    elif _spatial_path(metadata_type):
        outline = fields.json_path(doc, [*_spatial_path(metadata_type), "valid_data"])
        ring = F.array(*[F.array(corner(doc, metadata_type, k, "x"), corner(doc, metadata_type, k, "y")) for k in ("ll", "ul", "ur", "lr", "ll")])
    else:
        return F.lit(None).cast("string")
    complete = lambda r: ~F.exists(F.flatten(r), lambda v: v.isNull())
    polygon = lambda r: F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(r).alias("coordinates")))
    return F.coalesce(outline, spatial.let(ring, lambda r: F.when(complete(r), polygon(r))))


def region_code(doc: Column, metadata_type: dict, product: dict, own: dict[str, Column]) -> Column:
    found = metadata_type["dataset"].get("search_fields", {})
    storage = product.get("storage") or {}
    kind = regions.kind_of(found, storage.get("tile_size"))
    if kind == "region":
        return own["region_code"]
    if kind == "tile":
        size, origin = storage["tile_size"], storage.get("origin") or {"x": 0, "y": 0}
        axis = {"x": "x" if "x" in size else "longitude", "y": "y" if "y" in size else "latitude"}
        centre = {a: regions.bounds_centre(corner(doc, metadata_type, "ll", a), corner(doc, metadata_type, "ur", a)) for a in ("x", "y")}
        return regions.tile_code(centre["x"], centre["y"], float(size[axis["x"]]), float(size[axis["y"]]), float(origin.get(axis["x"], 0)), float(origin.get(axis["y"], 0)))
    if kind == "scene":
        path, row = own["sat_path"], own.get("sat_row")
        end_of = lambda f, name, end: f[end] if "min_offset" in found[name] else f
        first = end_of(path, "sat_path", "begin")
        if row is None:
            return first.cast("long").cast("string")
        return regions.scene_code(first, end_of(row, "sat_row", "begin"), end_of(row, "sat_row", "end"))
    return F.lit(None).cast("string")


def tolerance(product: dict) -> float | None:
    """How far a simplified outline may be off: a quarter of the grid's finer resolution; None without one."""
    resolution = (product.get("storage") or {}).get("resolution")
    return min(abs(float(r)) for r in resolution.values()) / 4 if resolution else None


def read_columns(metadata_type: dict, product: dict) -> dict[str, Column]:
    """What an extent takes from a document of this type and product, but for its footprint, which is still GeoJSON text."""
    doc = F.col("doc")
    own = fields.compile_fields(doc, metadata_type)
    default = crs.code_of((product.get("storage") or {}).get("crs") or "")
    code = srid(doc, metadata_type, default)
    return {
        "center_time": center_time(doc, metadata_type, own),
        "creation_time": creation_time(doc, metadata_type, own, F.col("added")),
        "region_code": region_code(doc, metadata_type, product, own),
        "size_bytes": size_bytes(doc, own),
        "srid": code,
        "footprint": F.when(code.isNotNull(), footprint_geojson(doc, metadata_type)),
        "_tolerance": F.lit(tolerance(product)).cast("double"),
    }


def extents_of(datasets: DataFrame, definitions: list[tuple[dict, dict]]) -> DataFrame:
    """id, product, center_time, creation_time, region_code, size_bytes, srid, footprint (WKB), added of all products at once.

    datasets(id, product, doc, added, archived) are read in one pass; archived ones, and those of products without a
    definition, are left out. Products of one type and one storage share their Columns, so the plan grows with the kinds of
    documents and not with the products.
    """
    kinds: dict[str, tuple[dict, dict, list[str]]] = {}
    for metadata_type, product in definitions:
        kind = json.dumps([metadata_type, product.get("storage")], sort_keys=True, default=str)
        kinds.setdefault(kind, (metadata_type, product, []))[2].append(product["name"])
    read = [(F.col("product").isin(names), read_columns(t, p)) for t, p, names in kinds.values()]
    every = [p["name"] for _, p in definitions]
    merged = {}
    for name in read[0][1]:
        found = F.lit(None)
        for is_own, columns in read:
            found = F.when(is_own, columns[name]).otherwise(found)
        merged[name] = found
    merged["footprint"] = geometry.outline_to_wkb(merged["footprint"], merged.pop("_tolerance"))
    return datasets.where(F.col("archived").isNull() & F.col("product").isin(every)).select("id", "product", *(c.alias(n) for n, c in merged.items()), "added")


def extents(datasets: DataFrame, metadata_type: dict, product: dict) -> DataFrame:
    """The same of datasets(id, doc, added, archived) of one product."""
    return extents_of(datasets.withColumn("product", F.lit(product["name"])), [(metadata_type, product)])


def active(datasets: DataFrame, product: str | None = None) -> DataFrame:
    """Datasets that aren't archived, of one product or of all."""
    live = datasets.where(F.col("archived").isNull())
    return live if product is None else live.where(F.col("product") == product)


def upsert(old: DataFrame, new: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new, key, "left_anti").unionByName(new)


def delete_archived(old: DataFrame, archived: DataFrame) -> DataFrame:
    return old.join(archived.select("id"), "id", "left_anti")


def delete_orphans(old: DataFrame, datasets: DataFrame) -> DataFrame:
    """Only rows whose dataset is still there, under the same product."""
    return old.join(datasets.select("id", "product"), ["id", "product"], "left_semi")
