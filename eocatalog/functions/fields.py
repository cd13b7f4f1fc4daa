"""Columns for the fields of dataset documents, as a metadata type defines them.

Documents are JSON text. A field is a path, or for a range two lists of candidate paths: its
begin is the least of the begins that are there, its end the greatest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CASTS = {"string": None, "double": "double", "numeric": "decimal(38,10)", "integer": "int", "datetime": "timestamp_ntz", "double-range": "double", "numeric-range": "decimal(38,10)", "datetime-range": "timestamp_ntz"}


def json_path(doc: Column, path: list[str]) -> Column:
    """The text at a path; null for what isn't there and for a JSON null."""
    return F.get_json_object(doc, "$" + "".join(f"['{p}']" for p in path))


def as_type(value: Column, kind: str) -> Column:
    """What can't be read as the type is null."""
    cast = _CASTS[kind]
    if cast is None:
        return value
    if cast == "timestamp_ntz":
        return F.to_timestamp_ntz(F.from_utc_timestamp(value.try_cast("timestamp"), "UTC").cast("string"))
    return value.try_cast(cast)


def field(doc: Column, definition: dict) -> Column:
    kind = definition.get("type", "string")
    if "min_offset" in definition:
        ends = []
        for name, pick in (("min_offset", F.array_min), ("max_offset", F.array_max)):
            ends.append(pick(F.array(*[as_type(json_path(doc, p), kind) for p in definition[name]])))
        return F.struct(ends[0].alias("begin"), ends[1].alias("end"))
    return as_type(json_path(doc, definition["offset"]), kind)


def compile_fields(doc: Column, metadata_type: dict) -> dict[str, Column]:
    found = metadata_type["dataset"].get("search_fields", {})
    return {name: field(doc, d) for name, d in found.items() if "offset" in d or "min_offset" in d}


def searchable(metadata_type: dict, fixed: dict) -> list[str]:
    """Indexed fields that a product doesn't fix."""
    found = metadata_type["dataset"].get("search_fields", {})
    return sorted(n for n, d in found.items() if d.get("indexed", True) and n not in fixed and n != "product")


def is_eo3(metadata_type: dict) -> bool:
    return metadata_type["dataset"].get("measurements") == ["measurements"]


def merged(by_product: dict[str, dict[str, Column]]) -> dict[str, Column]:
    """Names over several products: each row reads them as its own product does."""
    names = {n for fields in by_product.values() for n in fields}
    return {n: F.coalesce(*[F.when(F.col("product") == p, fields[n]) for p, fields in by_product.items() if n in fields]) for n in names}


def file_paths(doc: Column) -> Column:
    """name to path of a document's measurements and accessories."""
    parts = [F.from_json(json_path(doc, [k]), "map<string,struct<path:string>>") for k in ("measurements", "accessories")]
    entries = [F.coalesce(F.map_entries(p), F.array().cast("array<struct<key:string,value:struct<path:string>>>")) for p in parts]
    return F.map_from_entries(F.transform(F.concat(*entries), lambda e: F.struct(e["key"], e["value"]["path"])))


def thumbnail(doc: Column) -> Column:
    paths = file_paths(doc)
    return F.coalesce(F.try_element_at(paths, F.lit("thumbnail:nbart")), F.try_element_at(paths, F.lit("thumbnail")))
