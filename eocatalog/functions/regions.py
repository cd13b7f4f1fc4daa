"""Region codes: grid tiles and satellite scenes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("region", "tile", "scene", None)


def kind_of(search_fields: dict, tile_size: dict | None) -> str | None:
    """How a product's regions are told, by what its definition has."""
    if "region_code" in search_fields:
        return "region"
    if tile_size:
        return "tile"
    return "scene" if "sat_path" in search_fields else None


def tile_code(x: Column, y: Column, size_x: float, size_y: float, origin_x: float = 0.0, origin_y: float = 0.0) -> Column:
    """The grid cell of a point; null where a coordinate is missing."""
    cell = lambda v, o, s: F.floor((v - F.lit(o)) / F.lit(s)).cast("string")
    return F.concat(cell(x, origin_x, size_x), F.lit("_"), cell(y, origin_y, size_y))


def bounds_centre(low: Column, high: Column) -> Column:
    return (low + high) / 2


def scene_code(path: Column, row_low: Column, row_high: Column) -> Column:
    """path_row; the path alone where the rows span more than one."""
    text = lambda c: c.cast("long").cast("string")
    return F.when(row_low == row_high, F.concat_ws("_", text(path), text(row_low))).otherwise(text(path))


def split_code(code: Column) -> tuple[Column, Column]:
    part = lambda i: F.regexp_extract(code, r"^(-?\d+)_(-?\d+)$", i).try_cast("int")
    return part(1), part(2)


def label(code: str, kind: str | None) -> str:
    m = re.fullmatch(r"(-?\d+)_(-?\d+)", code)
    if kind == "tile" and m:
        return f"Tile {int(m[1]):+d}, {int(m[2]):+d}"
    if kind == "scene":
        return f"Path {m[1]}, Row {m[2]}" if m else f"Path {code}"
    return code
