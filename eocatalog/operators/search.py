"""Searches over dataset extents: filters, order and pages.

Extents have id, product, center_time (UTC, without zone), region_code, creation_time and a bounding box in longitude
and latitude as xmin, ymin, xmax, ymax. Where they have rings, shapes are compared exactly, behind the boxes; where they have
cell (a quad key, by which stored extents are sorted), it prunes what is read. A search is one lazy plan: filters first, so they reach the
scan, then order and page. Documents are joined only if asked for.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eocatalog.functions import shapes, spatial
from eocatalog.operators import cql2

PAGE_SIZE, MAX_PAGE_SIZE = 20, 1000
API_LIMIT, API_HARD_LIMIT = 500, 4000
#: Fields of an item's frame, by which it can't be sorted.
UNSORTABLE = ("type", "stac_version", "geometry", "bbox", "links", "assets", "stac_extensions", "properties")
#: The fields that are always in an item.
DEFAULT_FIELDS = ("id", "type", "geometry", "bbox", "links", "assets", "stac_version", "stac_extensions", "collection", "properties.datetime")


class SearchError(ValueError):
    """A search that can't be answered as asked."""


@dataclass
class Search:
    ids: list[str] | None = None
    time: tuple[dt.datetime, dt.datetime] | None = None
    bbox: tuple[float, ...] | None = None
    intersects: dict | None = None
    products: list[str] = field(default_factory=list)
    region: str | None = None
    filter: object = None
    filter_lang: str | None = None
    filter_crs: str | None = None
    sortby: list[dict] = field(default_factory=list)
    order: str = "default"
    limit: int | None = None
    offset: int = 0


def naive_utc(t: dt.datetime) -> dt.datetime:
    return t.astimezone(dt.timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def _time(t: dt.datetime) -> Column:
    return F.lit(naive_utc(t)).cast("timestamp_ntz")


def time_filter(begin: dt.datetime, end: dt.datetime, column: str = "center_time") -> Column:
    """Both ends included."""
    return F.col(column).between(_time(begin), _time(end))


def region_filter(region: str, begin: dt.datetime | None = None, end: dt.datetime | None = None) -> Column:
    """Datasets of a region, within a period without both its ends."""
    out = F.col("region_code") == region
    if begin is not None:
        out = out & (F.col("center_time") > _time(begin)) & (F.col("center_time") < _time(end))
    return out


def bbox_filter(x0: float, y0: float, x1: float, y1: float) -> Column:
    """Bounding boxes that meet, edges included."""
    return (F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)


def box_filters(extents: DataFrame, x0: float, y0: float, x1: float, y1: float) -> Column:
    found = bbox_filter(x0, y0, x1, y1)
    return spatial.near(F.col("cell"), x0, y0, x1, y1) & found if "cell" in extents.columns else found


def exact_filter(extents: DataFrame):
    """What compares rows' areas with a shape; None where rows have boxes only."""
    return (lambda op, shape: spatial.predicate(op, shape, F.col("rings"))) if "rings" in extents.columns else None


def default_fields(extents: DataFrame) -> dict[str, Column]:
    """What filters and orders may name: the columns, and a few by other names."""
    fields = {n: F.col(n) for n in extents.columns}
    fields |= {a: F.col(b) for a, b in (("collection", "product"), ("datetime", "center_time"), ("created", "creation_time")) if b in extents.columns}
    return fields


def apply_filters(extents: DataFrame, search: Search, fields: dict[str, Column] | None = None) -> DataFrame:
    """An empty list of ids finds nothing; empty products filter nothing."""
    out = extents
    if search.ids is not None:
        out = out.where(F.col("id").isin(search.ids) if search.ids else F.lit(False))
    if search.products:
        out = out.where(F.col("product").isin(search.products))
    if search.time:
        out = out.where(time_filter(*search.time))
    if search.bbox:
        if len(search.bbox) not in (4, 6):
            raise SearchError("bbox has 4 or 6 numbers")
        b = search.bbox
        out = out.where(box_filters(extents, *(b if len(b) == 4 else (b[0], b[1], b[3], b[4]))))
    exact = exact_filter(extents)
    if search.intersects:
        out = out.where(box_filters(extents, *shapes.envelope(search.intersects)))
        if exact:
            out = out.where(exact("s_intersects", search.intersects))
    if search.region is not None:
        out = out.where(F.col("region_code") == search.region)
    if search.filter_crs and not re.search(r"(?i)(crs/OGC/[0-9.]+/CRS84|(^|[:/])4326)$", search.filter_crs):
        raise SearchError(f"filters are in longitude and latitude, not in {search.filter_crs}")
    if search.filter:
        bounds = tuple(F.col(n) for n in ("xmin", "ymin", "xmax", "ymax")) if "xmin" in extents.columns else None
        filter_ = cql2.strip_prefixes(search.filter) if isinstance(search.filter, str) else search.filter
        out = out.where(cql2.compile_filter(filter_, fields or default_fields(extents), bounds, search.filter_lang, exact))
    return out


def sort_columns(sortby: list[dict], fields: dict[str, Column]) -> list[Column]:
    """Nulls last ascending and first descending; a direction other than asc is descending; unknown fields don't sort."""
    out = []
    for s in sortby:
        name = cql2.strip_prefixes(s["field"])
        if name in UNSORTABLE:
            raise SearchError(f"can't sort by {name}")
        if name in fields:
            out.append(fields[name].asc_nulls_last() if s.get("direction", "asc").lower() == "asc" else fields[name].desc_nulls_first())
    return out


def parse_sortby(text: str) -> list[dict]:
    """``-a,+b,c``"""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    return [{"field": p.lstrip("+-"), "direction": "desc" if p[0] == "-" else "asc"} for p in parts]


def ordered(out: DataFrame, search: Search, fields: dict[str, Column]) -> DataFrame:
    keys = sort_columns(search.sortby, fields)
    if search.sortby:
        return out.orderBy(*keys, F.col("id").asc()) if keys else out
    if search.order == "default":
        return out.orderBy(F.col("center_time").asc_nulls_last(), F.col("id").asc())
    if search.order == "recent":
        if "added" not in out.columns:
            raise SearchError("the order by time of arrival needs whole datasets")
        return out.orderBy(F.col("added").desc_nulls_first(), F.col("id").asc())
    return out


def page_size(limit: int | None) -> int:
    if limit is None or limit < 1:
        return PAGE_SIZE
    if limit > MAX_PAGE_SIZE:
        raise SearchError(f"a page has at most {MAX_PAGE_SIZE} items")
    return limit


def api_limit(limit: int | None) -> int:
    return min(limit or API_LIMIT, API_HARD_LIMIT)


def search(extents: DataFrame, request: Search, fields: dict[str, Column] | None = None) -> DataFrame:
    """The rows of one page, and one more where there is a next page."""
    fields = fields or default_fields(extents)
    out = ordered(apply_filters(extents, request, fields), request, fields)
    if request.offset:
        out = out.offset(request.offset)
    return out.limit(page_size(request.limit) + 1)


def hard_limited(datasets: DataFrame, request: Search, limit: int) -> DataFrame:
    """Up to limit + 1 of the rows found, whatever their number: the first by time, and one that shows that more follow."""
    found = apply_filters(datasets, request)
    return found.orderBy(F.col("center_time").asc_nulls_last(), F.col("id").asc()).limit(limit + 1)


def normalised(args: dict) -> dict:
    """Query arguments as they are compared: maturity in lower case."""
    name = "dataset_maturity"
    return {**args, name: args[name].lower()} if isinstance(args.get(name), str) else dict(args)


def matched(extents: DataFrame, request: Search) -> int:
    return apply_filters(extents, request).count()


def after(extents: DataFrame, last_time: dt.datetime, last_id: str) -> DataFrame:
    """Rows past a page's last in the default order, without counting an offset off."""
    t = F.col("center_time")
    return extents.where((t > _time(last_time)) | ((t == _time(last_time)) & (F.col("id") > last_id)))


def by_region(extents: DataFrame, product: str, region: str, begin=None, end=None, limit: int = 50, offset: int = 0) -> DataFrame:
    found = extents.where((F.col("product") == product) & region_filter(region, begin, end))
    return found.orderBy(F.col("center_time").desc_nulls_last(), F.col("id").asc()).offset(offset).limit(limit)


def products_for_region(extents: DataFrame, region: str, begin=None, end=None, limit: int = 50, offset: int = 0) -> DataFrame:
    return extents.where(region_filter(region, begin, end)).select("product").distinct().orderBy("product").offset(offset).limit(limit)


def item(extents: DataFrame, id_: str) -> DataFrame:
    """The item, or two rows where an id isn't unique."""
    return extents.where(F.col("id") == id_).limit(2)


def field_predicate(column: Column, low=None, high=None, exact=None) -> Column:
    """``field``, or ``field-begin`` and ``field-end`` with a reversed range swapped and open ends open."""
    if exact is not None:
        return column == F.lit(exact)
    if low is not None and high is not None and high < low:
        low, high = high, low
    out = F.lit(True)
    if low is not None:
        out = out & (column >= F.lit(low))
    return out & (column <= F.lit(high)) if high is not None else out


def chosen_fields(include: list[str] | None, exclude: list[str] | None) -> tuple[set[str], set[str]]:
    """Include beats exclude, and what every item has stays unless excluded by name."""
    inc, exc = set(include or ()), set(exclude or ()) - set(include or ())
    if inc or not exclude:
        inc |= set(DEFAULT_FIELDS) - exc
    return inc, exc


def prune(item_: dict, include: list[str] | None, exclude: list[str] | None) -> dict:
    """An item with the chosen fields only; what it lacks is left out."""
    if not include and not exclude:
        return item_
    inc, exc = chosen_fields(include, exclude)
    out: dict = {} if inc else _copy(item_)
    for path in inc:
        _move(item_, out, path.split("."))
    for path in exc:
        node, *rest = [out, *path.split(".")]
        for p in rest[:-1]:
            node = node.get(p, {}) if isinstance(node, dict) else {}
        if isinstance(node, dict):
            node.pop(rest[-1], None)
    return out


def _copy(x):
    return {k: _copy(v) for k, v in x.items()} if isinstance(x, dict) else x


def _move(source, target, path):
    for p in path[:-1]:
        if not isinstance(source, dict) or p not in source:
            return
        source, target = source[p], target.setdefault(p, {})
    if isinstance(source, dict) and path[-1] in source:
        target[path[-1]] = _copy(source[path[-1]])


def field_groups(args: dict[str, object]) -> dict[str, dict[str, object]]:
    """Arguments of an address by field: ``lat-begin=1&lat-end=2&orbit=3``; empty values are left out."""
    out: dict[str, dict[str, object]] = {}
    for name, value in args.items():
        field_name, *rest = name.split("-")
        if len(rest) > 1:
            raise SearchError(f"not a field: {name!r}")
        if value not in (None, ""):
            out.setdefault(field_name, {})[rest[0] if rest else "val"] = value
    return out


_PARSERS = {"integer": int, "double": float, "numeric": float, "datetime": lambda x: naive_utc(dt.datetime.fromisoformat(str(x).replace("Z", "+00:00"))), "string": str}


def url_filters(args: dict[str, object], columns: dict[str, Column], kinds: dict[str, str]) -> Column:
    """A filter of an address's arguments, each read as its field's kind (integer, datetime-range, ...).

    A field of a kind with ranges is a struct of begin and end: it is found by a value within it, or by a range that it meets.
    A range in the wrong order is turned round, open ends are open. SearchError for a field that there isn't, a word after the
    dash other than begin and end, and a value that can't be read.
    """
    out = F.lit(True)
    for name, given in field_groups(args).items():
        if name not in columns or name not in kinds:
            raise SearchError(f"no field {name!r}")
        kind, _, ranged = kinds[name].partition("-range")
        ranged = kinds[name].endswith("-range")
        if unknown := set(given) - {"val", "begin", "end"}:
            raise SearchError(f"{name} has no {', '.join(sorted(unknown))}")
        try:
            read = {k: _PARSERS.get(kind, str)(v) for k, v in given.items()}
        except ValueError as error:
            raise SearchError(f"{name}: {error}") from error
        lit = lambda v: F.lit(v).cast("timestamp_ntz") if isinstance(v, dt.datetime) else F.lit(v)
        low, high = (read["val"], read["val"]) if "val" in read else (read.get("begin"), read.get("end"))
        if low is not None and high is not None and high < low:
            low, high = high, low
        first, last = (columns[name]["begin"], columns[name]["end"]) if ranged else (columns[name], columns[name])
        if low is not None:
            out = out & (last >= lit(low))
        if high is not None:
            out = out & (first <= lit(high))
    return out
