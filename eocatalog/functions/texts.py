"""String columns: file labels, common prefixes, readable sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File names that say nothing of the dataset, so its folder does.
GENERIC_NAMES = ("ga-metadata.yaml", "agdc-metadata.yaml", "ARD-METADATA.yaml")


def common_prefix(low: Column, high: Column) -> Column:
    """The longest common prefix of the smallest and largest string, so of all between."""
    n = F.least(F.char_length(low), F.char_length(high))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    same = F.filter(places, lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i))
    return F.substring(low, F.lit(1), F.size(same))


def directory_prefix(prefix: Column) -> Column:
    """Cut after the last slash; nothing without one."""
    return F.regexp_extract(prefix, "^(.*/)", 1)


def file_label(uri: Column) -> Column:
    """The last part of a path that says something, without a document's ending; null if none does.

    Parts are looked at from the end: the last three, then all before them as one.
    """
    parts = F.split(uri, "/")
    n = F.size(parts)
    rest = F.array_join(F.slice(parts, 1, F.greatest(n - 3, F.lit(0))), "/")
    some = F.array(*(F.get(parts, n - k) for k in (1, 2, 3)), rest)
    telling = F.get(F.filter(some, lambda x: (x != "") & ~x.isin(*GENERIC_NAMES)), F.lit(0))
    return F.regexp_replace(telling, r"(^|\.)(yaml|json)$", "")


def shared_prefix(low: Column, high: Column) -> Column:
    """What the smallest and largest address, and so all between, begin with: the address itself if they are one, else a folder."""
    return F.when(low == high, low).otherwise(directory_prefix(common_prefix(low, high)))


def dataset_label(label: Column, uri: Column, id_: Column) -> Column:
    """The label field, else the file's label, else the id."""
    named = lambda x: F.when(x != "", x)
    return F.coalesce(named(label), named(file_label(uri)), id_)


def data_size(size: Column) -> Column:
    """Bytes in the largest binary unit that leaves at least one, with one decimal."""
    out = F.format_string("%.0f B", size.cast("double"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        out = F.when(F.abs(size) >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(size / float(1024**power), 1))).otherwise(out)
    return F.when(size.isNull(), None).otherwise(out)


def only_alphanumeric(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9]+", "-")


def web_url(uri: Column) -> Column:
    """s3 addresses as https ones; the rest as it is."""
    return F.when(uri.startswith("s3://"), F.regexp_replace(uri, "^s3://([^/]+)/", "https://$1.s3.amazonaws.com/")).otherwise(uri)


def external_url(uri: Column, region: str = "ap-southeast-2", data_locations: dict[str, str] | None = None, is_base: bool = False) -> Column:
    """s3 addresses as those that a browser opens; the rest as it is.

    A bucket in data_locations is shown by the site that serves it; with is_base as the listing of the address's folder.
    """
    bucket, path = F.regexp_extract(uri, "^s3://([^/]+)/", 1), F.regexp_replace(uri, "^s3://[^/]+/", "")
    out = F.concat(F.lit("https://"), bucket, F.lit(f".s3.{region}.amazonaws.com/"), path)
    for own, site in (data_locations or {}).items():
        shown = F.concat(F.lit("?prefix="), F.regexp_extract(path, "^(.*/)", 1)) if is_base else path
        out = F.when(bucket == own, F.concat(F.lit(f"https://{site}/"), shown)).otherwise(out)
    return F.when(bucket != "", out).otherwise(uri)


def resolve(base: Column, relative: Column) -> Column:
    """A relative path against the folder of base; full addresses stay."""
    return F.when(relative.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), relative).otherwise(F.concat(directory_prefix(base), relative))


def area_km2(square_metres: Column) -> Column:
    """Square metres as whole square kilometres with separators."""
    return F.concat(F.format_number(F.bround(square_metres / 1e6), 0), F.lit(" km2"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, None).otherwise(F.format_string("%.2f%%", F.bround(100.0 * part / whole, 2)))
