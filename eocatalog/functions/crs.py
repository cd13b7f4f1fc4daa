"""EPSG codes from what documents say of their reference system."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codes that the projections know, besides the UTM and MGA zones.
KNOWN = {"EPSG:4326": 4326, "EPSG:4283": 4283, "EPSG:3577": 3577, "EPSG:6933": 6933}
#: Well-known text of the two geographic systems that unlabelled text is compared with.
GEOGRAPHIC = {
    4326: 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]],AUTHORITY["EPSG","6326"]],PRIMEM["Greenwich",0,AUTHORITY["EPSG","8901"]],UNIT["degree",0.0174532925199433,AUTHORITY["EPSG","9122"]],AUTHORITY["EPSG","4326"]]',
    4283: 'GEOGCS["GDA94",DATUM["Geocentric_Datum_of_Australia_1994",SPHEROID["GRS 1980",6378137,298.257222101,AUTHORITY["EPSG","7019"]],TOWGS84[0,0,0,0,0,0,0],AUTHORITY["EPSG","6283"]],PRIMEM["Greenwich",0,AUTHORITY["EPSG","8901"]],UNIT["degree",0.0174532925199433,AUTHORITY["EPSG","9122"]],AUTHORITY["EPSG","4283"]]',
}


def srid(reference: Column, datum: Column, zone: Column, default: int | None = None) -> Column:
    """The code named as ``EPSG:n``, or at the end of well-known text, or for a GDA94 zone, or the default."""
    named = F.regexp_extract(reference, "^[A-Za-z0-9]+:([0-9]+)$", 1).try_cast("int")
    in_text = F.regexp_extract(reference, 'AUTHORITY\\["[A-Za-z]+", ?"([0-9]+)"\\]\\]$', 1).try_cast("int")
    number = zone.try_cast("int")
    by_zone = F.when((datum == "GDA94") & number.isNotNull(), F.concat(F.lit("283"), F.abs(number).cast("string")).cast("int"))
    return F.coalesce(named, in_text, by_zone, F.lit(default).cast("int"))


def infer(text: str, least: float = 0.2) -> str | None:
    """The name of a system given by code or text; unlabelled text is the geographic system most like it."""
    if m := re.fullmatch(r"(?i)epsg:(\d+)", text.strip()):
        return f"epsg:{m[1]}"
    if m := re.search(r'AUTHORITY\["EPSG", ?"(\d+)"\]\]\s*$', text):
        return f"epsg:{m[1]}"
    scored = []
    for code, known in GEOGRAPHIC.items():
        matcher = difflib.SequenceMatcher(None, text, known, autojunk=False)
        if matcher.ratio() >= least:
            scored.append((sum(b.size for b in matcher.get_matching_blocks()), code))
    return f"epsg:{max(scored)[1]}" if scored else None


def code_of(name: str) -> int | None:
    """The number of an ``epsg:n`` name; null for other authorities."""
    m = re.fullmatch(r"(?i)epsg:(\d+)", name)
    return int(m[1]) if m else None
