"""Reference systems as a stored dimension: codes, names and well-known texts, and the number that each stands for.

entries(srid, auth_name, auth_srid, name, text) become a dictionary(key, srid) of normalised keys. What documents say of their
system is looked up by its distinct values, so the join is as large as their variety and not as the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dictionary is broadcast; a larger one is joined like any table.
BROADCAST_ROWS = 50_000


def normalised(text: Column) -> Column:
    """Lower case, without white space: ``EPSG: 4326`` and ``epsg:4326`` are one key. Null if nothing is left."""
    found = F.lower(F.regexp_replace(text, "\\s+", ""))
    return F.when(found != "", found)


def dictionary(entries: DataFrame) -> DataFrame:
    """key, srid: authority and code, name, and text of each entry. A key of several entries has the smallest number."""
    code = F.concat(F.col("auth_name"), F.lit(":"), F.col("auth_srid").cast("string"))
    keys = F.array(*(normalised(x) for x in (code, F.col("name"), F.col("text"))))
    return entries.select(F.explode(keys).alias("key"), "srid").where(F.col("key").isNotNull()).groupBy("key").agg(F.min("srid").alias("srid"))


def named_in(text: Column) -> Column:
    """``authority:code`` at the end of a well-known text."""
    found = F.regexp_extract(text, 'AUTHORITY\\["([A-Za-z]+)", ?"?([0-9]+)"?\\]\\s*\\]$', 1)
    code = F.regexp_extract(text, 'AUTHORITY\\["([A-Za-z]+)", ?"?([0-9]+)"?\\]\\s*\\]$', 2)
    return F.when(found != "", F.concat_ws(":", found, code))


def with_srid(rows: DataFrame, known: DataFrame, reference: str = "reference", datum: str | None = None, zone: str | None = None, default: int | None = None) -> DataFrame:
    """rows with srid: of the whole reference (code, name or text), else of the code at its end, else of the GDA94 zone, else default.

    A system that the dictionary doesn't have is null, like no system at all; a null reference has the default.
    """
    side = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known
    text = F.col(reference)
    number = F.col(zone).try_cast("int") if zone else F.lit(None).cast("int")
    by_zone = F.when(F.col(datum) == "GDA94", F.concat(F.lit("epsg:283"), F.abs(number).cast("string"))) if datum else F.lit(None).cast("string")
    given = [x for x in (reference, datum, zone) if x]
    distinct = rows.select(*given).distinct().select(*given, F.posexplode(F.array(normalised(text), normalised(named_in(text)), by_zone)).alias("_place", "key"))
    found = distinct.where(F.col("key").isNotNull()).join(side, "key").groupBy(*given).agg(F.min_by("srid", "_place").alias("srid"))
    found = found.select(*(F.col(x).alias(f"_{x}") for x in given), "srid")
    same = F.lit(True)
    for x in given:
        same = same & rows[x].eqNullSafe(found[f"_{x}"])
    said = F.lit(False)
    for x in given:
        said = said | F.col(x).isNotNull()
    return rows.join(found, same, "left").select(*[rows[x] for x in rows.columns], F.when(F.col("srid").isNull() & ~said, F.lit(default).cast("int")).otherwise(F.col("srid")).cast("int").alias("srid"))
