"""How catalogue concepts are found in the test tables.

events are datasets of a month (product: event_type, region: user_id), orders datasets of years (product: priority),
embeddings footprints (bounding box: the first four numbers, reference system: label), lineitem lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("product"),
        F.col("ts").alias("center_time"),
        F.col("ts").alias("creation_time"),
        F.col("ts").alias("added"),
        F.col("user_id").cast("string").alias("region_code"),
        F.col("value").alias("size_bytes"),
        F.col("props").alias("doc"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("product"), F.col("o_orderdate").alias("center_time"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("region_code"), F.col("o_totalprice").alias("size_bytes"))


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("srid"), F.least(v(0), v(2)).alias("xmin"), F.least(v(1), v(3)).alias("ymin"), F.greatest(v(0), v(2)).alias("xmax"), F.greatest(v(1), v(3)).alias("ymax"))
