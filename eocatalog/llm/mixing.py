"""Mixing sources to target weights by Poisson replication.

Each document gets a uniform number from a hash of the seed and its id, the Poisson
distribution with its source's repetition rate as mean is inverted at that number, the document
is exploded by the count, and a hash of seed, id and copy number deals all copies out anew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eocatalog.llm import _common as c

#: 13 hexadecimal digits make 52 bits, which a double holds exactly.
_DIGITS, _SPAN = 13, 2.0**52
#: Rates up to this are summed from 0.
_FROM_ZERO = 700.0


def _digest(*parts: Column) -> Column:
    return F.md5(F.encode(F.concat_ws(":", *parts), "UTF-8"))


def _uniform(seed: int, id_: Column) -> Column:
    """In (0, 1): the middle of one of 2**52 cells."""
    head = F.substring(_digest(F.lit(str(seed)), id_), 1, _DIGITS)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / _SPAN


def poisson_quantile(u: Column, rate: Column) -> Column:
    """The smallest k with P(X <= k) >= u for a Poisson X of mean rate.

    The sum starts at 0, or, for a rate past _FROM_ZERO, for which exp(-rate) nears the smallest double, at
    rate - 12 * sqrt(rate) - 40: what lies below is less than 1e-30. It stops at rate + 12 * sqrt(rate) + 40, past
    which no double below 1 - 2**-53 lies.
    """
    reach = 12 * F.sqrt(rate) + 40
    low, top = F.when(rate > _FROM_ZERO, F.floor(rate - reach)).otherwise(0).cast("int"), F.ceil(rate + reach).cast("int")
    # ln P(X = k) by Stirling's series, with the large terms taken together
    k = low.cast("double")
    log_p = (k - rate) - k * F.log1p((k - rate) / rate) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k)
    first = F.when(rate > _FROM_ZERO, F.exp(log_p)).otherwise(F.exp(-rate))
    zero = F.struct(first.alias("p"), first.alias("cdf"), low.alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        more = acc["cdf"] < u
        return F.struct(F.when(more, p).otherwise(acc["p"]).alias("p"), F.when(more, acc["cdf"] + p).otherwise(acc["cdf"]).alias("cdf"), F.when(more, i).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.sequence(low + 1, top), zero, step, lambda acc: acc["k"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, rate: how often each document of a source is repeated on average.

    The target share of a source is its given weight (sources without one get 0), or, without
    weights, its share of characters to the power temperature. The rates keep the total size:
    rate = target share * all characters / the source's characters. A source without
    characters has rate 1.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.char_length(F.coalesce(F.col(text_col), F.lit("")))).cast("double").alias("chars"))
    if weights is None:
        weight = F.pow("chars", F.lit(temperature))
    else:
        given = [F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in weights.items()]
        weight = F.coalesce(*given, F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    sizes = c.materialise(sizes, "source-sizes")
    totals = sizes.agg(F.sum("chars").alias("chars"), F.sum("weight").alias("weight")).first()
    all_chars, all_weight = F.lit(totals.chars), F.lit(totals.weight)
    rate = F.when((F.col("chars") == 0) | (all_weight == 0), 1.0).otherwise(F.col("weight") / all_weight * all_chars / F.col("chars"))
    return sizes.select("source", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The copies of docs in a random global order, with ``_copy`` (from 1) and ``_order`` added.

    Partitions hold copies by hash, each sorted by ``_order``; read in turn they are a random
    permutation. A null source is a source of its own. A null id is hashed as the empty string;
    rows that share an id are repeated equally often. An empty table stays empty. Extra columns are
    carried along; ones named like an added column are replaced.
    """
    rates = c.materialise(source_rates(docs, weights, temperature, source_col, text_col), "rates")
    names = c.carried(docs, ["_copy", "_order"])
    rows = docs.select(F.struct(*[docs[n] for n in names]).alias("row"), F.col(source_col).alias("_source"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"))
    rated = rows.join(rates, rows["_source"].eqNullSafe(rates["source"]))
    count = poisson_quantile(_uniform(seed, F.col("_id")), F.col("rate"))
    copies = rated.withColumn("_n", count).where("_n > 0").select("row", "_id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    order = _digest(F.lit(f"{seed}/order"), F.col("_id"), F.col("_copy").cast("string"))
    dealt = copies.withColumn("_order", order).repartition(F.col("_order")).sortWithinPartitions("_order")
    return dealt.select(*[F.col("row").getField(n).alias(n) for n in names], "_copy", "_order")


def query(spark, sf_dir: str) -> DataFrame:
    out = mix(c.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("_copy").alias("copy"), F.col("_order").alias("order_key"), "text")


ORACLE = r"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source),
totals AS (SELECT sum(chars) AS all_chars, sum(pow(chars, 0.5)) AS all_weight FROM sizes),
rates AS (
  SELECT source, CASE WHEN chars = 0 THEN 1.0 ELSE pow(chars, 0.5) / all_weight * all_chars / chars END AS rate
  FROM sizes, totals),
rated AS (
  SELECT doc_id, d.source, text, rate,
         (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
walk AS (
  SELECT doc_id, u, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rated
  UNION ALL
  SELECT doc_id, u, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM walk WHERE cdf < u),
counts AS (SELECT doc_id, max(k) AS n FROM walk GROUP BY doc_id)
SELECT r.doc_id, r.source, i::INTEGER AS copy,
       md5('17/order:' || coalesce(r.doc_id::VARCHAR, '') || ':' || i::VARCHAR) AS order_key, r.text
FROM rated r JOIN counts c ON r.doc_id IS NOT DISTINCT FROM c.doc_id, unnest(range(1, c.n + 1)) AS t(i)
"""
