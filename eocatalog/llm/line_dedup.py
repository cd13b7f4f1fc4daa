"""Line dedup: lines that many documents share stay in one document only.

Lines are exploded with their positions as 128-bit hashes of their normalised form, the distinct documents
of each hash are counted, lines over the threshold are dropped everywhere but in the document
with the largest id, and the lines that stay are put together again by position. All steps are
linear in a text's lines but for sorting the positions that it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eocatalog.llm import _common as c


def _key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b"))


def _key(line: Column) -> Column:
    return c.ascii_lower(c.strip(line))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with ``_n_lines`` (before) and ``_n_dropped``; text_col is the kept text.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of
    at least min_chars code points in at least min_docs distinct ids lose their lines except in
    the largest of those ids, where all of them stay. A null or empty text is one empty line. Rows
    with a null id count for no key and keep every line; rows that share an id count once and
    lose the same lines. Extra columns are carried along; ones named like an
    added column are replaced.
    """
    names = c.carried(docs, ["_n_lines", "_n_dropped"])
    split = lambda text: F.split(F.coalesce(text, F.lit("")), "\n")
    text = F.col("row").getField(text_col)
    # rows that share an id may have different texts, and so other positions: the text's hash tells them apart
    rows = docs.select(F.struct(*[docs[n] for n in names]).alias("row"), F.col(id_col).alias("id")).withColumn("of", F.xxhash64(text))
    keys = rows.where(F.col("id").isNotNull()).select("id", "of", F.posexplode(F.transform(split(text), _key)).alias("pos", "key"))
    spread = c.materialise(keys.where(F.char_length("key") >= min_chars).select("id", "of", "pos", _key_hash(F.col("key")).alias("h")), "lines")
    shared = spread.groupBy("h", "id").agg(F.lit(1).alias("_")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    shared = c.materialise(shared.where(F.col("n") >= min_docs).select("h", "last"), "shared-lines")
    lost = spread.join(shared, "h").where(F.col("id") < F.col("last")).groupBy("id", "of").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # one sign for each line up to the last that goes: 1 where it goes
    before = lambda p, k: F.repeat(F.lit("0"), p - F.coalesce(F.get("at", k - 1), F.lit(-1)) - 1)
    signs = F.concat(F.array_join(F.transform("at", before), "1"), F.lit("1"))
    lost = c.materialise(lost.select("id", "of", F.transform(F.split(signs, ""), lambda x: x == "1").alias("gone")), "lost-lines")
    c.drop(spread, shared)
    # whole texts go through this join once
    joined = rows.join(lost, ["id", "of"], "left").withColumn("lines", split(text))
    stays = lambda line, k: ~F.coalesce(F.get("gone", k), F.lit(False))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    out = joined.select("row", F.col("lines").alias("_lines"), kept.alias("_kept"))
    carried = [F.array_join("_kept", "\n").alias(n) if n == text_col else F.col("row").getField(n).alias(n) for n in names]
    sizes = (F.size("_lines").cast("long"), (F.size("_lines") - F.size("_kept")).cast("long"))
    return out.select(*carried, sizes[0].alias("_n_lines"), sizes[1].alias("_n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT y.*, s.last IS NOT NULL AND y.doc_id < s.last AS gone
  FROM keyed y LEFT JOIN shared s ON y.k = s.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
