"""A corpus pipeline: documents are cleaned, deduplicated, mixed and packed.

Each stage takes what its predecessor kept, whole, and all but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eocatalog.llm import _common, line_dedup, minhash, mixing, packing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't express MinHash, a hash-ordered shuffle's partitions or a tokenizer; a brute-force test stands in.
ORACLE_SQL = None


def _documents(df: DataFrame, text) -> DataFrame:
    return df.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return _documents(quality.assess(docs.select(*COLUMNS)).where("_kept"), F.col("_cleaned"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least three share, but for each line's last; nothing left: gone."""
    left = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return _documents(left.where((F.col("_n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")), F.col("text"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five words, a similarity of 0.8 or more.

    Rows are judged one by one, so rows that share an id but are no copies all stay.
    """
    return minhash.keep_one(docs.select(*COLUMNS), width=5, percent=80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, sources at the square root of their share, in random order."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("mixing sources", mix_sources),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs = _common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _common.materialise(docs, f"stage-{k + 1}")
    return docs
