"""Quality rules: line-first cleaning, in DataFrame functions only.

Punctuation, navigation and boilerplate rules are evaluated on each line, the lines that fail are
removed, and a document that loses too much of its text with them is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eocatalog.llm import _common as c

#: Phrases of page furniture and licence notices, lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept all cookies",
    "we use cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "terms and conditions",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "click here to",
    "skip to content",
    "share this page",
    "back to top",
)
#: Characters that separate the entries of menus and breadcrumbs.
SEPARATORS = "|<>"
#: Markup and decoration that prose hardly uses.
SYMBOLS = "#*$%&|<>"


def _count(text: Column, chars: str) -> Column:
    """How many characters of text are in chars."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _with_repeat_words(rows: DataFrame) -> DataFrame:
    """rows with _n_repeat_words: how many words of ``ws`` lie in five-word windows found twice or more.

    Windows compare by 64-bit hash. Each array is a column of its own, for an expression inside a
    lambda would be evaluated again for each element. Only texts with equal windows are sorted.
    """
    n = F.size("ws")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("ws", i, 5)))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("windows", windows)
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(none))
    at = lambda k: F.get("placed", k)["h"]  # noqa: E731  null beyond the ends
    twice = F.filter("placed", lambda x, k: F.coalesce(x["h"] == at(k - 1), F.lit(False)) | F.coalesce(x["h"] == at(k + 1), F.lit(False)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.transform("starts", lambda x, k: F.least(F.lit(5), F.coalesce(F.get("starts", k + 1) - x, F.lit(5))))
    return rows.withColumn("_n_repeat_words", F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long"))


def _line_fails(line: Column, max_symbol_share: float, max_separators: int) -> Column:
    """The line rules; a line without words never fails.

    Punctuation: more than max_symbol_share symbols for each word. Navigation: at least
    max_separators menu separators and no sentence inside (a full stop, question or exclamation
    mark before a space). Boilerplate: one of the phrases.
    """
    low = c.ascii_lower(line)
    n_words = F.size(c.words(line))
    symbols, separators = _count(line, SYMBOLS), _count(line, SEPARATORS)
    decorated = symbols > max_symbol_share * n_words
    menu = (separators >= max_separators) & ~line.rlike("[.?!] +[^|<> ]+ +[^|<> ]+ ")
    furniture = low.rlike("|".join(BOILERPLATE))
    return (n_words > 0) & (decorated | menu | furniture)


def assess(docs: DataFrame, max_lost: float = 0.3, max_symbol_share: float = 0.2, max_separators: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its counts, ``_cleaned`` text, ``_base_failed`` and ``_kept``.

    A document fails the base rules with under ten words, or when over a fifth of its words lie in
    repeated five-word windows. Otherwise it is rejected when its failing lines hold more than
    max_lost of its word characters. A null or empty text has no words and fails. Ids are not
    looked at, so null and repeated ids change nothing. Extra columns are
    carried along; ones named like an added column are replaced.
    """
    added = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_kept_chars", "_base_failed", "_kept", "_cleaned"]
    names = c.carried(docs, added)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[docs[n] for n in names]).alias("row"), text.alias("t"))
    rows = rows.withColumn("ws", c.words(F.col("t"))).withColumn("lines", F.split("t", "\n"))
    full = F.filter("lines", lambda x: c.strip(x) != "")
    rows = _with_repeat_words(rows).select(
        "row", "t", "lines",
        F.size("ws").cast("long").alias("_n_words"), F.char_length(F.array_join("ws", "")).cast("long").alias("_word_chars"),
        _count(F.col("t"), SYMBOLS).cast("long").alias("_n_symbols"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("_n_dup_lines"),
        "_n_repeat_words",
    )
    rows = rows.withColumn("good", F.filter("lines", lambda x: ~_line_fails(x, max_symbol_share, max_separators)))
    rows = rows.withColumn("_cleaned", F.array_join("good", "\n"))
    rows = rows.withColumn("_kept_chars", F.char_length(F.regexp_replace("_cleaned", c.WHITE_RE, "")).cast("long"))
    rows = rows.withColumn("_base_failed", (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words")))
    enough = F.col("_kept_chars") >= (1 - max_lost) * F.col("_word_chars")
    rows = rows.withColumn("_kept", ~F.col("_base_failed") & enough)
    # the generator keeps later filters from being pushed into these expressions, and evaluated anew there
    return rows.select(F.inline(F.array(F.struct(*[F.col("row").getField(n).alias(n) for n in names], *added))))


def query(spark, sf_dir: str) -> DataFrame:
    out = assess(c.table(spark, sf_dir, "documents").select("doc_id", "text"))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars", "base_failed", "kept"]
    return out.select("doc_id", *[F.col(f"_{n}").alias(n) for n in added])


ORACLE = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM base WHERE len(ws) >= 5),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM windows),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
numbers AS (
  SELECT doc_id, lines, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines
  FROM base),
cleaned AS (
  SELECT doc_id, list_filter(lines, lambda x: NOT (
      len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) > 0 AND (
        length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) > 0.2 * len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> ''))
        OR (length(regexp_replace(x, '[^|<>]+', '', 'g')) >= 3 AND NOT regexp_matches(x, '[.?!] +[^|<> ]+ +[^|<> ]+ '))
        OR regexp_matches(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(BOILERPLATE)}')))) AS good
  FROM base),
together AS (
  SELECT n.doc_id, n_words, word_chars, n_symbols,
         (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(array_to_string(good, chr(10)), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS kept_chars
  FROM numbers n JOIN cleaned c USING (doc_id) LEFT JOIN repeats r USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars >= (1 - 0.3) * word_chars AS kept
FROM together
"""
