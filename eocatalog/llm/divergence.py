"""How far sources differ in the terms that they use, by tiles of groups over chunks of the vocabulary.

Terms are counted by language and source, in tasks first. A language keeps the terms of enough of its documents;
these fall into chunks of the vocabulary by their hash, and the counts that a source has in a chunk are packed
into one row. Sources fall into blocks by their hash. A row is copied to each tile (a pair of blocks) that its
block belongs to, and a tile works out all pairs of its two blocks chunk by chunk, with one chunk in memory.
A tile's chunks are dealt to several tasks, whose partial sums are added.

All arithmetic is in whole numbers. With count c of a kept term in a group, N its sum over kept terms and V kept
terms: p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and the divergence of p from q is floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eocatalog.llm import _common as c
from eocatalog.llm._chunks import in_parts

SCALE = 1_000_000_000
#: Terms of a chunk, and sources of a block, on average.
CHUNK_TERMS, BLOCK_SOURCES = 4096, 32
#: Chunks of a tile that one task goes through.
TASK_CHUNKS = 8
#: A packed count: a term's place in its chunk, and its count in the lower bits.
COUNT_BITS = 48

#: For each byte of UTF-8 text: itself, its lower case for A-Z, a space where it is part of no term.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def _tally(batches):
    """Occurrences and documents of each term by lang and source, for each part of a task."""
    import pyarrow as pa

    for part in in_parts(batches, rows=100_000, chars=4_000_000):
        text = part.column(2).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        folded = _FOLD[raw]
        inside = folded != 32
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        at_start = offsets[:-1][offsets[:-1] < len(raw)]
        opens[at_start] = inside[at_start]  # a text never goes on with a term of the one before
        starts = np.flatnonzero(opens)
        if not len(starts):
            continue
        kept = folded[inside]
        places = np.cumsum(inside)
        ends = np.append(places[starts][1:] - 1, len(kept))
        bounds = np.concatenate([[0], ends]).astype(np.int64)
        terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]).dictionary_encode()
        code = np.asarray(terms.indices, np.int64)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        pair = pa.StructArray.from_arrays([part.column(0), part.column(1)], ["a", "b"]).to_pylist()
        groups: dict[tuple, int] = {}
        group = np.array([groups.setdefault((x["a"], x["b"]), len(groups)) for x in pair], np.int64)
        n = len(terms.dictionary)
        once, times = np.unique(doc * n + code, return_counts=True)
        key, place = np.unique(group[once // n] * n + once % n, return_inverse=True)
        total = np.bincount(place, times, len(key)).astype(np.int64)
        names = list(groups)
        of_group = pa.array(key // n)
        lang, source = (pa.array([x[k] for x in names], pa.string()).take(of_group) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([lang, source, terms.dictionary.take(pa.array(key % n)).cast(pa.string()), pa.array(total), pa.array(np.bincount(place, minlength=len(key)).astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it). Nulls are empty strings; other columns are left out."""
    texts = docs.select(*(F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("lang", "source", "text")))
    return texts.mapInArrow(_tally, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 count / whole) of whole numbers with count <= whole < 9 * 10^15, three digits at a time."""
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return 1 + out


def _share(count: Column, whole: Column) -> Column:
    """The same as a Column: decimal numbers hold the product, whatever the counts."""
    exact = lambda x, digits: x.cast(f"decimal({digits},0)")
    return F.lit(1) + F.call_function("div", exact(F.lit(SCALE), 10) * exact(count, 20), exact(whole, 20))


def _distance(p: Column, q: Column) -> Column:
    """Below 10^18 + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tiles(batches):
    """Partial sums of all pairs of a tile's sources, over the chunks that a task has.

    Rows come sorted by tile and chunk; what is held is one chunk of a tile's sources, and the sums of a tile.
    """
    import pyarrow as pa

    names: dict[str, int] = {}
    sides: dict[str, int] = {}
    sums = np.zeros((0, 0), np.int64)
    tile = chunk = None
    rows: list = []

    def add() -> None:
        nonlocal sums
        if not rows:
            return
        width = rows[0][4]
        p = np.empty((len(rows), width), np.int64)
        for line, (_, _, total, packed, _) in zip(p, rows, strict=True):
            counts = np.full(width, 2, np.int64)
            counts[packed >> COUNT_BITS] += packed & ((1 << COUNT_BITS) - 1)
            line[:] = shares(counts, np.full(width, max(total, 1)))
        own = np.array([names.setdefault(r[0], len(names)) for r in rows])
        sides.update((r[0], r[1]) for r in rows)
        if len(names) > len(sums):
            larger = np.zeros((len(names), len(names)), np.int64)
            larger[: len(sums), : len(sums)] = sums
            sums = larger
        first, second = (np.flatnonzero([r[1] == side for r in rows]) for side in (tile[1], tile[2]))
        for k in first.tolist():
            others = second if tile[1] != tile[2] else second[second > k]
            step = max(1, 500_000 // max(width, 1))
            for at in range(0, len(others), step):
                some = others[at : at + step]
                gap, both = p[some] - p[k], p[some] + p[k]
                sums[own[k], own[some]] += (gap * gap // both).sum(axis=1)
        rows.clear()

    def result() -> pa.RecordBatch:
        listed = list(names)
        pairs = [(a, b) for a in range(len(listed)) for b in range(len(listed)) if a != b and sides[listed[a]] == tile[1] and sides[listed[b]] == tile[2] and (tile[1] != tile[2] or a < b)]
        value = [int(sums[a, b] + (sums[b, a] if tile[1] == tile[2] else 0)) for a, b in pairs]
        return pa.RecordBatch.from_arrays([pa.array([tile[0]] * len(pairs), pa.string()), pa.array([listed[a] for a, _ in pairs], pa.string()), pa.array([listed[b] for _, b in pairs], pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])

    for batch in batches:
        lists = batch.column(8)
        cells = np.asarray(lists.flatten(), np.int64)
        ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))
        for (lang, a, b, at, source, block, total, width), packed in zip(zip(*(x.to_pylist() for x in batch.columns[:8]), strict=True), np.split(cells, ends[:-1]), strict=True):
            if (lang, a, b) != tile or at != chunk:
                add()
                if (lang, a, b) != tile:
                    if tile is not None:
                        yield result()
                    names, sides, sums = {}, {}, np.zeros((0, 0), np.int64)
                tile, chunk = (lang, a, b), at
            rows.append((source, block, total, packed, width))
    add()
    if tile is not None:
        yield result()


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, chunk_terms: int = CHUNK_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank of all documents, as the module says.

    Part `pair`: for each source the other sources of its language with the sum over all kept terms; all of
    them. Part `term`: the terms that a source has and uses more than its language does; ranks up to top.
    Ranks begin at 1 for each source and part, the largest value first, equal values by item in UTF-8 order.

    Null texts, languages and sources are empty strings. Sources without terms are compared like all others;
    in a language without kept terms all values of pairs are 0. Repeated rows and ids count as documents of
    their own. An empty table gives no rows. Texts of any length are read whole.
    """
    if chunk_terms > 1 << 14:
        raise ValueError("places of a chunk's terms have 15 bits")
    spark = docs.sparkSession
    counts = c.materialise(count_terms(docs), "term-counts")
    groups = docs.select(*(F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("lang", "source"))).distinct()
    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = c.materialise(in_lang, "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    cells = c.materialise(counts.join(kept, ["lang", "term"]), "kept-counts")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    count = lambda name, n: F.coalesce(F.col(name), F.lit(n)).cast("long")
    sources = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    sources = sources.select("lang", "source", count("total", 0).alias("total"), count("terms", 0).alias("terms"), count("lang_total", 0).alias("lang_total"))
    sources = c.materialise(sources, "sources")

    # chunks of the vocabulary: about chunk_terms each, told by the hash of a term
    n_chunks = F.ceil(F.col("terms") / F.lit(chunk_terms))
    langs = sources.groupBy("lang").agg(F.first("terms").alias("terms"), F.count("*").alias("sources"))
    langs = langs.select("lang", F.greatest(n_chunks, F.lit(1)).cast("long").alias("chunks"), F.ceil(F.col("sources") / F.lit(block_sources)).cast("long").alias("blocks"))
    placed = kept.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks"))
    placed = placed.select("lang", "chunk", "term", (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).alias("place"))
    cell = F.shiftleft(F.col("place").cast("long"), COUNT_BITS).bitwiseOR(F.col("n"))
    packed = cells.join(placed, ["lang", "term"]).groupBy("lang", "chunk", "source").agg(F.collect_list(cell).alias("packed"))
    widths = placed.groupBy("lang", "chunk").agg(F.count("*").alias("width"))

    # each source's row of each chunk, empty where it has none of its terms, goes to all tiles of its block
    whole = sources.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    lines = whole.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    lines = lines.join(packed, ["lang", "chunk", "source"], "left").join(widths, ["lang", "chunk"], "left")
    lines = lines.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lines = lines.select(
        "lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "chunk", "source", "block",
        (F.col("total") + 2 * F.col("terms")).alias("whole"), F.coalesce("width", F.lit(0).cast("long")).alias("width"), "packed",
    )
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a tile takes more work than its bytes tell
    dealt = lines.withColumn("task", F.floor(F.col("chunk") / TASK_CHUNKS)).repartition(n_tasks, "lang", "a", "b", "task").sortWithinPartitions("lang", "a", "b", "chunk", "source").drop("task")
    half = dealt.mapInArrow(_tiles, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    with c.small_batches(spark, 200):
        half = c.materialise(half, "pairs")
    c.drop(counts, kept)
    pairs = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    p = _share(F.col("n") + 2, F.col("total") + 2 * F.col("terms")).cast("long")
    q = _share(F.col("lang_n") + 2, F.col("lang_total") + 2 * F.col("terms")).cast("long")
    own = cells.join(sources, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    terms = own.where("p > q").select("lang", "source", "item", _distance(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank.alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))


ORACLE = """
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM found GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_n FROM found GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
cells AS (SELECT c.lang, c.source, c.term, c.n, k.lang_n FROM counts c JOIN kept k USING (lang, term)),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source),
srcs AS (SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(s.v, 0) AS v, coalesce(s.lang_total, 0) AS lang_total FROM groups g LEFT JOIN totals t USING (lang, source) LEFT JOIN sizes s USING (lang)),
shares AS (SELECT s.lang, s.source, k.term, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * s.v))::HUGEINT AS p
    FROM srcs s JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
both_shares AS (SELECT c.lang, c.source, c.term AS item, 1 + (1000000000::HUGEINT * (c.n + 2)) // (s.total + 2 * s.v) AS p, 1 + (1000000000::HUGEINT * (c.lang_n + 2)) // (s.lang_total + 2 * s.v) AS q FROM cells c JOIN srcs s USING (lang, source)),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, ((p - q) * (p - q)) // (p + q), row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // (p + q) DESC, item) FROM both_shares WHERE p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def query(spark, sf_dir: str) -> DataFrame:
    return audit(c.table(spark, sf_dir, "documents"))
