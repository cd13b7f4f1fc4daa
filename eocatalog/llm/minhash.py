"""MinHash near-dedup with tensored banding.

Two collections of half keys are computed for each document, each half key from a few minhashes. A
table key joins one half key of either collection, so m + m half keys make m * m table keys, and the
minhashes needed are about the square root of what separate tables would need.

Documents with equal shingle sets are one class. Class representatives that share a table key are
gathered around the smallest of them, in blocks of bounded size, and every pair in a group is compared
on its full shingle sets; a task sends only the links that join what was apart.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eocatalog.llm import _common as c
from eocatalog.llm._chunks import in_parts
from eocatalog.llm._links import components, star_links

#: Words and their bytes in memory per worker process; past that the table starts anew (a cache, not a limit).
CACHED_WORDS, CACHED_BYTES = 500_000, 30_000_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_word_hashes: dict | None = None


class _WordHashes(dict):
    size = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        self.size += len(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    Words are the runs without ASCII white space, A-Z lower-cased; fewer than width words are one
    shingle, no words are none. Words hash by xxh3 and shingles by a polynomial of these, so two
    different shingles fall together about once in 2**64 pairs.
    """
    global _word_hashes
    out = []
    for text in texts:
        if _word_hashes is None or len(_word_hashes) > CACHED_WORDS or _word_hashes.size > CACHED_BYTES:
            _word_hashes = _WordHashes()
        ws = text.lower().split() if text else []  # of bytes: A-Z, and \x20 \x09-\x0D
        h = np.fromiter(map(_word_hashes.__getitem__, ws), np.uint64, len(ws))
        n = len(h) - width + 1
        if not len(h):
            out.append(h)
            continue
        take = width if n > 0 else len(h)
        acc = np.full(max(n, 1), take, np.uint64)
        for k in range(take):
            acc = _mix(acc * _M1 + h[k : k + len(acc)])
        acc.sort()
        out.append(acc[np.concatenate([[True], acc[1:] != acc[:-1]])])
    return out


def half_keys(sets: list[np.ndarray], halves: int, per_half: int) -> np.ndarray:
    """2 * halves keys for each set that isn't empty, each from per_half minhashes."""
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    high = (flat >> np.uint64(32)) | np.uint64(1)
    keys = np.empty((len(sets), 2 * halves), np.uint64)
    salts = _mix(np.arange(1, 2 * halves * per_half + 1, dtype=np.uint64) * _M1) | np.uint64(1)
    for j in range(2 * halves):
        key = np.full(len(sets), j, np.uint64)
        for i in range(per_half):
            salt = salts[j * per_half + i]
            # multiply-shift: the high half of a product with an odd number
            values = ((flat * salt + high * (salt >> np.uint64(7))) >> np.uint64(32)).astype(np.uint32)
            key = _mix(key * _M1 + np.minimum.reduceat(values, starts).astype(np.uint64))
        keys[:, j] = key
    return keys


def signatures(docs: DataFrame, width: int, halves: int, per_half: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, fp_a, fp_b (of the set), halves (array of half keys) of every row."""

    def sign(batches):
        import pyarrow as pa

        for part in in_parts(batches, rows=512, chars=2_000_000):
            sets = shingle_sets(part.column(1).to_pylist(), width)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            starts = np.cumsum(sizes[sizes > 0]) - sizes[sizes > 0]
            fp = np.zeros((2, len(sets)), np.uint64)
            keys = np.zeros((len(sets), 2 * halves), np.uint64)
            if full:
                flat = np.concatenate(full)
                for k, salt in enumerate((_M2, _M3)):
                    fp[k, sizes > 0] = np.add.reduceat(_mix(flat ^ salt), starts)
                keys[sizes > 0] = half_keys(full, halves, per_half)
            offsets = np.arange(len(sets) + 1, dtype=np.int32) * (2 * halves)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), arrays], ["doc_id", "n_shingles", "fp_a", "fp_b", "halves"])

    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_col, "UTF-8").alias("text"))
    return pair.mapInArrow(sign, "doc_id long, n_shingles long, fp_a long, fp_b long, halves array<long>")


def _table_keys(reps: DataFrame, halves: int) -> DataFrame:
    """key, rep for each of the halves * halves tables."""
    first = F.slice("halves", 1, halves)
    second = F.slice("halves", halves + 1, halves)
    pairs = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a, b))))
    return reps.select(F.explode(pairs).alias("key"), "rep")


def linked_pairs(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Positions of pairs, first of side 0 and second of either, with 100 * |A and B| >= percent * |A or B|.

    Intersections are counted for all pairs at once, a slice of the shingles at a time, over shingles
    that at least two of the sets hold.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        linked = 100 * both >= percent * (sizes.sum() - both)
        return np.array([[0, 1]] if linked else [], np.int64).reshape(-1, 2)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes.astype(np.int64))
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float64)
    step = max(64, 2_000_000 // n)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        dense = np.zeros((n, min(step, width - at)), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        common += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = np.triu(100 * common >= percent * union, 1)
    linked &= (side[:, None] == 0) | (side[None, :] == 0)
    return np.argwhere(linked)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, halves: int = 12, per_half: int = 3, block_shingles: int = 60_000, block_sets: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Rows link when 100 times the intersection of their shingle sets is at least percent times the union;
    component_id is the smallest id reachable, and kept says that it is the row's own. Rows without
    words have an empty set and link with nothing. A row with a null id links with nothing, has no
    component_id and is kept. Rows that share an id count as one document, which links with all that any of
    them links with, so they have one component_id; keep_one tells rows apart.
    The defaults miss a pair at the threshold about once in 2700 and copies never. A group of n different
    near copies takes n * n / 2 comparisons, spread over tasks by blocks of about
    block_shingles shingles or block_sets sets.
    """
    found = c.materialise(signatures(docs, width, halves, per_half, id_col, text_col), "signatures")
    full = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    set_key = ["fp_a", "fp_b", "n_shingles"]
    reps = c.materialise(full.groupBy(*set_key).agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves")), "classes")

    # groups: the representatives that share a key with the smallest representative of that key
    keys = _table_keys(reps, halves)
    shared = keys.groupBy("key").agg(F.min("rep").alias("group"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "group")
    members = keys.join(c.materialise(shared, "table-keys"), "key").groupBy("group", "rep").agg(F.lit(1).alias("_")).select("group", "rep")
    sized = c.materialise(members.join(reps.select("rep", "n_shingles"), "rep"), "members")
    blocks = sized.groupBy("group").agg(F.ceil(F.greatest(F.sum("n_shingles") / block_shingles, F.count(F.lit(1)) / block_sets)).cast("int").alias("n_blocks"))
    blocked = sized.select("group", "rep").join(c.materialise(blocks, "blocks"), "group")
    own = F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")
    tiles = blocked.withColumn("own", own).select("group", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    tiles = tiles.select("rep", "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    # full sets of the representatives in question only
    wanted = c.materialise(sized.select("rep").distinct(), "wanted")

    def full_sets(batches):
        import pyarrow as pa

        for part in in_parts(batches, rows=512, chars=2_000_000):
            sets = [s.tobytes() for s in shingle_sets(part.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["rep", "shingles"])

    pair = docs.select(F.col(id_col).cast("long").alias("rep"), F.encode(text_col, "UTF-8").alias("text"))
    sets = pair.join(wanted, "rep", "left_semi").mapInArrow(full_sets, "rep long, shingles binary")

    def compare(table):
        import pyarrow as pa

        ids = table.column("rep").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        side = table.column("side").to_numpy()
        if i != j:  # pairs within a block are compared where the block meets itself
            pairs = linked_pairs(ids, sets, side, percent)
            pairs = pairs[side[pairs[:, 0]] != side[pairs[:, 1]]]
        else:
            pairs = linked_pairs(ids, sets, np.zeros(len(ids)), percent)
        stars = star_links(ids, pairs)
        return pa.table({"u": pa.array([u for u, _ in stars], pa.int64()), "v": pa.array([v for _, v in stars], pa.int64())})

    tiled = tiles.join(sets, "rep").groupBy("group", "i", "j").applyInArrow(compare, "u long, v long")
    # an id with several sets links their classes
    shared_ids = c.materialise(full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "shared-ids")
    of_shared = full.join(shared_ids, "doc_id", "left_semi").join(reps.select(*set_key, "rep"), set_key).select("doc_id", "rep").distinct()
    lowest = of_shared.groupBy("doc_id").agg(F.min("rep").alias("v"))
    roots = components(tiled.unionByName(of_shared.join(lowest, "doc_id").select(F.col("rep").alias("u"), "v")))

    classes = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*set_key, F.coalesce("component", "rep").alias("component"))
    in_class = full.select("doc_id", *set_key).join(c.materialise(classes, "class-components"), set_key)
    with_id = in_class.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = found.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = with_id.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **tuning) -> DataFrame:
    """The rows of docs but for near copies: of each group the row with the smallest id stays (nulls first).

    Rows are nodes of their own here: those that share an id are linked only if their texts are near copies,
    an exactly repeated row stays once, and rows with a null id take part. Rows without words all stay.
    The columns are those of docs; one named ``_row`` is lost.
    """
    names = c.carried(docs, ["_row"])
    keyed = c.materialise(docs.select(*names, F.monotonically_increasing_id().alias("_row")), "rows")
    found = near_duplicates(keyed, width, percent, id_col="_row", text_col=text_col, **tuning)
    copies = found.where("NOT kept").select(F.col("doc_id").alias("_row"), "component_id")
    copies = c.materialise(copies.unionByName(copies.select(F.col("component_id").alias("_row"), "component_id").distinct()), "copies")
    named = copies.join(keyed.select("_row", F.col(id_col).alias("id")), "_row")
    best = named.groupBy("component_id").agg(F.min(F.struct("id", "_row"))["_row"].alias("_row"))
    gone = c.materialise(copies.select("_row").join(best, "_row", "left_anti"), "near-copies")
    c.drop(copies)
    return keyed.join(gone, "_row", "left_anti").select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents"), width=3, percent=85, halves=10, per_half=3)
