"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of coordinates. Two vectors within squared distance d of
each other are, in at least one block, within that block's part of d (parts add up to d, in proportion
to the block's share of the coordinates). For each block a range join finds the pairs within its part: a
recursion that cuts one set of vectors into slices along a coordinate, keeps for each slice those of the other
whose distance to it, added up over the coordinates so far, is within the part, and goes on with the next coordinate;
small slices are compared by their exact distance in the block. The union of the blocks' candidates is verified on
the whole vectors as they were.

Before that, vectors are dealt to tasks: by cells over those of a block's coordinates that tell vectors apart,
with a vector standing in its own cell and probing all cells that its range touches, so that few tasks see both
of two vectors that are far apart. How many pairs would meet in a coordinate's cells is counted over all vectors. Where
no coordinate of some block leaves out enough of them, as with directions spread evenly over many dimensions, cells
would send a vector to more tasks than tiles do; then any two tiles of a label meet once, in a task that joins all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eocatalog.llm import _common as c
from eocatalog.llm._links import Links, components

#: What rounding can add to a squared distance of unit vectors, with room to spare.
_SLACK = 1e-9
#: Vectors of a slice that is cut no further, rows of a leaf's matrix at once, and pairs whose vectors are taken at once.
LEAF, LEAF_MAX, PAIRS_AT_ONCE = 32, 256, 50_000


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same for each dim and seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def split(dim: int, blocks: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), max(1, min(blocks, dim)))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def range_join(homes: np.ndarray, probes: np.ndarray, budget: float, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leaves (h, p, near): near[i, j] where homes h[i] and probes p[j] lie within budget of each other, squared.

    Homes are cut into slices along one coordinate after the other, the widest spread first; a probe goes on
    with a slice while the squared distances to the slices that it went on with add up to no more than budget. A
    pair of one home and one probe is in one leaf at most, and each pair within budget is in one.
    """
    order = np.argsort(-homes.var(axis=0), kind="stable") if len(homes) else []
    step = max(np.sqrt(budget), 1e-12)
    todo = [(np.arange(len(homes)), np.arange(len(probes)), np.zeros(len(probes)), 0)]
    while todo:
        h, p, spent, depth = todo.pop()
        if not len(h) or not len(p):
            continue
        if len(h) <= leaf or depth == homes.shape[1]:
            for at in range(0, len(h), LEAF_MAX):
                some = h[at : at + LEAF_MAX]
                x, y = homes[some], probes[p]
                near = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T) <= budget
                if near.any():
                    yield some, p, near
            continue
        k = order[depth]
        x, y = homes[h, k], probes[p, k]
        by_x = np.argsort(x, kind="stable")
        h, x = h[by_x], x[by_x]
        # slices of at most one radius, none much smaller than a leaf
        parts = max(1, min(int((x[-1] - x[0]) / step) + 1, len(h) // leaf))
        cuts = np.unique(np.searchsorted(x, np.linspace(x[0], x[-1], parts + 1)[1:-1]))
        for own in np.split(np.arange(len(h)), cuts):
            if len(own):
                outside = np.maximum(np.maximum(x[own[0]] - y, y - x[own[-1]]), 0)
                total = spent + outside * outside
                keep = total <= budget
                todo.append((h[own], p[keep], total[keep], depth + 1))


def candidates(homes: np.ndarray, probes: np.ndarray, blocks: list[int], parts: list[np.ndarray], distance: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leaves of range_join over the given blocks; near leaves out pairs that lie within an earlier block's budget.

    So each pair that any block finds is looked at once, in the first block that finds it.
    """
    budget = lambda b: distance * len(parts[b]) / homes.shape[1] + _SLACK
    for b in blocks:
        for h, p, near in range_join(homes[:, parts[b]], probes[:, parts[b]], budget(b)):
            for earlier in range(b):
                i, j = np.nonzero(near)
                for at in range(0, len(i), PAIRS_AT_ONCE):
                    some = slice(at, at + PAIRS_AT_ONCE)
                    gap = homes[h[i[some]]][:, parts[earlier]] - probes[p[j[some]]][:, parts[earlier]]
                    near[i[some], j[some]] = (gap * gap).sum(axis=1) > budget(earlier)
            if near.any():
                yield h, p, near


def ranges(turned: np.ndarray, parts: list[np.ndarray], distance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each coordinate's own cell and the first and last cell that its block's range touches (at most two)."""
    radius = np.empty(turned.shape[1])
    for own in parts:
        radius[own] = np.sqrt(distance * len(own) / turned.shape[1] + _SLACK)
    scaled = turned / (2 * radius)
    return tuple(np.floor(x).astype(np.int64) for x in (scaled, scaled - 0.5, scaled + 0.5))


def _by_dim(batches, column: str):
    """Parts of batches whose vectors have one length, with the vectors and their unit vectors in double precision."""
    import pyarrow as pa

    for batch in batches:
        dims = np.asarray(batch.column(column).value_lengths())
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            plain = np.asarray(part.column(column).flatten()).reshape(-1, dim)
            yield int(dim), part, plain, _unit(plain.astype(np.float64))


def choose_cells(counts: list[tuple], blocks: int, grid: int, most: float) -> dict[int, list[list[int]]]:
    """For each dim and block the coordinates that make its cells, from (dim, coordinate, cell, homes, probes).

    These are the at most grid coordinates in whose cells the smallest shares of all pairs meet, if under most.
    """
    meet, all_ = {}, {}
    for dim, k, _, homes, probes in counts:
        meet[dim, k] = meet.get((dim, k), 0) + homes * probes
        all_[dim, k] = all_.get((dim, k), 0) + homes
    out = {}
    for dim in {d for d, _ in meet}:
        share = [meet[dim, k] / max(1, all_[dim, k]) ** 2 for k in range(dim)]
        out[dim] = [sorted((k for k in own.tolist() if share[k] < most), key=lambda k: share[k])[:grid] for own in split(dim, blocks)]
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.93, blocks: int = 4, grid: int = 3, most: float = 0.6, tile: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows link when their labels are equal and not null, their vectors have equal length and their
    cosine in double precision is at least least. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, as do rows with a null id, which have a null component_id
    and are kept. Equal vectors of a label are one class with its count. Rows that share an id are
    separate rows with links of their own but share a component. Large cells are dealt out in tiles, and a
    task returns counts and the links that join what was apart, never all pairs.
    """
    names = [id_col, vector_col, label_col]
    wide = dict(vectors.dtypes)[vector_col] != "array<float>"
    rows = vectors.select(*[F.col(n).alias(a) for n, a in zip(names, ("vec_id", "v", "label"), strict=True)])
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("v", F.col("v").cast("array<double>" if wide else "array<float>"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    rows = c.materialise(rows.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    classes = rows.where("usable").groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = c.materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    distance = 2 * (1 - least)

    def count_cells(batches):
        import pyarrow as pa

        for dim, _, _, unit in _by_dim(batches, "v"):
            found = []
            for k, (home, low, high) in enumerate(zip(*(x.T for x in ranges(unit @ rotation(dim), split(dim, blocks), distance)), strict=True)):
                base = low.min()
                homes = np.bincount(home - base, minlength=high.max() - base + 1)
                probes = np.bincount(low - base, minlength=len(homes)) + np.bincount((high - base)[high > low], minlength=len(homes))
                found += [(dim, k, int(base + i), int(homes[i]), int(probes[i])) for i in np.flatnonzero(probes)]
            cols = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["dim", "k", "cell", "homes", "probes"])

    counted = classes.select("v").mapInArrow(count_cells, "dim long, k long, cell long, homes long, probes long")
    # a few rows for each coordinate
    chosen = choose_cells([tuple(r) for r in counted.groupBy("dim", "k", "cell").agg(F.sum("homes"), F.sum("probes")).collect()], blocks, grid, most)

    def to_cells(batches):
        """A row for each block and touched cell: home is 1 in a vector's own cell, else 0; block -1 where all meet."""
        import pyarrow as pa

        for dim, part, plain, unit in _by_dim(batches, "v"):
            raw = [x.tobytes() for x in plain]
            columns = [part.column(n) for n in ("label", "rep", "n")]

            def cells(block, code, at_home, keep, columns=columns, raw=raw, dim=dim):
                keep = pa.array(keep)
                n = len(keep)
                return pa.RecordBatch.from_arrays([columns[0].take(keep), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(code), pa.array(at_home), columns[1].take(keep), columns[2].take(keep), pa.array([raw[k] for k in keep.to_pylist()], pa.binary())], ["label", "dim", "block", "cell", "home", "rep", "n", "raw"])

            if not all(chosen[dim]):
                n = part.num_rows
                yield cells(-1, np.zeros(n, np.int64), np.ones(n, np.int32), np.arange(n))
                continue
            home, low, high = ranges(unit @ rotation(dim), split(dim, blocks), distance)
            for b, own in enumerate(chosen[dim]):
                for corner in range(1 << len(own)):
                    up = np.array([corner >> k & 1 for k in range(len(own))], bool)
                    cell = np.where(up, high[:, own], low[:, own])
                    keep = np.flatnonzero(~(up & (high[:, own] == low[:, own])).any(axis=1))
                    at_home = (cell == home[:, own]).all(axis=1)[keep].astype(np.int32)
                    code = np.zeros(len(keep), np.int64)
                    for k in range(len(own)):
                        code = code * 1_000_003 + cell[keep, k]
                    yield cells(b, code, at_home, keep)

    label_type = dict(classes.dtypes)["label"]
    cell_key = ["label", "dim", "block", "cell"]
    placed = c.materialise(classes.mapInArrow(to_cells, f"label {label_type}, dim int, block int, cell long, home int, rep long, n long, raw binary"), "cells")
    sizes = placed.groupBy(*cell_key).agg(F.ceil(F.sum("home") / tile).cast("int").alias("h_tiles"), F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("p_tiles")).where("h_tiles > 0")
    sized = placed.join(c.materialise(sizes, "cell-sizes"), cell_key)
    own_h, own_p = F.pmod(F.xxhash64("rep"), F.col("h_tiles")).cast("int"), F.pmod(F.xxhash64("rep"), F.col("p_tiles")).cast("int")
    carried = [*cell_key, "rep", "n", "raw"]
    # where all meet, homes and probes are dealt alike, and each two tiles meet once
    all_meet = F.col("block") < 0
    homes = sized.where("home = 1").withColumn("h", own_h)
    as_home = homes.select(*carried, "h", F.explode(F.sequence(F.when(all_meet, F.col("h")).otherwise(0), F.col("p_tiles") - 1)).alias("p"), F.lit(True).alias("is_home"))
    probes = sized.withColumn("p", own_p)
    as_probe = probes.select(*carried, F.explode(F.sequence(F.lit(0), F.when(all_meet, F.col("p")).otherwise(F.col("h_tiles") - 1))).alias("h"), "p", F.lit(False).alias("is_home"))

    def verify(table):
        """Rows (u, v, n): v links to u; n is how many vectors u gains (v null), or null for a link."""
        import pyarrow as pa

        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        vectors = np.frombuffer(b"".join(table.column("raw").to_pylist()), np.float64 if wide else np.float32).reshape(-1, dim).astype(np.float64)
        reps, weights, is_home = table.column("rep").to_numpy(), table.column("n").to_numpy(), table.column("is_home").to_numpy(zero_copy_only=False)
        h, p = np.flatnonzero(is_home), np.flatnonzero(~is_home)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        turned = vectors / norms[:, None] @ rotation(dim)
        parts = split(dim, blocks)
        ordered = block >= 0 or table.column("h")[0].as_py() == table.column("p")[0].as_py()
        ids, place = np.unique(reps, return_inverse=True)
        gained, links = np.zeros(len(reps), np.int64), Links(ids)
        for i, j, near in candidates(turned[h], turned[p], [block] if block >= 0 else list(range(len(parts))), parts, distance):
            i, j = h[i], p[j]
            if ordered:
                near &= reps[j][None, :] < reps[i][:, None]
            if near.sum() * 8 > near.size:
                near &= (vectors[i] @ vectors[j].T) / (norms[i][:, None] * norms[j][None, :]) >= least
                x, y = np.nonzero(near)
                x, y = i[x], j[y]
            else:
                x, y = np.nonzero(near)
                x, y = i[x], j[y]
                cosine = [np.einsum("ij,ij->i", vectors[x[at : at + PAIRS_AT_ONCE]], vectors[y[at : at + PAIRS_AT_ONCE]]) for at in range(0, len(x), PAIRS_AT_ONCE)]
                sure = np.concatenate([*cosine, np.empty(0)]) / (norms[x] * norms[y]) >= least
                x, y = x[sure], y[sure]
            if len(x):
                gained += np.bincount(x, weights[y], len(reps)).astype(np.int64) + np.bincount(y, weights[x], len(reps)).astype(np.int64)
                links.add(place[x], place[y])
        stars = links.stars()
        some = gained > 0
        return pa.table({"u": pa.array([*reps[some].tolist(), *(s[0] for s in stars)], pa.int64()), "v": pa.array([*[None] * int(some.sum()), *(s[1] for s in stars)], pa.int64()), "n": pa.array([*gained[some].tolist(), *[None] * len(stars)], pa.int64())})

    found = as_home.unionByName(as_probe).groupBy(*cell_key, "h", "p").applyInArrow(verify, "u long, v long, n long")
    found = c.materialise(found, "vector-links")
    c.drop(placed)
    gained = found.where("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("gained"))
    # classes that hold the same id share a component
    several = rows.where("usable").groupBy("vec_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("vec_id")
    of_shared = rows.where("usable").join(several, "vec_id", "left_semi").join(classes.select("label", "v", "rep"), ["label", "v"]).select("vec_id", "rep")
    same_id = of_shared.join(of_shared.groupBy("vec_id").agg(F.min("rep").alias("v")), "vec_id").select(F.col("rep").alias("u"), "v")
    roots = components(found.where("v IS NOT NULL").select("u", "v").unionByName(same_id)).withColumnRenamed("node", "rep")
    in_component = classes.join(roots, "rep", "left").select("label", "v", "rep", "low", "n", F.coalesce("component", "rep").alias("component"))
    in_component = c.materialise(in_component.join(gained, "rep", "left"), "class-components")
    lowest = in_component.groupBy("component").agg(F.min("low").alias("component_id"))
    known = in_component.join(lowest, "component").select("label", "v", (F.coalesce("gained", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.where("usable").select("vec_id", "label", "v").join(c.materialise(known, "class-links"), ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "embeddings"), least=0.93)


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
   AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS u, vec_id AS w FROM embeddings
  UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.u = e.vec_id)::BIGINT AS n_links,
       min(r.w) AS component_id, e.vec_id = min(r.w) AS kept
FROM embeddings e JOIN reach r ON r.u = e.vec_id GROUP BY e.vec_id
"""
