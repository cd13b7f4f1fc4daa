"""Connected components of link tables, and groups of bounded size for exact comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eocatalog.llm import _common as c


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links(u, v).

    Alternates large-star and small-star steps: each node's neighbours are linked to the
    smallest of them, until nothing changes. Each step is a map-side combined minimum and a
    join on the node, and is written to the shared folder; nothing is gathered on the driver but
    two sums. A node with very many links is split by adaptive skew joins.
    """
    pairs = lambda d: d.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = c.materialise(pairs(links), "links")
    sign = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = c.materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        # large star: every larger neighbour goes to the smallest node around
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = c.materialise(pairs(large), "large-star")
        c.drop(links, low)
        # small star: the node and its smaller neighbours go to the smallest of these
        low = c.materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        links = c.materialise(pairs(small), "small-star")
        c.drop(large, low)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign or not now[0]:
            break
        sign = now
    # stars now: u hangs on v, and each v is the smallest of its component
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Forest:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def star_links(ids: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """For pairs of positions in ids, links (id, smallest id of its group), one for each further member."""
    forest, seen = Forest(len(ids)), set()
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(ids))
    for x, y in place[pairs].tolist():
        forest.join(x, y)
        seen.update((x, y))
    return [(int(ids[order[x]]), int(ids[order[r]])) for x in seen if (r := forest.root(x)) != x]


class Links:
    """Links between positions in sorted ids, of which only those are kept that join what was apart."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.forest, self.roots = ids, Forest(len(ids)), np.arange(len(ids))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.roots[x], self.roots[y]
        new = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
        for one, other in new.tolist():
            self.forest.join(one, other)
        if len(new):
            up = np.array(self.forest.up)
            while (up[up] != up).any():
                up = up[up]
            self.roots, self.forest.up = up, up.tolist()

    def stars(self) -> list[tuple[int, int]]:
        """(id, smallest id of its group), one for each further member."""
        moved = np.flatnonzero(self.roots != np.arange(len(self.ids)))
        return list(zip(self.ids[moved].tolist(), self.ids[self.roots[moved]].tolist(), strict=True))
