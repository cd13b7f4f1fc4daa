"""Packing documents into token windows by online sum-of-squares placement.

Each task takes its documents as they come. Whole windows are cut from the front of a long document;
what is left goes into the fill level for which the sum over levels of the squared count of partially
filled windows becomes smallest, tracked in an array of counts by level. Once a task has so many windows
open it opens no further one: then placements that cut the document where its window is full compete
by the same sum. What a task leaves open is placed as a whole by the same rule in rounds, in which each packer
takes over the open windows of a bounded number of tasks; the last packer leaves one window open.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eocatalog.llm import _common as c
from eocatalog.llm._chunks import encoder, in_parts


class SumOfSquares:
    """Windows by fill level; put() returns the windows that pieces have filled.

    A piece is (doc_id, start, ids, doc_tokens). With max_open windows open, no new one is begun.
    """

    def __init__(self, size: int, max_open: int):
        self.size, self.max_open = size, max_open
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def level_for(self, length: int) -> int:
        """The fill level (0: a new window) with the least sum of squares after placing; ties take the fullest.

        Moving one window from level h to h + length changes the sum by 2 (n[h + length] - n[h] + 1). Past
        the size the window is full, and the part cut off begins one at level h + length - size.
        """
        size, n = self.size, self.levels
        last = size - length
        change = np.empty(size, np.int64)
        change[: last + 1] = 2 * (n[length : size + 1] - n[: last + 1]) + 2
        change[0] = 2 * n[length] + 1
        change[last] = -2 * n[last] + 1 if last else 0
        never = np.iinfo(np.int64).max
        if self.n_open < self.max_open or not self.n_open or not last:
            change[last + 1 :] = never
        else:
            change[last + 1 :] = 2 * (n[1:length] - n[last + 1 : size]) + 2
            change[0] = never
        change[1:][n[1:size] == 0] = never
        return int(size - 1 - np.argmin(change[::-1]))

    def put(self, pieces: list[tuple], length: int) -> list[list[tuple]]:
        """Places pieces of 1 to size tokens in all, one after another; the windows that are full now."""
        at = self.level_for(length)
        window = []
        if at:
            self.levels[at] -= 1
            self.n_open -= 1
            window = self.open[at].pop()
        room = self.size - at
        rest = []
        if length > room:
            pieces, rest = cut(pieces, room)
        window += pieces
        full = [window] if length >= room else []
        if length != room:
            level = at + length if length < room else length - room
            self.levels[level] += 1
            self.n_open += 1
            self.open.setdefault(level, []).append(rest if length > room else window)
        return full

    def partial(self) -> list[list[tuple]]:
        """The windows that aren't full, the fullest first."""
        return [w for level in sorted(self.open, reverse=True) for w in self.open[level]]


def cut(pieces: list[tuple], length: int) -> tuple[list[tuple], list[tuple]]:
    """The first length tokens of pieces, and the others."""
    head, tail = [], []
    for doc_id, start, ids, doc_tokens in pieces:
        if len(ids[:length]):
            head.append((doc_id, start, ids[:length], doc_tokens))
        if len(ids[length:]):
            tail.append((doc_id, start + length, ids[length:], doc_tokens))
        length = max(0, length - len(ids))
    return head, tail


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, window long, offset long, ids binary"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


class _Rows:
    """Rows of pieces: of full windows, numbered, with checksums, and of open ones with their ids."""

    def __init__(self, part: int):
        self.part, self.windows, self.opened, self.rows = part, 0, 0, []

    def add(self, window: list[tuple], is_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in window:
            number = self.opened if is_open else self.windows
            self.rows.append((doc_id, start, len(ids), None if is_open else zlib.crc32(ids), doc_tokens, self.part, number, offset, ids.tobytes() if is_open else None))
            offset += len(ids)
        if is_open:
            self.opened += 1
        else:
            self.windows += 1

    def take(self):
        import pyarrow as pa

        types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in _NAMES]
        kinds = [types[x.split()[1]] for x in _PIECE.split(", ")]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(columns, kinds, strict=True)], _NAMES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, max_open: int = 128, fan_in: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every text, and end_id after each, lies in exactly one piece. A null or empty text has
    end_id alone. Null and repeated ids are packed like others, row by row. An empty table gives no rows.
    All windows but one are full. A packer has at most max_open windows open, or, in the rounds that merge,
    takes over those of fan_in packers. The driver adds up the packers' windows (one number each).
    """
    spark = docs.sparkSession

    def place(batches):
        e, packer, out = encoder(tokenizer), SumOfSquares(size, max_open), _Rows(TaskContext.get().partitionId())
        for rows in in_parts(batches):
            flat, lens = e.encode(rows.column(1).to_pylist())
            ends = np.cumsum(lens)
            flat = np.insert(flat, ends, end_id).astype("<u4")
            bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
            for k, doc_id in enumerate(rows.column(0).to_pylist()):
                ids = flat[bounds[k] : bounds[k + 1]]
                whole = len(ids) // size * size
                for at in range(0, whole, size):
                    out.add([(doc_id, at, ids[at : at + size], len(ids))])
                if whole < len(ids):
                    for window in packer.put([(doc_id, whole, ids[whole:].copy(), len(ids))], len(ids) - whole):
                        out.add(window)
            yield out.take()
        for window in packer.partial():
            out.add(window, is_open=True)
        yield out.take()

    def merge(last):
        def run(table):
            rows = table.sort_by([("part", "ascending"), ("window", "ascending"), ("offset", "ascending")]).to_pydict()
            out = _Rows(rows["part"][0] // fan_in)
            taken: dict[tuple, list] = {}
            for part, window, doc_id, start, ids, doc_tokens in zip(*[rows[n] for n in ("part", "window", "doc_id", "start", "ids", "doc_tokens")], strict=True):
                taken.setdefault((part, window), []).append((doc_id, start, np.frombuffer(ids, "<u4"), doc_tokens))
            windows, bound = list(taken.values()), max_open
            while True:
                packer, bound = SumOfSquares(size, bound), bound // 2
                # the fullest first: what is left to place gets smaller
                for pieces in sorted(windows, key=lambda w: -sum(len(p[2]) for p in w)):
                    for window in packer.put(pieces, sum(len(p[2]) for p in pieces)):
                        out.add(window)
                windows = packer.partial()
                if not last or len(windows) < 2:  # the last packer halves its bound down to one window
                    break
            for window in windows:
                out.add(window, is_open=not last)
            import pyarrow as pa

            return pa.Table.from_batches([out.take()])

        return run

    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rounds = [c.materialise(pair.mapInArrow(place, _PIECE), "pieces")]
    while True:
        opened = rounds[-1].where("ids IS NOT NULL")
        parts = opened.agg(F.max("part")).first()[0]
        if parts is None:
            break
        packer = F.floor(F.col("part") / fan_in).cast("int")
        rounds.append(c.materialise(opened.groupBy(packer.alias("packer")).applyInArrow(merge(parts < fan_in), _PIECE), "merged-pieces"))
    full = functools.reduce(DataFrame.unionByName, [r.where("ids IS NULL").withColumn("round", F.lit(k)) for k, r in enumerate(rounds)])
    counts = full.groupBy("round", "part").agg((F.max("window") + 1).alias("n")).toPandas().sort_values(["round", "part"])
    first = counts["n"].cumsum() - counts["n"]
    bases = spark.createDataFrame([tuple(map(int, r)) for r in zip(counts["round"], counts["part"], first, strict=True)], "round int, part int, first long")
    return full.join(bases, ["round", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("window")).alias("sequence_id"), "offset")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(c.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
