"""Byte-level BPE from a rank file: encoding by a segment tree over byte positions, and decoding.

A piece of text (a match of the pattern) is merged by a tree whose leaves are the pairs that begin at its
bytes. A leaf holds the pair's rank before its position, so the root is the lowest rank at its leftmost place.
A merge sets three leaves: the pair that began at the right part goes, and the pairs on either side of the new
part get their new ranks; each set walks up the tree and ends where nothing changes. Parts are linked to their
living neighbours. So a piece of n bytes takes n log n steps, however long it is.

Short pieces of one width are merged side by side, a tree in each column of an array; longer ones alone.
Each distinct chunk of text that a worker meets is split and merged once.
"""

from __future__ import annotations

import base64
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eocatalog.llm import _common as c
from eocatalog.llm._chunks import ChunkEncoder, in_parts

#: Bytes of pieces that are merged side by side; pieces of more bytes than the last are merged alone.
WIDTHS = (4, 8, 16, 32, 64)
#: Columns of such an array at once.
COLUMNS = 20_000
#: Letters and numbers (first and last code point) of Unicode 17 and 18. The library's engine has
#: the classes of Unicode 16, in which these are neither; the module regex has newer ones.
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: A character of private use, in none of the pattern's classes.
_NO_CLASS = "\ue000"

_vocabularies: dict = {}


class Ranks:
    """The tokens of a rank file, and the token that each pair of them merges to."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        n = max(self.ids.values()) + 1
        self.tokens: list[bytes | None] = [None] * n
        for token, i in self.ids.items():
            self.tokens[i] = token
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("the file lacks a single byte")
        self.size = n
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        merged = {self.ids[t[:k]] * n + self.ids[t[k:]]: i for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids}
        self.merged = merged
        keys = np.fromiter(merged, np.int64, len(merged))
        order = np.argsort(keys)
        #: One more at the end, so that a search never leaves the array.
        self._keys = np.append(keys[order], np.iinfo(np.int64).max)
        self._values = np.append(np.fromiter(merged.values(), np.int64, len(merged))[order], n)
        lens = np.array([len(t or b"") for t in self.tokens], np.int64)
        self._lens, self._starts = lens, np.cumsum(lens) - lens
        self._pool = np.frombuffer(b"".join(t or b"" for t in self.tokens), np.uint8)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token of each pair, which is also its rank; the number of tokens where there is none."""
        key = left * self.size + right
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._values[at], self.size)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids one after another."""
        lens = self._lens[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self._pool[np.arange(total) + np.repeat(self._starts[ids] - (ends - lens), lens)]

    def widths(self, ids: np.ndarray) -> np.ndarray:
        return self._lens[ids]


def ranks(path: str) -> Ranks:
    if path not in _vocabularies:
        _vocabularies[path] = Ranks(path)
    return _vocabularies[path]


def merge(piece: bytes, vocabulary: Ranks) -> list[int]:
    """The tokens of one piece of any length, by one tree."""
    n, none = len(piece), vocabulary.size
    tokens = vocabulary.of_byte[np.frombuffer(piece, np.uint8)].tolist()
    if n < 2:
        return tokens
    merged = vocabulary.merged
    after, before = list(range(1, n + 1)), list(range(-1, n))
    leaves = 1 << (n - 1).bit_length()
    nothing = none * n
    tree = [nothing] * (2 * leaves)
    for i in range(n - 1):
        tree[leaves + i] = merged.get(tokens[i] * none + tokens[i + 1], none) * n + i
    for at in range(leaves - 1, 0, -1):
        a, b = tree[2 * at], tree[2 * at + 1]
        tree[at] = a if a < b else b

    def put(i: int, value: int) -> None:
        at = leaves + i
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            at >>= 1
            if other < value:
                value = other
            if tree[at] == value:
                return
            tree[at] = value

    while (root := tree[1]) < nothing:
        token, i = divmod(root, n)
        j = after[i]
        k = after[j]
        tokens[i], tokens[j] = token, -1
        after[i], before[k] = k, i
        put(j, nothing)
        put(i, merged.get(token * none + tokens[k], none) * n + i if k < n else nothing)
        if i:
            p = before[i]
            put(p, merged.get(tokens[p] * none + token, none) * n + p)
    return [t for t in tokens if t >= 0]


def merge_side_by_side(text: np.ndarray, sizes: np.ndarray, width: int, vocabulary: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of pieces of at most width bytes one after another, and how many each has. text: all their bytes."""
    m, none = len(sizes), vocabulary.size
    all_cols = np.arange(m)
    starts = np.cumsum(sizes) - sizes
    rows, cols = np.arange(len(text)) - np.repeat(starts, sizes), np.repeat(all_cols, sizes)
    tokens = np.full((width + 1, m), -1)
    tokens[rows, cols] = vocabulary.of_byte[text]
    after, before = (np.repeat(np.arange(width + 1)[:, None] + d, m, axis=1) for d in (1, -1))
    nothing = none * width
    tree = np.full((2 * width, m), nothing)
    first = np.flatnonzero(rows < sizes[cols] - 1)
    i, at = rows[first], cols[first]
    tree[width + i, at] = vocabulary.merge_of(tokens[i, at], tokens[i + 1, at]) * width + i
    tree[tree > nothing] = nothing
    for level in range(width - 1, 0, -1):
        np.minimum(tree[2 * level], tree[2 * level + 1], out=tree[level])

    def put(i: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
        i = i + width
        tree[i, at] = value
        while i[0] > 1:
            i >>= 1
            tree[i, at] = np.minimum(tree[2 * i, at], tree[2 * i + 1, at])

    def pair(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.minimum(vocabulary.merge_of(tokens[left, at], tokens[right, at]) * width + left, nothing)

    at = np.flatnonzero(tree[1] < nothing)
    while len(at):
        token, i = tree[1, at] // width, tree[1, at] % width
        j = after[i, at]
        k = np.minimum(after[j, at], width)
        tokens[i, at], tokens[j, at] = token, -1
        after[i, at], before[k, at] = k, i
        put(j, at, nothing)
        inner = k < sizes[at]
        put(i, at, np.where(inner, pair(i, k, at), nothing))
        left = np.flatnonzero(i > 0)
        if len(left):
            p = before[i[left], at[left]]
            put(p, at[left], pair(p, i[left], at[left]))
        at = at[tree[1, at] < nothing]
    flat = tokens[:width].T
    alive = flat >= 0
    return flat[alive], alive.sum(axis=1)


class RankEncoder(ChunkEncoder):
    """Ids of whole texts by a rank file, as the library that such files are for gives them, without special tokens."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = ranks(path)
        self._pattern = regex.compile(pattern)
        self._later = {ord(x): _NO_CLASS for first, last in LATER for x in map(chr, range(first, last + 1))}
        self._start([], byte_level=True)

    def pieces(self, chunk: str) -> list[str]:
        """The matches of the pattern, one after another. Letters alone or after one space are one match."""
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha():
            return [chunk]
        if chunk.isascii() or not any(ord(x) in self._later for x in chunk):
            return self._pattern.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self._pattern.finditer(chunk.translate(self._later))]

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all pieces, and where each one's begin and how many they are.

        A piece that is a token is that token, whatever its pairs would merge to.
        """
        n, none = len(pieces), -1
        whole = np.fromiter((self.ranks.ids.get(p, none) for p in pieces), np.int64, n)
        starts, lens = np.arange(n), np.ones(n, np.int64)
        flats, used = [np.maximum(whole, 0)], n
        sizes = np.where(whole < 0, np.fromiter(map(len, pieces), np.int64, n), 0)
        least = 0
        for width in WIDTHS:
            own = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            for at in range(0, len(own), COLUMNS):
                some = own[at : at + COLUMNS]
                text = np.frombuffer(b"".join([pieces[k] for k in some.tolist()]), np.uint8)
                flat, lens[some] = merge_side_by_side(text, sizes[some], width, self.ranks)
                starts[some] = used + np.cumsum(lens[some]) - lens[some]
                flats.append(flat)
                used += len(flat)
        for k in np.flatnonzero(sizes > least).tolist():
            flats.append(np.array(merge(pieces[k], self.ranks)))
            starts[k], lens[k] = used, len(flats[-1])
            used += lens[k]
        return np.concatenate(flats), starts, lens

    def _encode_new(self, new: list[str], whole: set[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = list(map(self.pieces, new))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        pieces = list(itertools.chain.from_iterable(parts))
        slots = dict.fromkeys(pieces)
        slots = dict(zip(slots, range(len(slots)), strict=True))
        own = np.fromiter(map(slots.__getitem__, pieces), np.int64, len(pieces))
        flat, starts, lens = self.merge_all(list(map(str.encode, slots)))
        ends = np.cumsum(lens[own])
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.arange(total) + np.repeat(starts[own] - (ends - lens[own]), lens[own])]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids.astype(np.int32), bounds[:-1], np.diff(bounds)


_encoders: dict = {}


def _encoder(path: str, pattern: str) -> RankEncoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = RankEncoder(path, pattern)
    return _encoders[path, pattern]


def _encoded(batches, path: str, pattern: str):
    import pyarrow as pa

    own = _encoder(path, pattern)
    for part in in_parts(batches, chars=1_000_000):
        ids, lens = own.encode(part.column(1).to_pylist())
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], ["doc_id", "ids"])
    c.release_memory()


def _decoded(batches, path: str):
    import pyarrow as pa

    own = ranks(path)
    for batch in batches:
        column = batch.column(1)
        lens = np.asarray(column.value_lengths().fill_null(0), np.int64)
        flat = np.asarray(column.flatten().fill_null(-1), np.int64)
        known = (flat >= 0) & (flat < own.size)
        sizes = np.where(known, own.widths(np.where(known, flat, 0)), 0)
        known &= sizes > 0
        of_row = np.repeat(np.arange(len(lens)), lens)
        whole = np.bincount(of_row[~known], minlength=len(lens)) == 0
        ends = np.cumsum(np.bincount(of_row, sizes, len(lens)).astype(np.int64))
        text = own.decode(flat[known]).tobytes()
        out = [text[a:b] if ok else None for a, b, ok in zip([0, *ends.tolist()], ends.tolist(), whole.tolist(), strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text; no ids for a null or empty one.

    Rows are looked at one by one, so null and repeated ids change nothing, and other columns are left
    out. Texts of any length are encoded whole. path is a rank file that every executor has.
    """
    return _texts(docs, id_col, text_col).mapInArrow(lambda batches: _encoded(batches, path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (binary), the bytes that the ids stand for; none for null ids.

    An id that the file doesn't have, or a null one, makes a row's decoded null.
    """
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, path), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What decode() gives of what encode() gives, in one worker process a task."""
    return _texts(docs, id_col, text_col).mapInArrow(lambda batches: _decoded(_encoded(batches, path, pattern), path), "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(round_trip(c.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))
