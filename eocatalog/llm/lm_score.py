"""LM scoring by online logistic context mixing.

A text is its class (which non-ASCII letter it has most of, a stand-in for its language) and its tokens:
lower-cased words and an end. Each token is told by binary decisions, until one says which word it is:

1. is it the word that most often follows the two words before it in the training corpus?
2. is it the word that followed the last time the word before it stood in this text?
3. has the training corpus the word?  Then the bits of its code say which one (_codes): what counts in the class and
   counts over all classes say of a bit is mixed with what followed the word before. Rare words share the leaves
   of codes; which word of a leaf it is, counts say.
4. else the word is spelled, each byte as eight binary decisions.

Decisions 1 to 3 are predicted by several hashed contexts that reach back over words, mixed with gated weights and
refined by an adaptive map, all learned online along the texts (_online), as are the weights and contexts of codes.
Counts of words and of what follows two words are tables over the whole corpus that grow with it, in shards (_follow
for the latter); words are told apart there by 64 bits of a hash.

Spelling mixes hashed contexts too (the last 1, 2, 3 or 4 bytes, the word so far, and that with the class). They
end at the word's start, so each distinct pair of class and new word is spelled once, and weights and map
are learned in one pass over the words that the training corpus has once. Letter
statistics have tables of a fixed size; what grows with the corpus is counted in the tables above.

Each token of training text is scored with that occurrence of it left out of all counts. The total is the text's probability, so bits
per byte follow.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eocatalog.llm import _common as c
from eocatalog.llm import _codes, _follow, _online
from eocatalog.llm._chunks import in_parts

ORDERS = (1, 2, 3, 4)
N_CONTEXTS = len(ORDERS) + 2
N_CLASSES = 16
#: Fewer non-ASCII letters than this share of bytes make no class of their own.
CLASS_SHARE = 0.01
#: Slots of each context's table, as powers of two: short contexts are few, long ones share slots.
TABLE_BITS = (17, 19, 20, 21, 21, 21)
#: Slots that are added up in one group, and partial tables in one such group.
SEGMENT, FAN_IN = 1 << 16, 32
#: Text of one chunk of documents that look words up together, in bytes; requests that a shard answers; words of a task.
CHUNK_BYTES, SHARD_KEYS, TASK_WORDS = 10_000_000, 400_000, 400_000
#: Partitions that texts and chunks are dealt to, at most; a partition holds any number of chunks.
MAX_PARTITIONS = 20_000
#: Tokens whose decisions are worked out at once.
AT_ONCE, CODES_AT_ONCE = 100_000, 25_000
#: Weight sets: the bit's place, by how often the word so far was seen in the class, by how often at all.
CLASS_LEVELS, WORD_LEVELS = (1, 2, 4, 16, 256), (1, 8)
N_GATES = 8 * (len(CLASS_LEVELS) + 1) * (len(WORD_LEVELS) + 1)
MAP_STEPS = 33
_LIMIT = 8.0
_EXACT = 64
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

# counts in a byte: exact below 64, then six steps a doubling, up to about 2e11
_VALUES = np.concatenate([np.arange(_EXACT), _EXACT * 2.0 ** (np.arange(256 - _EXACT) / 6)])


def quantise(counts: np.ndarray) -> np.ndarray:
    return np.where(counts < _EXACT, counts, np.searchsorted(_VALUES, counts, side="right") - 1).astype(np.uint8)


def _stretch_tables() -> np.ndarray:
    """ln((n1 + 0.4) / (n0 + 0.4)) by n1 * 256 + n0: as it is, without a zero, without a one."""
    n0, n1 = np.broadcast_to(_VALUES, (256, 256)), np.broadcast_to(_VALUES[:, None], (256, 256))
    less = lambda n: np.maximum(n - 1, 0)
    logit = lambda a, b: np.log((a + 0.4) / (b + 0.4)).ravel().astype(np.float32)
    return np.stack([logit(n1, n0), logit(n1, less(n0)), logit(less(n1), n0)])


def flatten(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, each followed by a space, and where each word starts."""
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return flat, np.cumsum(lens) - lens


def text_class(text: bytes) -> int:
    """A bucket for the non-ASCII letter that a text has most of; 0 where there are few."""
    if text.isascii():
        return 0
    raw = np.frombuffer(text, np.uint8).astype(np.int64)
    lead = np.flatnonzero(raw[:-1] >= 0xC0)
    if len(lead) < CLASS_SHARE * len(raw):
        return 0
    most = int(np.bincount((raw[lead] & 63) * 64 + (raw[lead + 1] & 63)).argmax())
    return 1 + most * 0x9E3779B1 % (1 << 32) * (N_CLASSES - 1) // (1 << 32)


def context_hashes(flat: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each context at each byte; classes by word."""
    n = len(flat)
    lens = np.diff(np.append(starts, n))
    place = np.arange(n) - np.repeat(starts, lens)
    out = np.empty((N_CONTEXTS, n), np.uint64)
    acc = np.zeros(n, np.uint64)
    for order in range(max(ORDERS) + 1):
        if order:
            before = np.zeros(n, np.uint64)
            before[order:] = flat[:-order].astype(np.uint64) + np.uint64(1)
            before[place < order] = 0
            acc = (acc + before + np.uint64(1)) * _M1
        if order in ORDERS:
            out[ORDERS.index(order)] = acc ^ (acc >> np.uint64(29))
    # the word so far: sums of byte * r**i from the word's start, all modulo 2**64
    r, inverse = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
    powers = np.cumprod(np.full(n, r))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers)])
    back = np.cumprod(np.full(n, inverse))
    acc = (sums[:-1] - np.repeat(sums[starts], lens)) * np.repeat(back[starts], lens)
    acc ^= acc >> np.uint64(29)
    out[-2] = acc
    out[-1] = acc ^ (np.repeat(classes.astype(np.uint64) + np.uint64(1), lens) * _M2)
    return out


def slots_of(k: int, hashes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Table slots of context k's hashes at a node (1 to 255) of the byte's binary tree; salt is the node's hash."""
    x = hashes ^ salt
    x *= _M2
    x >>= np.uint64(64 - TABLE_BITS[k])
    return x.view(np.intp)


class Cells:
    """The bytes of words, each beginning that words share told once.

    Contexts end at a word's start, so a byte is told alike in all words that have the same figures (class and the
    like) and the same bytes up to it. Such bytes are one cell.
    """

    def __init__(self, words: list[bytes], *figures: np.ndarray):
        import pyarrow as pa
        import pyarrow.compute as pc

        columns = {str(k): pa.array(x) for k, x in enumerate(figures)} | {"word": pa.array(words, pa.binary())}
        #: Words by figures and spelling; all that follows is in this order.
        self.order = np.asarray(pc.sort_indices(pa.table(columns), [(name, "ascending") for name in columns])).astype(np.intp)
        self.flat, self.starts = flatten([words[i] for i in self.order.tolist()])
        n, at = len(self.flat), np.arange(len(self.flat))
        self.lens = np.diff(np.append(self.starts, n))
        self.place = at - np.repeat(self.starts, self.lens)
        # bytes that the word before has at this place, until the first other one
        alike = np.ones(len(words), bool)
        alike[:1] = False
        for x in figures:
            alike[1:] &= x[self.order[1:]] == x[self.order[:-1]]
        before = np.append(0, self.lens[:-1])
        same = self.place < np.repeat(before * alike, self.lens)
        same &= self.flat == self.flat[at - np.repeat(before, self.lens)]
        new = self.place >= np.repeat(np.minimum.reduceat(np.where(same, n, self.place), self.starts), self.lens)
        #: The bytes that stand for a cell, and each byte's cell: that of the last new byte before it at its place.
        self.new = np.flatnonzero(new)
        by_place = np.argsort(self.place.astype(np.min_scalar_type(int(self.place.max()))), kind="stable")
        last = by_place[np.maximum.accumulate(np.where(new[by_place], at, 0))]
        self.of = np.empty(n, np.intp)
        self.of[by_place] = (np.cumsum(new) - 1)[last]

    def hashes(self, classes: np.ndarray) -> np.ndarray:
        """Those of each cell's contexts; classes by word as given."""
        return context_hashes(self.flat, self.starts, classes[self.order]).take(self.new, axis=1)

    def bits(self):
        """For each of eight bits: place, node, bit by cell."""
        return bit_steps(self.flat[self.new])

    def summed(self, x: np.ndarray) -> np.ndarray:
        """What words as given have, summed by cell."""
        return np.bincount(self.of, np.repeat(x[self.order], self.lens), len(self.new))

    def by_word(self, x: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each word as given; x by cell."""
        out = np.empty(len(self.order), x.dtype)
        out[self.order] = np.add.reduceat(x.take(self.of), self.starts)
        return out


def bit_steps(flat: np.ndarray):
    """For each of eight bits: place, node, bit."""
    wide = flat.astype(np.uint64)
    for d in range(8):
        yield d, np.uint64(1 << d) | (wide >> np.uint64(8 - d)), (flat >> (7 - d)) & 1


def first_weights() -> np.ndarray:
    """The more often the word so far was seen in the class, the more its context weighs."""
    longest = np.array([0.1, 0.2, 0.3, 0.5, 0.8, 0.95], np.float32)
    level = np.arange(N_GATES) // (len(WORD_LEVELS) + 1) % (len(CLASS_LEVELS) + 1)
    out = np.repeat((1 - longest[level])[:, None] * np.float32(0.3), N_CONTEXTS, axis=1)
    out[:, -1] = longest[level]
    return out


class Model:
    """Tables of counts in bytes, weights by gate, and the refining map."""

    def __init__(self, tables: list[np.ndarray], weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.tables = tables
        self.weights = first_weights() if weights is None else weights.astype(np.float32)
        self.refine = refine
        self._stretch = _stretch_tables()
        seen = (_VALUES[:, None] + _VALUES[None, :]).ravel()
        self._class_level = np.searchsorted(CLASS_LEVELS, seen, side="right").astype(np.int32) * (len(WORD_LEVELS) + 1)
        self._word_level = np.searchsorted(WORD_LEVELS, seen, side="right").astype(np.int32)

    def inputs(self, hashes: np.ndarray, d: int, node: np.ndarray, bit: np.ndarray | None, where: np.ndarray | bool = True):
        """Stretched predictions (bytes by contexts) and gates; with bit, that occurrence is left out (where so)."""
        shift = None if bit is None else (np.where(bit, 2, 1) * where).astype(np.intp) << 16
        stretched = np.empty((N_CONTEXTS, len(node)), np.float32)
        gate = np.full(len(node), d * N_GATES // 8, np.intp)
        table, salt = self._stretch.ravel(), node * _M1
        for k in range(N_CONTEXTS):
            pair = self.tables[k].take(slots_of(k, hashes[k], salt)).astype(np.intp)
            if k == N_CONTEXTS - 2:
                gate += self._word_level.take(pair)
            elif k == N_CONTEXTS - 1:
                gate += self._class_level.take(pair)
            if shift is not None:
                pair += shift
            table.take(pair, out=stretched[k], mode="clip")
        return stretched, gate

    def mix(self, stretched: np.ndarray, gate: np.ndarray) -> np.ndarray:
        total = np.zeros(len(gate), np.float32)
        for k in range(N_CONTEXTS):
            total += self.weights[:, k].take(gate) * stretched[k]
        return np.clip(total, -_LIMIT, _LIMIT)

    def refined(self, mixed: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The probability of a one: the mean of the mix and of the map between its two nearest steps."""
        p = 1 / (1 + np.exp(-mixed))
        if self.refine is None:
            return p
        at = (mixed + _LIMIT) * ((MAP_STEPS - 1) / (2 * _LIMIT))
        low = np.minimum(at.astype(np.int32), MAP_STEPS - 2)
        part = at - low
        index = node.astype(np.int32) * MAP_STEPS + low
        return (p + self.refine.take(index) * (1 - part) + self.refine.take(index + 1) * part) / 2

    def log10_words(self, words: list[bytes], classes: np.ndarray, learned: np.ndarray | None = None) -> np.ndarray:
        """learned: the words that the tables have, of each of which an occurrence is left out."""
        cells = Cells(words, classes, *([] if learned is None else [learned]))
        hashes = cells.hashes(classes)
        total = np.ones(len(cells.new))
        learned = None if learned is None else np.repeat(learned[cells.order], cells.lens)[cells.new]
        for d, node, bit in cells.bits():
            p = self.refined(self.mix(*self.inputs(hashes, d, node, None if learned is None else bit, learned)), node)
            total *= np.where(bit, p, 1 - p)  # eight factors of at least some 1e-5
        return cells.by_word(np.log10(total))


def count_tables(words: list[bytes], classes: np.ndarray, times: np.ndarray, out: list[np.ndarray]) -> None:
    """Adds the words' bits, each as often as its word, to out[context][bit * slots + slot]."""
    cells = Cells(words, classes)
    weight, hashes = cells.summed(times).astype(np.float32), cells.hashes(classes)
    for _, node, bit in cells.bits():
        salt, bit = node * _M1, bit.astype(np.intp)
        for k in range(N_CONTEXTS):
            np.add.at(out[k], slots_of(k, hashes[k], salt) + (bit << TABLE_BITS[k]), weight)


def learn(model: Model, words: list[bytes], classes: np.ndarray, times: np.ndarray, squares: np.ndarray, seen: np.ndarray, rate: float) -> None:
    """One online step over some words: predictions go into the map's counts, then weights along their gates' mean gradients.

    Steps shrink with the sum of squared gradients so far. In a gradient words weigh by their counts to the power 3/4, so
    that the most frequent don't steer alone; seen[bit, node and step of the prediction] adds up plain counts.
    """
    cells = Cells(words, classes)
    plain, weight, hashes = cells.summed(times), cells.summed(times**0.75), cells.hashes(classes)
    for d, node, bit in cells.bits():
        stretched, gate = model.inputs(hashes, d, node, bit)
        mixed = model.mix(stretched, gate)
        at = np.rint((mixed + _LIMIT) * ((MAP_STEPS - 1) / (2 * _LIMIT))).astype(np.int64)
        np.add.at(seen.reshape(-1), bit.astype(np.int64) * (256 * MAP_STEPS) + node.astype(np.int64) * MAP_STEPS + at, plain)
        error = (bit - 1 / (1 + np.exp(-mixed))) * weight
        mass = np.maximum(np.bincount(gate, weight, N_GATES), 1e-9)
        for k in range(N_CONTEXTS):
            slope = np.bincount(gate, error * stretched[k], N_GATES) / mass
            squares[:, k] += slope * slope
            model.weights[:, k] += rate * slope / np.sqrt(squares[:, k] + 1e-6)


def _list(column) -> list[bytes]:
    return column.to_numpy(zero_copy_only=False).tolist() if not hasattr(column, "chunks") else column.to_numpy().tolist()


def _word_parts(batches, rows: int = 8192):
    """Lists of words with their classes and counts, of bounded size."""
    for part in in_parts(batches, rows=rows, chars=400_000):
        yield _list(part.column("word")), np.asarray(part.column("cls")), np.asarray(part.column("n"))


def train(vocabulary: DataFrame, parts: int, rate: float = 0.03) -> Model:
    """A model of vocabulary(cls int, word binary, n long), all of whose rows are used, in so many partitions.

    Tasks count into tables of their own, which are added up by segment (tables have a fixed size, so what
    reaches the driver is bounded: two bytes a slot, about 16 MB). Each task then takes its words in online steps from
    the same first weights, counting the map as it goes; weights are averaged by words, counts added up.
    """
    spark = vocabulary.sparkSession

    def tables(batches):
        import pyarrow as pa

        out = [np.zeros(2 << bits, np.float32) for bits in TABLE_BITS]
        for words, classes, times in _word_parts(batches):
            count_tables(words, classes, times, out)
        task = TaskContext.get().partitionId()
        for k in range(N_CONTEXTS):
            cells, out[k] = out[k], None
            halves = cells.reshape(2, -1)
            for at in range(0, halves.shape[1], SEGMENT):
                cell = halves[:, at : at + SEGMENT]
                if cell.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([task // FAN_IN], pa.int32()), pa.array([cell.astype("<f4").tobytes()], pa.binary())], names)
        out.clear()
        c.release_memory()

    def total_of(table):
        total = 0
        for x in table.column("counts"):
            total = total + np.frombuffer(x.as_buffer(), "<f4").astype(np.float64)
        return total

    def add(table):
        import pyarrow as pa

        total = total_of(table)
        return pa.table([table.column("k")[:1], table.column("at")[:1], pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int32()), pa.array([total.astype("<f4").tobytes()], pa.binary())], names=names)

    names = ["k", "at", "part", "counts"]
    schema = "k int, at int, part int, counts binary"
    vocabulary = c.materialise(vocabulary.repartition(parts, "word").sortWithinPartitions("word", "cls"), "spelled-words")
    counted = vocabulary.mapInArrow(tables, schema)
    while parts > FAN_IN:  # a group holds at most FAN_IN partial tables
        counted = counted.groupBy("k", "at", "part").applyInArrow(add, schema)
        parts = -(-parts // FAN_IN)

    def pack(table):
        import pyarrow as pa

        q = quantise(total_of(table)).astype(np.uint16).reshape(2, -1)
        return pa.table([table.column("k")[:1], table.column("at")[:1], pa.array([(q[1] * 256 + q[0]).astype("<u2").tobytes()], pa.binary())], names=["k", "at", "pairs"])

    packed = [np.zeros(1 << bits, np.uint16) for bits in TABLE_BITS]
    stored = c.materialise(counted.groupBy("k", "at", "part").applyInArrow(pack, "k int, at int, pairs binary"), "bit-tables")
    for row in stored.toLocalIterator():
        pairs = np.frombuffer(row.pairs, "<u2")
        packed[row.k][row.at : row.at + len(pairs)] = pairs
    c.drop(stored)
    first = spark.sparkContext.broadcast(packed)

    def online(batches):
        import pyarrow as pa

        model, squares, n = Model(first.value), np.zeros((N_GATES, N_CONTEXTS)), 0
        seen = np.zeros((2, 256 * MAP_STEPS))
        for words, classes, times in _word_parts(batches, rows=4096):
            learn(model, words, classes, times, squares, seen, rate)
            n += len(words)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), pa.array([seen.astype("<f8").tobytes()], pa.binary())], ["n", "weights", "seen"])

    mean, n, total = np.zeros((N_GATES, N_CONTEXTS)), 0, np.zeros((2, 256 * MAP_STEPS))
    learned = c.materialise(vocabulary.mapInArrow(online, "n long, weights binary, seen binary"), "weights")
    for r in learned.toLocalIterator():
        mean += r.n * np.frombuffer(r.weights, "<f4").reshape(mean.shape)
        total += np.frombuffer(r.seen, "<f8").reshape(total.shape)
        n += r.n
    c.drop(vocabulary, learned)
    first.destroy()
    mean = mean / n if n else None
    steps = np.tile(np.linspace(-_LIMIT, _LIMIT, MAP_STEPS), 256)
    prior = 1 / (1 + np.exp(-steps))
    refine = (total[1] + 20 * prior) / (total.sum(axis=0) + 20)
    return Model(packed, mean, np.clip(refine, 1e-5, 1 - 1e-5).astype(np.float32))


#: Kinds of rows of the table of chunks: some texts (n: their place in the chunk, a: ids, b: flags, c: lengths in bytes,
#: d: the texts, compressed), the chunk's words in a class (n: how many, m: their tokens in training text, a: hashes, b: training
#: counts, c and d: lengths and bytes of those that it has once), the keys asked for (n of a: keys, b: training counts; c
#: and d: the same of wide contexts).
_TEXTS, _WORDS, _KEYS = 0, 1, 2
_CHUNKS = "kind int, chunk long, cls int, n long, m long, a binary, b binary, c binary, d binary"
#: Kinds of rows of the table of words: for a chunk and class (n: the shard, a: counts in the class, b: over all), what a
#: shard says of the corpus (a: rows of _STATS), words that training text has once (a: lengths, b: bytes).
_ANSWER, _CORPUS, _ONCE = 0, 1, 2
#: Rows of (what, key, class, n): a frequent word by hash, a bin, tokens that are ends, the number of words.
_STATS = 4
_HEAVY, _BIN, _ENDS, _DISTINCT = 0, 1, 2, 3
_NULL_ID, _HELD_OUT = 1, 2
#: Figures of a wide context.
_FIGURES = 6


def _pack_texts(ids: list, held_out: list[bool], texts: list[bytes]) -> dict:
    import pyarrow as pa

    flags = bytes((i is None) * _NULL_ID + apart * _HELD_OUT for i, apart in zip(ids, held_out, strict=True))
    numbers = lambda xs: np.array(xs, "<i8").tobytes()
    return {"a": [numbers([i or 0 for i in ids])], "b": [flags], "c": [numbers([len(t) for t in texts])], "d": [pa.compress(b"".join(texts), "zstd", asbytes=True)]}


def _unpack_texts(a: bytes, b: bytes, c: bytes, d: bytes) -> tuple[list, np.ndarray, list[bytes]]:
    """Ids, which are held out, and texts."""
    import pyarrow as pa

    flags, lens = np.frombuffer(b, np.uint8), np.frombuffer(c, "<i8")
    ends = np.cumsum(lens)
    whole = pa.decompress(d, int(ends[-1]), "zstd", asbytes=True)
    ids = [None if f & _NULL_ID else i for i, f in zip(np.frombuffer(a, "<i8").tolist(), flags.tolist(), strict=True)]
    return ids, (flags & _HELD_OUT) > 0, [whole[e - n : e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]


def _planes(values: np.ndarray, kind: str = "<i8") -> bytes:
    """Numbers byte by byte, so that their high bytes compress."""
    return np.ascontiguousarray(values, kind).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def _from_planes(raw: bytes, kind: str = "<i8") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _tokens(texts: list[bytes]):
    """Each token's number among the distinct ones, these, and how many tokens each text has; the end is the empty word."""
    import pyarrow as pa
    import pyarrow.compute as pc

    # a space at the end leaves an empty word after it
    low = pa.array([t + b" " if t else t for t in (t.strip().lower() for t in texts)], pa.large_binary()).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(low)
    coded = lists.flatten().dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary.cast(pa.large_binary()), np.asarray(lists.value_lengths(), np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class _Words:
    """The distinct words of a chunk by class; every pass over the same texts gives the same ones in the same order."""

    def __init__(self):
        self.hashes, self.classes, self.times, self.words, self.n = [], [], [], [], 0

    def add(self, texts: list[bytes], classes: np.ndarray, learns: np.ndarray):
        """Each token's place among the words added, its hash, and how many tokens each text has."""
        codes, words, lens = _tokens(texts)
        hashes = word_hashes(_list(words))
        some, cls = np.unique(classes, return_inverse=True)
        pair = codes.astype(np.int64) * len(some) + np.repeat(cls, lens)
        there = np.bincount(pair, minlength=len(words) * len(some)) > 0
        found, start = np.flatnonzero(there), self.n
        self.hashes.append(hashes[found // len(some)])
        self.classes.append(some[found % len(some)])
        self.times.append(np.bincount(pair, np.repeat(learns, lens), len(there))[found].astype(np.int64))
        self.words.append(words.take(found // len(some)))
        self.n += len(found)
        return start + (np.cumsum(there) - 1)[pair], hashes[codes], lens

    def merged(self):
        """The words, by class and hash: classes, hashes, training counts, a place among those added; and of all added ones the place here."""
        hashes, classes, times = (np.concatenate(x) for x in (self.hashes, self.classes, self.times))
        order = np.argsort(hashes)
        order = order[np.argsort(classes[order].astype(np.uint8), kind="stable")]
        first = np.append(True, (hashes[order[1:]] != hashes[order[:-1]]) | (classes[order[1:]] != classes[order[:-1]]))
        places = np.empty(self.n, np.int64)
        places[order] = np.cumsum(first) - 1
        one = order[first]
        return classes[one], hashes[one], np.bincount(places, times, len(one)).astype(np.int64), one, places

    def names(self, places: np.ndarray):
        """The words at these places among those added."""
        import pyarrow as pa

        return pa.chunked_array(self.words).combine_chunks().take(pa.array(places))


def _rows(kind: int, n_rows: int, /, **columns):
    """A batch of n_rows rows of the table of chunks."""
    import pyarrow as pa

    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    columns["kind"] = np.full(n_rows, kind, np.int32)
    fields = [x.split() for x in _CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], types[t]) if name in columns else pa.nulls(n_rows, types[t]) for name, t in fields], [name for name, _ in fields])


def _chunk_rows(batches):
    """The texts by chunk, each chunk's distinct words by class with training counts, and its keys.

    Texts get their chunk here, once; all that follows reads it from this table.
    """
    task = TaskContext.get().partitionId()

    def finish():
        classes, hashes, times, one, _ = words.merged()
        for cls in np.unique(classes).tolist():
            own = np.flatnonzero(classes == cls)
            once = _list(words.names(one[own[times[own] == 1]]))
            lens = np.fromiter(map(len, once), np.int64, len(once))
            yield _rows(_WORDS, 1, chunk=[chunk], cls=[cls], n=[len(own)], m=[int(times[own].sum())], a=[_follow.to_bytes(hashes[own])], b=[_planes(times[own])], c=[_planes(lens)], d=[b"".join(once)])
        keys, times, wide, wide_times = _follow.requests(np.concatenate(found), np.concatenate(learned), places=False)
        yield _rows(_KEYS, 1, chunk=[chunk], n=[len(keys)], a=[_follow.to_bytes(keys)], b=[times.astype("<u4").tobytes()], c=[_follow.to_bytes(wide)], d=[wide_times.astype("<u4").tobytes()])

    c.hold_memory()
    k, size, words, found, learned = 0, 0, _Words(), [], []
    for part in in_parts(batches, rows=4096, chars=4_000_000):
        chunk = (task << 32) + k
        texts, out = part.column("text").to_pylist(), part.column("held_out").to_pylist()
        yield _rows(_TEXTS, 1, chunk=[chunk], n=[len(found)], **_pack_texts(part.column("doc_id").to_pylist(), out, texts))
        learns = ~np.array(out, bool)
        _, hashes, lens = words.add(texts, np.array([text_class(t) for t in texts]), learns)
        found.append(_follow.triples(hashes, np.cumsum(lens) - lens))
        learned.append(np.repeat(learns, lens))
        size += sum(map(len, texts))
        if size > CHUNK_BYTES:
            yield from finish()
            k, size, words, found, learned = k + 1, 0, _Words(), [], []
            c.release_memory()
            c.hold_memory()
    if found:
        yield from finish()
    c.release_memory()


def _word_requests(batches, shards: int):
    """A chunk's words in a class, cut by shard."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        for r in b.to_pylist():
            hashes, times, lens = _follow.from_bytes(r["a"]), _from_planes(r["b"]), _from_planes(r["c"])
            cuts, once, ends = _follow.by_shard(hashes, shards), np.append(0, np.cumsum(times == 1)), np.append(0, np.cumsum(lens))
            full = np.flatnonzero(np.diff(cuts))
            parts = [(cuts[s], cuts[s + 1], once[cuts[s]], once[cuts[s + 1]]) for s in full]
            blobs = [[_follow.to_bytes(hashes[x:y]), _planes(times[x:y]), _planes(lens[i:j]), pack(r["d"][ends[i] : ends[j]])] for x, y, i, j in parts]
            columns = [pa.array([row[k] for row in blobs], pa.binary()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(np.full(len(full), r["chunk"])), pa.array(np.full(len(full), r["cls"], np.int32)), *columns], ["shard", "chunk", "cls", "a", "b", "c", "d"])


_WORD_TABLE = "kind int, chunk long, cls int, n long, a binary, b binary"


def _count_words(table, train_tokens: int):
    """Answers to all chunks that asked a shard, what the shard says of the corpus, and its words that training text has once."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    chunks, classes = table.column("chunk").to_pylist(), np.asarray(table.column("cls"))
    hashes = [_follow.from_bytes(x.as_buffer()) for x in table.column("a")]
    times = [_from_planes(x.as_buffer()) for x in table.column("b")]
    cuts = np.append(0, np.cumsum([len(h) for h in hashes]))
    of_class, every = np.repeat(classes, np.diff(cuts)), np.concatenate(times)
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    known = np.bincount(place, every, len(distinct)).astype(np.int64)
    pair, back = np.unique(place * N_CLASSES + of_class, return_inverse=True)
    in_pair = np.bincount(back, every, len(pair)).astype(np.int64)
    in_class, overall = in_pair[back], known[place]
    rows = [(_ANSWER, chunk, cls, table.column("shard")[0].as_py(), _planes(in_class[x:y]), _planes(overall[x:y])) for chunk, cls, x, y in zip(chunks, classes.tolist(), cuts[:-1], cuts[1:], strict=True)]
    word, cls = np.divmod(pair[in_pair > 0], N_CLASSES)
    n = in_pair[in_pair > 0]
    heavy, ends = known[word] * _codes.HEAVY >= train_tokens, distinct[word] == word_hashes([b""])[0]
    bins = np.bincount(_codes.bin_of(distinct[word[~heavy]]) * N_CLASSES + cls[~heavy], n[~heavy], _codes.BINS * N_CLASSES).astype(np.int64)
    full = np.flatnonzero(bins)
    # a hash keeps its bits as a signed number
    stats = [(_HEAVY, distinct[word[heavy]].view(np.int64), cls[heavy], n[heavy]), (_BIN, full // N_CLASSES, full % N_CLASSES, bins[full]), (_ENDS, 0 * cls[ends], cls[ends], n[ends]), (_DISTINCT, [0], [0], [(known > 0).sum()])]
    rows.append((_CORPUS, None, None, None, b"".join(np.stack([np.full(len(x[1]), what), *x], axis=1).astype("<i8").tobytes() for what, *x in stats), None))
    for k in range(len(chunks)):
        some = slice(cuts[k], cuts[k + 1])
        alone = overall[some][times[k] == 1] == 1
        if alone.any():
            lens = _from_planes(table.column("c")[k].as_buffer())
            names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(np.append(0, np.cumsum(lens))), pa.py_buffer(unpack(table.column("d")[k].as_py()))])
            names = names.filter(pa.array(alone))
            rows.append((_ONCE, None, classes[k], None, _planes(np.asarray(pc.binary_length(names), np.int64)), b"".join(_list(names))))
    c.release_memory()
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["kind", "chunk", "cls", "n", "a", "b"])


def _last_in_text(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token: whether the word before it stood in the text before, and whether the same word followed then.

    words are numbers below that of tokens, alike for equal words of a text; texts follow one another.
    """
    n = len(words)
    # each token's word before and place in one number, so tokens after one word come in their order
    order = (words[:-1] * n + np.arange(1, n)) if n else words
    order.sort()
    order %= max(n, 1)
    # tokens and those that last came after the same word; a text's first token comes after none
    last, own = order[:-1], order[1:]
    some = (words[own - 1] == words[last - 1]) & (text[own] == text[last]) & (text[last - 1] == text[last])
    last, own = last[some], own[some]
    exists, hit = np.zeros(n, bool), np.zeros(n, bool)
    exists[own] = True
    hit[own] = words[own] == words[last]
    return exists, hit


def decide(hashes: np.ndarray, text: np.ndarray, classes: np.ndarray, codes: np.ndarray, known: np.ndarray, learns: np.ndarray, exists: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """The log10 probability of each token's decisions 1 to 3; all arrays by token, in text order.

    codes are _follow's, known says that decision 3 is true, exists that there is a decision 2
    and repeats that it is true.
    """
    # training texts first, which learn; then held-out ones, by what was learned from the chunk
    mixer, out = _online.Mixer(5, 18), np.zeros(len(hashes))
    for some in (np.flatnonzero(learns), np.flatnonzero(~learns)):
        own = [x[some] for x in (hashes, text, classes, codes, known, learns, exists, repeats)]
        for at in range(0, len(some), AT_ONCE):
            lead = min(at, 3)  # contexts look back over three tokens
            out[some[at : at + AT_ONCE]] = _decide(mixer, lead, *[x[at - lead : at + AT_ONCE] for x in own])
    return out


def _decide(mixer: _online.Mixer, lead: int, hashes, text, classes, codes, known, learns, exists, repeats) -> np.ndarray:
    n = len(hashes)
    hit = (codes & 1).astype(bool)
    asked = np.stack([codes > 0, exists & ~hit, ~(hit | repeats)])
    bits = np.stack([hit, repeats, known])
    # how each token came out: 1 and 2 for these decisions, then known, spelled
    outcome = np.where(hit, 1, np.where(repeats, 2, np.where(known, 3, 4)))
    back = []
    for k in (1, 2, 3):
        x = np.zeros(n, np.intp)
        x[k:] = np.where(text[k:] == text[:-k], outcome[:-k], 0)
        back.append(x)
    before = np.zeros(n, np.uint64)
    before[1:] = np.where(text[1:] == text[:-1], hashes[:-1], 0)
    asked[:, :lead] = False
    token, step = np.nonzero(asked.T)
    kind = step.astype(np.uint64)
    # the favourite's code without the bit itself; after decision 1 it is known that it failed
    code = (codes >> 1)[token] + 64 * step
    history = ((back[0] * 8 + back[1]) * 8 + back[2])[token] + 512 * step
    recent = (back[0] * 8 + back[1])[token]
    last = recent >> 3
    salt = [np.uint64(k) << np.uint64(40) for k in range(5)]
    # most contexts have few values, whose hashes are looked up
    by = lambda k, values, index: _follow.scramble(values.astype(np.uint64) + salt[k]).take(index)
    numbers = np.arange(64 * 4 * 64)
    contexts = [
        by(0, numbers[: 64 * 4], code),
        by(1, numbers[: 512 * 4], history),
        by(2, (numbers >> 6) * 4096 + (numbers & 63), code * 64 + recent),
        _follow.scramble(_follow.scramble(before[token] + kind) ^ salt[3]),
        by(4, numbers[: 64 * N_CLASSES], (classes[token].astype(np.intp) * 8 + last) * 8 + step),
    ]
    lp = mixer.predict(contexts, step * 6 + last, bits[step, token], learns[token])
    return np.bincount(token, lp, n)[lead:]


def tell(words: _codes.Codes, leaf: np.ndarray, classes: np.ndarray, at: np.ndarray, hashes: np.ndarray, text: np.ndarray, learns: np.ndarray) -> np.ndarray:
    """The log10 probability of the codes of the known words at these tokens, bit by bit, in text order.

    leaf, classes and learns are by word, hashes and text by token. What counts in the class and over all classes say
    of a bit is mixed with what followed the word before in the chunk.
    """
    mixer, out = _online.CodeMixer(2, 1), np.zeros(len(leaf))
    for some, teach in ((np.flatnonzero(learns), True), (np.flatnonzero(~learns), False)):
        for x in range(0, len(some), CODES_AT_ONCE):
            own = some[x : x + CODES_AT_ONCE]
            of, bit, salt, given = words.expand(leaf[own], classes[own], teach)
            token = at[own]
            before = _follow.scramble(np.where((token > 0) & (text[token - 1] == text[token]), hashes[token - 1], 0))
            out[own] = np.bincount(of, mixer.predict(given, [before.take(of) + salt], bit, teach), len(own))
    return out


def score(docs: DataFrame, fold: int = 2, folds: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    Rows for which crc32 of the id as text (a null id: as the empty text) modulo folds is fold are held
    out, and nothing is learned from them. score is the model's log10 probability of the whole text,
    base_score that of token counts with one added. A null or empty text is the end alone. Repeated
    rows are learned from and scored like others. Without training rows the model is the untrained one.
    What is learned online starts anew in each chunk of texts; held-out texts are scored by all that their chunk's
    training texts taught. Texts are dealt to chunks by a hash of id and text, so that scores depend on
    the rows and not on how they lie in files or partitions.
    """
    spark = docs.sparkSession
    held_out = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % folds == fold
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    # texts in an order of their own, so that chunks are the same however the rows come
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = min(MAX_PARTITIONS, max(1, -(-size // (2 * CHUNK_BYTES))))
    rows = rows.withColumn("deal", F.xxhash64("doc_id", "text")).repartition(slices, "deal").sortWithinPartitions("deal").drop("deal")
    with c.small_batches(spark):
        chunks = c.materialise_by(rows.mapInArrow(_chunk_rows, _CHUNKS), "chunks", "kind", [_TEXTS, _WORDS, _KEYS], "zstd")
    c.free_shuffles(spark)
    of = chunks.get

    # words: asked for by shards of their hashes, which sum all chunks' counts by class and over all classes
    asked = of(_WORDS).agg(F.sum("n"), F.sum("m")).first()
    word_shards, train_tokens = max(1, -(-(asked[0] or 0) // SHARD_KEYS)), asked[1] or 0
    sliced = of(_WORDS).select("chunk", "cls", "a", "b", "c", "d").mapInArrow(lambda batches: _word_requests(batches, word_shards), "shard long, chunk long, cls int, a binary, b binary, c binary, d binary")
    with c.small_batches(spark, 200):
        counted = c.materialise_by(sliced.groupBy("shard").applyInArrow(lambda table: _count_words(table, train_tokens), _WORD_TABLE), "words", "kind", [_ANSWER, _CORPUS, _ONCE], "zstd")
    c.drop(of(_WORDS))
    c.free_shuffles(spark)

    def stats(batches):
        import pyarrow as pa

        for b in batches:
            rows = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8").reshape(-1, _STATS)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in rows.T], ["what", "key", "cls", "n"])

    # at most HEAVY words and BINS bins for each class
    corpus = counted[_CORPUS].select("a").mapInArrow(stats, "what long, key long, cls long, n long").groupBy("what", "key", "cls").agg(F.sum("n").alias("n")).toPandas()
    corpus = corpus.sort_values(["what", "key", "cls"]).astype("int64")
    what, key, cls, n = (corpus[x].to_numpy() for x in ("what", "key", "cls", "n"))
    denominator = train_tokens + int(n[what == _DISTINCT].sum()) + 1
    ends = np.bincount(cls[what == _ENDS], n[what == _ENDS], N_CLASSES)
    class_cost = np.log10((ends + 1) / (ends.sum() + N_CLASSES))
    heavy = np.unique(key[what == _HEAVY].view(np.uint64))
    leaves = np.zeros((N_CLASSES, len(heavy) + _codes.BINS))
    np.add.at(leaves, (cls[what == _HEAVY], np.searchsorted(heavy, key[what == _HEAVY].view(np.uint64))), n[what == _HEAVY])
    np.add.at(leaves, (cls[what == _BIN], len(heavy) + key[what == _BIN]), n[what == _BIN])
    told_by = _codes.Codes(heavy, leaves)
    tasks = lambda n: max(1, -(-n // TASK_WORDS))

    # spelling: learned from words seen once, needed for them and for those not seen
    def words_of(batches):
        import pyarrow as pa

        for b in batches:
            for cls, lens, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ends = np.append(0, np.cumsum(_from_planes(lens)))
                names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), cls, np.int32)), names, pa.array(np.ones(len(names), np.int64))], ["cls", "word", "n"])

    once = counted[_ONCE].select("cls", "a", "b").mapInArrow(words_of, "cls int, word binary, n long")
    n_once = int((counted[_ONCE].agg(F.sum(F.octet_length("a"))).first()[0] or 0) // 8)
    model = train(once, tasks(n_once))
    c.drop(counted[_ONCE], counted[_CORPUS])
    shipped = spark.sparkContext.broadcast((told_by, model.tables, model.weights, model.refine))
    c.free_shuffles(spark)

    # what follows two words: keys by shard, answered with all training text in view
    asked = of(_KEYS).agg(F.sum("n"), F.count(F.lit(1))).first()
    shards, n_chunks = max(1, -(-(asked[0] or 0) // SHARD_KEYS)), max(1, asked[1])

    def narrow_keys(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for chunk, raw, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                keys = _follow.from_bytes(raw)
                cuts = _follow.by_shard(keys, shards)
                full = np.flatnonzero(np.diff(cuts))
                times = np.frombuffer(times, "<u4")
                blobs = [pack(_follow.to_bytes(keys[cuts[s] : cuts[s + 1]])) for s in full]
                counts = [pack(_planes(times[cuts[s] : cuts[s + 1]], "<u4")) for s in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(np.full(len(full), chunk)), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], ["shard", "chunk", "keys", "times"])

    def wide_counts(batches):
        import pyarrow as pa

        for b in batches:
            for raw, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, times = _follow.from_bytes(raw), np.frombuffer(times, "<u4").astype(np.int64)
                keys, times = keys[times > 0], times[times > 0]
                yield pa.RecordBatch.from_arrays([pa.array(_follow.shard_of(keys, shards).astype(np.int64)), pa.array(keys.view(np.int64)), pa.array(times)], ["shard", "key", "n"])

    def wide_blobs(batches):
        """The summed counts, some thousands in a row."""
        import pyarrow as pa

        for b in batches:
            shard, order = np.asarray(b.column(0)), np.argsort(np.asarray(b.column(0)), kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)), len(order)) if len(order) else [0]
            parts = [order[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            keys, n = np.asarray(b.column(1)), np.asarray(b.column(2))
            yield pa.RecordBatch.from_arrays([pa.array([shard[x[0]] for x in parts], pa.int64()), pa.array([keys[x].tobytes() for x in parts], pa.binary()), pa.array([n[x].tobytes() for x in parts], pa.binary())], ["shard", "keys", "n"])

    def wide_contexts(batches):
        import pyarrow as pa

        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                contexts = _follow.contexts_of(_follow.from_bytes(raw))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(contexts), chunk)), pa.array(contexts)], ["chunk", "context"])

    def serve(table, wide):
        """A row for each chunk that asked; with a null chunk, the figures of the shard's wide contexts."""
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        asked = [(_follow.from_bytes(unpack(k.as_buffer())), _from_planes(unpack(t.as_buffer()), "<u4")) for k, t in zip(table.column("keys"), table.column("times"), strict=True)]
        found, figures = _follow.answer(asked, tuple(np.frombuffer(b"".join(wide.column(n).to_pylist()), t) for n, t in (("keys", np.uint64), ("n", np.int64))))
        c.release_memory()
        held, trained = [h.tobytes() for h, _ in found], [t.tobytes() for _, t in found]
        shard = (table if found else wide).column("shard")[0].as_py()
        return pa.table([pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), pa.array([shard] * (len(found) + 1), pa.int64()), pa.array([*held, figures.tobytes()], pa.binary()), pa.array([*trained, None], pa.binary())], names=["chunk", "shard", "if_held", "if_trained"])

    def by_context(batches):
        import pyarrow as pa

        for b in batches:
            for raw in b.column(0).to_pylist():
                figures = np.frombuffer(raw, np.int64).reshape(-1, _FIGURES)
                yield pa.RecordBatch.from_arrays([pa.array(figures[:, 0]), pa.array([x.tobytes() for x in figures], pa.binary())], ["context", "figures"])

    sliced = of(_KEYS).select("chunk", "a", "b").mapInArrow(narrow_keys, "shard long, chunk long, keys binary, times binary")
    summed = of(_KEYS).select("c", "d").mapInArrow(wide_counts, "shard long, key long, n long").groupBy("shard", "key").agg(F.sum("n").alias("n"))
    summed = summed.mapInArrow(wide_blobs, "shard long, keys binary, n binary")
    answers = sliced.groupBy("shard").cogroup(summed.groupBy("shard")).applyInArrow(serve, "chunk long, shard long, if_held binary, if_trained binary")
    answers = c.materialise(answers, "followers", "zstd")
    figures = answers.where("chunk IS NULL").select("if_held").mapInArrow(by_context, "context long, figures binary")
    wide = of(_KEYS).select("chunk", "c").mapInArrow(wide_contexts, "chunk long, context long").join(figures, "context").select("chunk", F.lit(-1).cast("long").alias("shard"), F.col("figures").alias("if_held"))
    wide = c.materialise(wide, "wide-contexts", "zstd")
    c.drop(of(_KEYS))
    c.free_shuffles(spark)

    # rows of a chunk by kind: texts, codes by shard, figures of wide contexts, words by class and shard
    row = lambda frame, kind, *columns: frame.select("chunk", F.lit(kind).alias("kind"), *[(F.col(x) if x else F.lit(None).cast(t)).alias(name) for x, (name, t) in zip(columns, (("cls", "int"), ("n", "long"), ("a", "binary"), ("b", "binary"), ("c", "binary"), ("d", "binary")), strict=True)])
    texts = row(of(_TEXTS), 0, None, "n", "a", "b", "c", "d").unionByName(row(answers.where("chunk IS NOT NULL"), 1, None, "shard", "if_held", "if_trained", None, None))
    texts = texts.unionByName(row(wide, 2, None, "shard", "if_held", None, None, None)).unionByName(row(counted[_ANSWER], 3, "cls", "n", "a", "b", None, None))
    texts = texts.repartition(min(MAX_PARTITIONS, n_chunks), "chunk")

    def look_up(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        c.hold_memory()
        of_kind = lambda kind, *by: table.filter(pc.equal(table.column("kind"), kind)).sort_by([(x, "ascending") for x in by])
        blobs = lambda rows, name: b"".join(rows.column(name).to_pylist())
        answered, figures, counts = of_kind(1, "n"), blobs(of_kind(2, "n"), "a"), of_kind(3, "cls", "n")
        counts_in, counts_all = (np.concatenate([_from_planes(x) for x in counts.column(name).to_pylist()]) for name in "ab")
        words, ids, held, at, lens, raw_lens, classes, hashes = _Words(), [], [], [], [], [], [], []
        for packed in zip(*[of_kind(0, "n").column(n).to_pylist() for n in "abcd"], strict=True):
            own_ids, apart, raw = _unpack_texts(*packed)
            own = np.array([text_class(t) for t in raw])
            place, hashed, n = words.add(raw, own, ~apart)
            ids += own_ids
            held.append(apart)
            at.append(place)
            hashes.append(hashed)
            lens.append(n)
            classes.append(own.astype(np.int8))
            raw_lens += map(len, raw)
        del table, counts
        held, at, lens, classes, hashes = (np.concatenate(x) for x in (held, at, lens, classes, hashes))
        word_classes, word_hash, _, one, places = words.merged()
        at = places[at]
        del places
        text = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        learns, cls = ~held[text], classes[text]
        *_, wide_keys, _, place = _follow.requests(_follow.triples(hashes, np.cumsum(lens) - lens), learns)
        of_wide = _follow.wide_codes(wide_keys, np.frombuffer(figures, np.int64).reshape(-1, _FIGURES)) if len(wide_keys) else [np.empty(0, np.uint8)] * 2
        codes = [np.append(np.frombuffer(blobs(answered, n), np.uint8), own)[place] for n, own in zip("ab", of_wide, strict=True)]
        codes = np.where(learns, codes[1], codes[0])
        del place, answered
        n_all = counts_all[at]
        own_all = n_all - learns  # without the occurrence itself
        exists, repeats = _last_in_text(at, text)
        told, known = (codes & 1).astype(bool) | repeats, own_all > 0
        lp = decide(hashes, text, cls, codes, known, learns, exists, repeats)
        # known words by their codes
        codes_of, *spelling = shipped.value
        some = np.flatnonzero(known & ~told)
        leaf = codes_of.leaf_of(word_hash)[at[some]]
        lp[some] += tell(codes_of, leaf, cls[some], some, hashes, text, learns[some])
        lp[some] += codes_of.within(leaf, cls[some], counts_in[at[some]] - learns[some], own_all[some], learns[some].astype(np.int64))
        del leaf
        # others are spelled, each distinct one once
        some = np.flatnonzero(~known & ~told)
        new = np.flatnonzero(np.bincount(at[some], minlength=len(one)))
        model, costs = Model(*spelling), np.zeros(len(one))
        # by class and spelling, so that words which begin alike are spelled together
        spelt = pa.table({"cls": word_classes[new], "learned": counts_all[new] > 0, "word": words.names(one[new]), "place": new})
        spelt = spelt.sort_by([(x, "ascending") for x in ("cls", "learned", "word")])
        for part in in_parts(spelt.to_batches(max_chunksize=8192), rows=8192, chars=400_000):
            costs[np.asarray(part.column("place"))] = model.log10_words(_list(part.column("word")), np.asarray(part.column("cls")).astype(np.int64), part.column("learned").to_numpy(zero_copy_only=False))
        lp[some] += costs[at[some]]
        add = lambda x: np.bincount(text, x, len(lens))
        whole = add(lp) + class_cost[classes]
        bits = -whole * np.log2(10) / np.maximum(raw_lens, 1)
        out = pa.table([pa.array(ids, pa.int64()), pa.array(held), pa.array(lens), pa.array(add(n_all > 0).astype(np.int64)), pa.array(np.full(len(lens), train_tokens, np.int64)), pa.array(add(np.log10((counts_all + 1) / denominator)[at])), pa.array(whole), pa.array(bits)], names=names)
        c.release_memory()
        return out

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    with c.small_batches(spark):
        out = c.materialise(texts.groupBy("chunk").applyInArrow(look_up, schema), "scores")
    shipped.destroy()
    c.drop(of(_TEXTS), counted[_ANSWER], answers, wide)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return score(c.table(spark, sf_dir, "documents"))
