"""Token ids as binary files: frequency-ranked, in byte-aligned variable-length coding.

A shard file holds a range of document ids in ascending order, as blocks that decode alone. A block ranks its
ids by how often it holds them and writes each rank in one to four bytes, with the byte lengths apart, two bits
each, in control bytes; so frequent ids take one byte. numpy decodes a block by looking lengths up for
each control byte. Each text is encoded once: a block's ranks need no counts from elsewhere.

A block: the magic bytes, four little-endian 64-bit numbers (documents, ids, different ids, data bytes); the
different ids by rank (32 bits); for all documents their ids (64 bits), null flags (8 bits) and lengths
(64 bits); the control bytes; the data bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eocatalog.llm import _common as c
from eocatalog.llm._chunks import encoder, in_parts

MAGIC = b"RVB1"
_HEAD = struct.Struct("<4sQQQQ")
#: Ids of a block before the next one begins.
BLOCK_IDS = 1_000_000
#: For each control byte, the lengths of its four numbers.
_LENGTHS = np.array([[1 + (b >> s & 3) for s in (0, 2, 4, 6)] for b in range(256)], np.uint8)


def encode_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    values = np.ascontiguousarray(values, "<u4")
    codes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = codes
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    cells = values.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8), cells[np.arange(4) <= codes[:, None]]


def decode_numbers(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lengths = _LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    out = data[at].astype(np.uint32) if n else np.empty(0, np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def rank_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, the most frequent first (ties by id), and for each id its place among them."""
    times = np.bincount(ids)
    seen = np.flatnonzero(times)
    by_rank = seen[np.lexsort((seen, -times[seen]))]
    place = np.zeros(len(times), np.uint32)
    place[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    return by_rank, place[ids]


def write_block(out, doc_ids: list, lens: np.ndarray, ids: np.ndarray) -> None:
    by_rank, ranks = rank_ids(ids)
    control, data = encode_numbers(ranks)
    out.write(_HEAD.pack(MAGIC, len(doc_ids), len(ids), len(by_rank), len(data)))
    out.write(by_rank.astype("<u4").tobytes())
    out.write(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.write(lens.astype("<u8").tobytes())
    out.write(control.tobytes())
    out.write(data.tobytes())


def read_blocks(source):
    """doc_ids, lengths and ids of each block of an open file."""
    while head := source.read(_HEAD.size):
        magic, n_docs, n_ids, n_ranks, n_data = _HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        by_rank = np.frombuffer(source.read(4 * n_ranks), "<u4")
        doc_ids = np.frombuffer(source.read(8 * n_docs), "<i8")
        nulls = np.frombuffer(source.read(n_docs), np.uint8)
        lens = np.frombuffer(source.read(8 * n_docs), "<u8").astype(np.int64)
        control = np.frombuffer(source.read(-(-n_ids // 4)), np.uint8)
        data = np.frombuffer(source.read(n_data), np.uint8)
        yield [None if x else int(d) for d, x in zip(doc_ids, nulls, strict=True)], lens, by_rank[decode_numbers(control, data, n_ids)]


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, shard_docs: int = 6_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts, each with end_id after it, below path; returns the list of shards.

    Columns: shard, file, n_docs, n_ids, start (ids in all shards before). Shards ascend by document
    id; null ids come first, equal ids in the order of a hash of their text. A null text is empty. A task
    that runs again writes a file of another name, and only files in the list count. An empty table gives an
    empty list.
    """
    spark = docs.sparkSession
    fs, root = c.file_system(path)
    fs.create_dir(root, recursive=True)

    def write(batches):
        import pyarrow as pa

        fs, root = c.file_system(path)
        e = encoder(tokenizer)
        name, n_docs, n_ids, out = f"{uuid.uuid4().hex}.ids", 0, 0, None
        names, lengths, ids, size = [], [], [], 0
        for part in in_parts(batches, chars=2_000_000):
            out = out or fs.open_output_stream(f"{root}/{name}")
            flat, lens = e.encode(part.column(1).to_pylist())
            ids.append(np.insert(flat, np.cumsum(lens), end_id))
            names += part.column(0).to_pylist()
            lengths.append(lens + 1)
            size += len(ids[-1])
            n_docs, n_ids = n_docs + part.num_rows, n_ids + len(ids[-1])
            if size > BLOCK_IDS:
                write_block(out, names, np.concatenate(lengths), np.concatenate(ids))
                names, lengths, ids, size = [], [], [], 0
        if names:
            write_block(out, names, np.concatenate(lengths), np.concatenate(ids))
        if out:
            out.close()
            c.release_memory()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["shard", "file", "n_docs", "n_ids"])

    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_shards = max(1, -(-docs.count() // shard_docs))
    tie = F.xxhash64("text")
    ordered = pair.repartitionByRange(n_shards, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    with c.small_batches(spark):
        written = c.materialise(ordered.mapInArrow(write, "shard int, file string, n_docs long, n_ids long"), "shards")
    shards = written.toPandas().sort_values("shard")
    shards["start"] = shards["n_ids"].cumsum() - shards["n_ids"]
    return spark.createDataFrame([tuple(r) for r in shards.itertuples(index=False)], "shard int, file string, n_docs long, n_ids long, start long")


def _read(shards: DataFrame, path: str, value, column: str) -> DataFrame:
    """doc_id, start, n_tokens and a value of the ids' bytes of all listed shards.

    It is worked out where a file is read: a second Python step would have workers of its own, which live on and
    come to hold a tokenizer's tables, as those that write do.
    """

    def read(batches):
        import pyarrow as pa

        fs, root = c.file_system(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}") as source:
                    for doc_ids, lens, ids in read_blocks(source):
                        ids, ends = ids.astype("<u4"), np.cumsum(lens)
                        own = [value(x.tobytes()) for x in np.split(ids, ends[:-1])]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lens), pa.array(lens), pa.array(own)], ["doc_id", "start", "n_tokens", column.split()[0]])
                        start += int(ends[-1])

    n = max(1, shards.count())
    return shards.select("file", "start").repartition(n).mapInArrow(read, f"doc_id long, start long, n_tokens long, {column}")


def read_ids(shards: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers) of all listed shards."""
    return _read(shards, path, bytes, "ids binary")


def read_digests(shards: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_ids gives."""
    return _read(shards, path, zlib.crc32, "ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = c.table(spark, sf_dir, "documents")
    path = c.new_path(spark, "token-ids")
    shards = write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), path, end_id=0)
    return read_digests(shards, path)
