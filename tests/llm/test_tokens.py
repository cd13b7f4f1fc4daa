"""Token ids, counts and packing, against the libraries on whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from eocatalog.llm import _common, packing, token_counts, token_ids
from eocatalog.llm._chunks import ChunkEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_give_the_ids_of_whole_texts(path, rows):
    texts = [r[1] for r in rows if r[1] is not None]
    texts += ["a  b", " a", "a ", "a\n b", "a \n\nb", "it's  'll x", "a\x1cb \x1cc", "a\x85b", "5 6  7.8!?", "　x　 y", "é ́"]
    flat, lens = ChunkEncoder(path).encode(texts)
    t = Tokenizer.from_file(path)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert lens.tolist() == list(map(len, want))
    assert flat.tolist() == [i for ids in want for i in ids]


def test_numbers_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)
        control, data = token_ids.encode_numbers(values.astype(np.uint32))
        assert token_ids.decode_numbers(control, data, n).tolist() == values.tolist()


def test_token_ids_files(spark, docs, rows):
    path = _common.new_path(spark, "test-ids")
    shards = token_ids.write_ids(docs, BYTE, path, shard_docs=40)
    assert shards.count() > 1
    got = {r.doc_id: r for r in token_ids.read_digests(shards, path).collect()}
    t, start = Tokenizer.from_file(BYTE), 0
    for doc_id, text, *_ in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        r = got.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert not got


def test_token_ids_frequent_ids_take_one_byte():
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.full(900, 40_000), rng.integers(0, 50_000, 2000), np.full(500, 7)]).astype(np.int32)
    by_rank, ranks = token_ids.rank_ids(ids)
    assert by_rank[:2].tolist() == [40_000, 7]
    assert by_rank[ranks].tolist() == ids.tolist()
    control, data = token_ids.encode_numbers(ranks)
    assert len(data) <= 1400 + 2 * 2000


def test_chunks_stay_right_when_the_cache_is_small(monkeypatch, rows):
    from eocatalog.llm import _chunks

    monkeypatch.setattr(_chunks, "KEPT_CHUNKS", 50)
    texts, t, e = [r[1] for r in rows if r[1]], Tokenizer.from_file(BYTE), ChunkEncoder(BYTE)
    for at in range(0, len(texts), 5):
        flat, _ = e.encode(texts[at : at + 5])
        assert flat.tolist() == [i for x in texts[at : at + 5] for i in t.encode(x, add_special_tokens=False).ids]


def test_token_ids_odd_rows(spark, odd, empty):
    path = _common.new_path(spark, "test-ids")
    got = token_ids.read_digests(token_ids.write_ids(odd, BYTE, path), path).collect()
    assert sorted(r.doc_id is None for r in got) == [False] * 5 + [True] * 2
    assert sorted(r.start for r in got)[0] == 0
    path = _common.new_path(spark, "test-ids")
    assert token_ids.read_digests(token_ids.write_ids(empty, BYTE, path), path).count() == 0


def unigram():
    pieces, lowest = token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    special = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    return Tokenizer(models.Unigram(special + pieces, unk_id=0, byte_fallback=True)), pieces, lowest


def test_token_counts_equal_the_library(docs, rows):
    library, *_ = unigram()
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for doc_id, text, *_ in rows:
        marked = "▁" + text.replace(" ", "▁") if text else ""
        assert got[doc_id] == len(library.encode(marked, add_special_tokens=False).ids), text


def test_token_counts_ties_take_the_longest_last_piece():
    # "ab" as a+b and as ab have equal scores: the piece that starts first stays
    counter = token_counts.UnigramCounter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", 0.0)], -2.0)
    assert counter.segment("ab") == (1, -2.0)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0)], unk_id=0))
    assert len(library.encode("ab").ids) == 1


def check_packing(got, rows, size):
    t = Tokenizer.from_file(WORD)
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[doc_id].append(ids)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == want.keys()
    for doc_id, texts in want.items():
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(texts[0]))
                assert r.ids_crc32 == crc(texts[0][at : at + r.length])
                at += r.length
            assert at == len(texts[0])
        else:
            assert sum(r.length for r in pieces[doc_id]) == sum(map(len, texts))
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    fills = []
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        fills.append(at)
    assert sorted(fills)[1:] == [size] * (len(fills) - 1) and max(fills) <= size


@pytest.mark.parametrize("size", [64, 4096])
def test_packing(docs, rows, size):
    check_packing(packing.pack(docs, WORD, 2, size).collect(), rows, size)


def test_packing_odd_rows(odd, empty):
    check_packing(packing.pack(odd, WORD, 2, 16).collect(), [tuple(r) for r in odd.collect()], 16)
    assert packing.pack(empty, WORD, 2).count() == 0


def test_sum_of_squares_picks_the_least_sum():
    rng = np.random.default_rng(2)
    size = 20
    for max_open in (3, 6, 1000):
        p = packing.SumOfSquares(size, max_open)
        for k in range(300):
            length = int(rng.integers(1, size + 1))
            before = p.levels.copy()

            def after(h, before=before, length=length):
                n = before.copy()
                if h:
                    n[h] -= 1
                n[h + length if h + length <= size else h + length - size] += 1
                n[size] = 0
                return int((n.astype(int) ** 2).sum())

            at_bound = p.n_open >= max_open and before.any()
            fits = [h for h in range(size) if (h == 0 or before[h]) and h + length <= size and not (at_bound and h == 0 and length < size)]
            cuts = [h for h in range(size) if before[h] and h + length > size] if at_bound and length < size else []
            best = min(map(after, fits + cuts))
            level = p.level_for(length)
            assert level == max(h for h in fits + cuts if after(h) == best)
            full = p.put([(k, 0, np.zeros(length, np.uint32), length)], length)
            assert all(sum(len(x[2]) for x in w) == size for w in full)
            assert sum(len(w) for w in p.open.values()) == p.n_open == p.levels[:size].sum() <= max(1, max_open)


@pytest.mark.parametrize("tasks", [1, 7])
def test_packing_rounds_leave_one_window(spark, docs, tasks, rows):
    few = packing.pack(docs.repartition(tasks), WORD, 2, 64, max_open=4, fan_in=2).collect()
    check_packing(few, rows, 64)
    sizes = {}
    for r in few:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert sum(n < 64 for n in sizes.values()) <= 1
