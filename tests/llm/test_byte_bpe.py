"""Byte-level BPE against the library that its rank files are for."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from eocatalog.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.RankEncoder(PATH, PATTERN)


def split(flat, lens):
    return [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])]


ODD = [
    "", "é", "a" * 3000, "ab" * 500, " " * 1000, "x" * 63, "x" * 64, "x" * 65, "é" * 32, "\n\n\n a", "a \t b", "\x1c a", "\x85 b", "　x", "it's 'll don't'S",
    "123 456a7", "\U0001d518nicode ﬁ", "՘abc", "a՘b 1\U00011de12", "<|endoftext|>", "日本語テキスト" * 30, "a\x1eb \x1e c", "\x00\x00 \x7f",
]


def test_ids_of_whole_texts(encoder, library, rows):
    texts = ODD + [r[1] for r in rows if r[1] is not None]
    assert split(*encoder.encode(texts)) == [library.encode_ordinary(x) for x in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\tab'ls1é")), max_size=60), min_size=1, max_size=8))
def test_ids_of_any_text(encoder, library, texts):
    assert split(*encoder.encode(texts)) == [library.encode_ordinary(x) for x in texts]


def test_classes_of_characters(library):
    """Which characters are letters, numbers and white space: all that Python or the later versions tell apart."""
    import regex

    pattern = byte_bpe.RankEncoder(PATH, PATTERN)
    points = [x for first, last in byte_bpe.LATER for x in {first, last}] + list(range(0x80, 0x3000)) + list(range(0xA000, 0xAC00)) + list(range(0x10000, 0x12600, 3))
    some = [chr(p) for p in points if regex.match(r"\p{L}|\p{N}|\s|\p{M}|\p{Cn}", chr(p))]
    base = {bytes([b]): b for b in range(256)}
    for lead in "q7\n":
        ranks = base | {t: 256 + k for k, t in enumerate(dict.fromkeys((lead + x).encode() for x in some))}
        one = tiktoken.Encoding("one", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert [x for x in some if (len(one.encode_ordinary(lead + x)) == 1) != (len(pattern.pieces(lead + x)) == 1)] == []


def plainly(piece, ranks):
    """Merges the leftmost pair of the lowest rank, again and again."""
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=70), st.text("aeinst ", min_size=1, max_size=70))
def test_trees_merge_as_a_plain_scan_does(encoder, raw, word):
    own = encoder.ranks
    for piece in (raw, word.encode()):
        want = plainly(piece, own.ids)
        assert byte_bpe.merge(piece, own) == want
        for width in (w for w in byte_bpe.WIDTHS if w >= len(piece)):
            both = np.frombuffer(piece + piece[:1], np.uint8)
            flat, lens = byte_bpe.merge_side_by_side(both, np.array([len(piece), 1]), width, own)
            assert flat.tolist() == [*want, own.ids[piece[:1]]]
            assert lens.tolist() == [len(want), 1]


def test_a_long_piece_takes_little_more_than_linear_time(encoder, library):
    piece = b"abcab" * 100_000
    assert byte_bpe.merge(piece, encoder.ranks) == library._core_bpe.encode_single_piece(piece)


def test_query_rows(spark, docs, rows, library):
    out = byte_bpe.digests(byte_bpe.round_trip(docs, PATH, PATTERN))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        ids, r = library.encode_ordinary(text or ""), got[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_odd_rows_and_long_texts(spark, odd, empty, library):
    got = byte_bpe.decode(byte_bpe.encode(odd, PATH, PATTERN), PATH).collect()
    assert sorted(bytes(r.decoded).decode() for r in got) == sorted(r.text or "" for r in odd.collect())
    assert byte_bpe.decode(byte_bpe.encode(empty, PATH, PATTERN), PATH).count() == 0
    long = "word and " * 130_000 + "z" * 300_000
    row = byte_bpe.encode(spark.createDataFrame([(1, long)], "doc_id long, text string"), PATH, PATTERN).first()
    assert row.ids == library.encode_ordinary(long)


def test_decoding_of_ids_that_are_none(spark):
    ids = spark.createDataFrame([(1, [0, 1]), (2, [-1]), (3, [10**6, 0]), (4, None), (5, [None]), (6, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in byte_bpe.decode(ids, PATH).collect()}
    assert [got[k] is None for k in range(1, 7)] == [False, True, True, False, True, False]
    assert got[4] == got[6] == b""
