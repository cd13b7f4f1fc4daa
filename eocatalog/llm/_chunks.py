"""Ids of whole texts from the tokenizers library, with each distinct chunk encoded once.

A text is cut only where the tokenizer itself always starts a new pre-token: before a space between two
characters that aren't white space, and around a newline between two such. So the ids of the chunks one
after another are the ids of the text. Texts with other runs of white space are cut by a pattern, and
texts for which this can't be said in general are one chunk. Most chunks are table lookups.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

#: Chunks and their characters kept per worker process; past that the rarest go (a cache, not a limit).
KEPT_CHUNKS, KEPT_CHARS = 300_000, 20_000_000

#: Byte-level pre-tokens: a word with the space before it, a run of white space but for its last
#: character, or one white space character.
BYTE_LEVEL = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: White space for Python's re or for the library, but not for both.
_ODD = "\x1c\x1d\x1e\x1f\x85\u180e"
#: Two white space characters in a row, or one that is neither a space nor a newline.
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\x0b", "\x0c", "\r")
_WIDE_SPACE = re.compile("[\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Between chunks; no plain text holds it.
_CUT = "\x1e"
#: A comma or stop after a letter begins a pre-token of its own, which ends where the chunk does.
_COMMA, _STOP = (re.compile(x + "(?<=[a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff].)(?=\x1e|$)") for x in (",", "\\."))

_encoders: dict = {}


class _Slots(dict):
    """Numbers of chunks; new ones are listed."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = slot = len(self)
        self.new.append(chunk)
        return slot


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        #: How many bytes of text an id stands for; the end-of-word mark is none.
        self._bytes = np.zeros(self.vocab_size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self._bytes[i] = len(token.removesuffix("</w>"))
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._start(specials, type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel")

    def _start(self, specials: list[str], byte_level: bool) -> None:
        """Empty tables, and how texts are cut; encoders of other vocabularies call it too."""
        self._specials, self._byte_level = specials, byte_level
        self._slots = _Slots()
        self._pool = np.empty(0, np.int32)
        self._starts, self._lens, self._hits = (np.empty(0, np.int64) for _ in range(3))
        self._chars = 0

    def _is_plain(self, text: str) -> bool:
        """Only single spaces and newlines between other characters, no special token, nothing odd."""
        if any(x in text for x in self._specials) or any(x in text for x in _ODD):
            return False
        if not self._byte_level:
            return True
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _RUNS):
            return False
        return text.isascii() or not _WIDE_SPACE.search(text)

    def _cut(self, texts: list[str]):
        """The chunks of all texts one after another as an Arrow array, how many each text has, and texts that are one chunk.

        For a byte-level tokenizer a word that stands after a space begins with it, and a comma or stop at its
        end is a chunk of its own.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        plain, others, whole = [], {}, set()
        for k, text in enumerate(texts):
            if self._is_plain(text):
                if self._byte_level:
                    text = text.replace("\n", "\x1e\n\x1e").replace(" ", "\x1e ")
                    plain.append(_STOP.sub("\x1e.", _COMMA.sub("\x1e,", text)))
                else:
                    plain.append(_CUT.join(text.split()))
            elif any(x in text for x in self._specials) or any(x in text for x in _ODD):
                others[k] = [text]
                whole.add(text)
            else:
                others[k] = BYTE_LEVEL.findall(text)
        lists = pc.split_pattern(pa.array(plain, pa.large_string()), _CUT)
        counts = np.asarray(lists.value_lengths(), np.int64)
        chunks = lists.flatten()
        if not others:
            return chunks, counts, whole
        rest = pa.array([x for parts in others.values() for x in parts], pa.large_string())
        own, sizes = np.array(list(others)), np.fromiter(map(len, others.values()), np.int64, len(others))
        # chunks of other texts lie behind those of plain ones; they are taken in the order of the texts
        all_counts = np.zeros(len(texts), np.int64)
        is_plain = np.ones(len(texts), bool)
        is_plain[own] = False
        all_counts[is_plain], all_counts[own] = counts, sizes
        starts = np.zeros(len(texts), np.int64)
        starts[is_plain] = np.cumsum(counts) - counts
        starts[own] = len(chunks) + np.cumsum(sizes) - sizes
        ends = np.cumsum(all_counts)
        take = np.arange(int(ends[-1])) + np.repeat(starts - (ends - all_counts), all_counts)
        return pa.concat_arrays([chunks, rest]).take(pa.array(take)), all_counts, whole

    def _alone(self, new: list[str], whole: set[str]) -> list[int]:
        """Which chunks have the same ids beside other such chunks: words, for a byte-level tokenizer after a space."""
        if self._byte_level:
            found = [k for k, x in enumerate(new) if x[0] == " " and len(x) > 1 and not x[1].isspace()]
        else:
            found = [k for k, x in enumerate(new) if x.isascii() or unicodedata.is_normalized("NFC", x)]
        return [k for k in found if new[k] not in whole] if whole else found

    def _encode_new(self, new: list[str], whole: set[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where each chunk's start and how many they are; chunks that can stand together are one text.

        Which ids are whose is told by the bytes that each stands for; where these don't add up, and for
        other chunks, each chunk is encoded by itself.
        """
        starts, lens = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        done, pool, used = np.zeros(len(new), bool), [], 0
        together = self._alone(new, whole)
        for at in range(0, len(together), 4000):
            some = together[at : at + 4000]
            text = ("" if self._byte_level else " ").join([new[k] for k in some])
            flat = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            raw = np.frombuffer((text if self._byte_level else text.lower()).encode(), np.uint8)
            spaces = np.flatnonzero(raw == 32)  # one before each word, or one between each two
            if self._byte_level:
                stops = np.append(spaces[1:], len(raw))
            else:
                stops = np.append(spaces, len(raw)) - np.arange(len(spaces) + 1)
            ends = np.cumsum(self._bytes[flat])
            last = np.searchsorted(ends, stops)
            if len(stops) != len(some) or not len(ends):
                continue
            if ends[-1] == stops[-1] and (ends[last] == stops).all():
                after = np.concatenate([[0], last + 1])
                starts[some], lens[some], done[some] = used + after[:-1], np.diff(after), True
                pool.append(flat)
                used += len(flat)
        rest = np.flatnonzero(~done).tolist()
        for at in range(0, len(rest), 2000):
            for k, e in zip(rest[at : at + 2000], self.tokenizer.encode_batch_fast([new[k] for k in rest[at : at + 2000]], add_special_tokens=False), strict=True):
                pool.append(np.array(e.ids, np.int32))
                starts[k], lens[k] = used, len(pool[-1])
                used += len(pool[-1])
        return (np.concatenate(pool) if pool else np.empty(0, np.int32)), starts, lens

    def _look_up(self, texts: list[str | None]):
        """Slots of all chunks, chunks of each text; the ids of all slots, their starts and lengths."""
        full = [k for k, t in enumerate(texts) if t]
        chunks, in_full, whole = self._cut([texts[k] for k in full])
        counts = np.zeros(len(texts), np.int64)
        counts[full] = in_full
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = np.fromiter(map(self._slots.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        new = self._slots.new
        ids, starts, lens = self._encode_new(new, whole)
        starts, lens = np.concatenate([self._starts, starts + len(self._pool)]), np.concatenate([self._lens, lens])
        pool = np.concatenate([self._pool, ids])
        hits = np.bincount(slots, minlength=len(lens))
        hits[: len(self._hits)] += self._hits
        self._chars += sum(map(len, new))
        self._pool, self._starts, self._lens, self._hits = pool, starts, lens, hits
        new.clear()
        if len(lens) > KEPT_CHUNKS or self._chars > KEPT_CHARS:
            self._forget()
        return slots, counts, pool, starts, lens

    def _forget(self) -> None:
        """Leaves the chunks that were met most often, at most three fifths of what may be kept."""
        least = 1
        while (self._hits > least).sum() > 0.6 * KEPT_CHUNKS:
            least *= 2
        stay = np.flatnonzero(self._hits > least)
        chunks = list(self._slots)
        names = [chunks[k] for k in stay.tolist()]
        self._slots = _Slots()
        self._slots.update(zip(names, range(len(names)), strict=True))
        self._chars = sum(map(len, names))
        if self._chars > KEPT_CHARS // 2:  # few but very long
            self._slots, stay, self._chars = _Slots(), stay[:0], 0
        lens = self._lens[stay]
        starts = np.cumsum(lens) - lens
        take = np.arange(int(lens.sum())) + np.repeat(self._starts[stay] - starts, lens)
        self._pool, self._starts, self._lens, self._hits = self._pool[take], starts, lens, self._hits[stay]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        slots, counts, pool, starts, lens = self._look_up(texts)
        lens = lens[slots]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(starts[slots] - (ends - lens), lens)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return pool[take], np.diff(bounds)


def encoder(path: str) -> ChunkEncoder:
    """One for each tokenizer and worker process, kept over tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def in_parts(batches, rows: int = 1024, chars: int = 2_000_000):
    """Arrow batches cut into parts of bounded rows and text, so that memory is bounded."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
                sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and (i - start >= rows or total + size > chars):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)
