"""Token counts of a unigram vocabulary, by a Viterbi pass that keeps counts only.

An Aho-Corasick automaton enumerates the pieces that match in a segment; dynamic programming carries,
for each position, the best score and how many pieces give it. Ties go as in the tokenizer: pieces
are tried by ascending start and replace an earlier one only with a strictly better score.

A segment is a word marker with the characters up to the next one. No piece holds a marker after another
character (this is checked), so segments split alone, and each distinct one is split once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eocatalog.llm import _common as c
from eocatalog.llm._chunks import in_parts

MARK = "▁"
#: What an unknown character costs beyond the lowest score, as in the library.
UNKNOWN_PENALTY = 10.0
#: Segments and their characters in memory per worker process; past that the table starts anew (a cache, not a limit).
CACHED_SEGMENTS, CACHED_CHARS = 500_000, 20_000_000

_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_counters: dict = {}


def load_pieces(path: str) -> tuple[list[tuple[str, float]], float]:
    """The ordinary pieces of a sentencepiece file with their scores, and the lowest score of all its pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    all_ids = range(model.vocab_size())
    ordinary = [i for i in all_ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in ordinary], min(model.get_score(i) for i in all_ids)


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], lowest: float):
        import ahocorasick

        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece holds a word marker after another character")
        self._automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = lowest - UNKNOWN_PENALTY
        self._single = {p for p, _ in pieces if len(p) == 1}
        self._done: dict[str, tuple[int, float]] = {}
        self._chars = 0

    def segment(self, text: str) -> tuple[int, float]:
        """Tokens and score of the best split; an unknown character is as many tokens as it has bytes."""
        n, minus = len(text), float("-inf")
        score, count = [0.0] + [minus] * n, [0] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self._automaton.iter(text):
            ends[end].append(match)
        for end in range(n):
            best, best_count = minus, 0
            char = text[end]
            known = char in self._single
            # the longest piece starts first; an unknown character starts last
            for length, value in sorted(ends[end], reverse=True):
                start = end + 1 - length
                if (total := score[start] + value) > best:
                    best, best_count = total, count[start] + 1
            if not known and (total := score[end] + self._unknown) > best:
                best, best_count = total, count[end] + len(char.encode())
            score[end + 1], count[end + 1] = best, best_count
        return count[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """Tokens and score of a text, with a marker before it and for each space; none for an empty text."""
        if not text:
            return 0, 0.0
        if len(self._done) > CACHED_SEGMENTS or self._chars > CACHED_CHARS:
            self._done.clear()
            self._chars = 0
        tokens, total, done = 0, 0.0, self._done
        for s in _SEGMENT.findall(MARK + text.replace(" ", MARK)):
            found = done.get(s)
            if found is None:
                found = done[s] = self.segment(s)
                self._chars += len(s)
            tokens += found[0]
            total += found[1]
        return tokens, total


def counter(path: str) -> UnigramCounter:
    if path not in _counters:
        _counters[path] = UnigramCounter(*load_pieces(path))
    return _counters[path]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, best_score of every row's whole text; 0 and 0.0 for a null or empty text.

    Rows are looked at one by one, so null and repeated ids change nothing. model is the path of a
    sentencepiece file that every executor has; its pieces and scores are taken as a unigram vocabulary.
    """

    def count(batches):
        import pyarrow as pa

        own = counter(model)
        for part in in_parts(batches):
            found = [own.count(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "n_tokens", "best_score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(count, "doc_id long, n_tokens long, best_score double")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(c.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
