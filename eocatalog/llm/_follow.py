"""What follows two words in the whole training corpus, asked for by chunks and answered by shards.

A chunk's token triples (two words, the next) are sorted 64-bit keys: 48 bits of the two words' hash, 16 of the
next word's. Shards are ranges of keys, so each holds all that the corpus knows of a context. A shard
answers each key with two bytes, one for held-out text and one for training text, whose own
occurrence is left out: how often the context was seen, the share of its favourite next word, and whether
the next word is that favourite.

A context that has many different next words in a chunk's training text is told apart there: such counts are summed
over chunks before a shard gets them, beside what other chunks ask of the context, and the chunk gets the
context's figures and works out the bytes itself. So no shard gets all next words of a frequent context from each chunk.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
NEXT_BITS = 16
#: A context with more different next words than this in a chunk's training text is wide there.
WIDE = 32
#: Lower bounds of the levels of how often a context was seen, and of its favourite's share.
SEEN, SHARE = np.array([1, 2, 3, 5, 9, 17, 65]), np.array([0.3, 0.6, 0.9])
_LEVELS = np.searchsorted(SEEN, np.arange(SEEN[-1] + 1), side="right").astype(np.uint8)


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def triples(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The key of each token of texts that begin at starts; before a text stand two zeros."""
    one, two = np.zeros_like(hashes), np.zeros_like(hashes)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    one[starts], two[starts] = 0, 0
    second = starts + 1
    two[second[second < len(two)]] = 0  # a text has at least its end, so this is its own second token or another's first
    context = scramble(one * _M2 + scramble(two + _M1))
    low = np.uint64((1 << NEXT_BITS) - 1)
    return (context & ~low) | (scramble(hashes) & low)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(np.append(first, len(keys)))


def requests(keys: np.ndarray, trained: np.ndarray, wide: int = WIDE, places: bool = True) -> tuple:
    """The distinct keys of narrow contexts and how often training text has each, the same of wide ones, and (with places) each token's place.

    Keys are sorted; places count on from the narrow ones to the wide ones.
    """
    if places:
        distinct, place = np.unique(keys, return_inverse=True)
        times = np.bincount(place, trained, len(distinct)).astype(np.int64)
    else:  # sorting alone is several times as fast as sorting places too
        distinct, _ = _runs(keys)
        learned, n = _runs(keys[trained])
        times = np.zeros(len(distinct), np.int64)
        times[np.searchsorted(distinct, learned)] = n
    context = distinct >> np.uint64(NEXT_BITS)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.empty(0, np.int64)
    width = np.diff(np.append(first, len(context)))
    narrow = np.repeat(np.add.reduceat(times > 0, first, dtype=np.int64) <= wide, width) if len(first) else np.zeros(0, bool)
    found = distinct[narrow], times[narrow], distinct[~narrow], times[~narrow]
    if not places:
        return found
    return *found, np.where(narrow, np.cumsum(narrow) - 1, narrow.sum() + np.cumsum(~narrow) - 1)[place]


def contexts_of(keys: np.ndarray) -> np.ndarray:
    """The distinct contexts of sorted keys."""
    return _runs(keys >> np.uint64(NEXT_BITS))[0].astype(np.int64)


def to_bytes(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte, so that their high bytes compress."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def by_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range begins in sorted keys, and the end. No range begins within a context."""
    return np.append(np.searchsorted(keys, _bounds(shards)), len(keys))


def _bounds(shards: int) -> np.ndarray:
    return np.array([(k << 64) // shards >> NEXT_BITS << NEXT_BITS for k in range(shards)], np.uint64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(_bounds(shards), keys, side="right") - 1


def _code(seen: np.ndarray, favourite: np.ndarray, hit: np.ndarray) -> np.ndarray:
    code = _LEVELS.take(np.minimum(seen, SEEN[-1]))  # how often the context was seen
    share = favourite / np.maximum(seen, 1)
    told = (code > 0) & (favourite > 0)
    code *= np.uint8(4)
    for least in SHARE:
        code += share >= least
    code *= np.uint8(2)
    code += hit
    code *= told
    return code


def _codes(hit: np.ndarray, seen: np.ndarray, n_best: np.ndarray, n_second: np.ndarray, best_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For held-out and for training text; best_first says that of equal counts the favourite's key is the lower."""
    # without its own occurrence the favourite may fall behind the second
    less = n_best - 1
    stays = (less > n_second) | ((less == n_second) & best_first)
    favourite = np.where(hit, np.where(stays, less, n_second), n_best)
    return _code(seen, n_best, hit), _code(np.maximum(seen - 1, 0), favourite, hit & stays)


def answer(asked: list[tuple[np.ndarray, np.ndarray]], wide: tuple[np.ndarray, np.ndarray]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each chunk's (keys, times) the codes for held-out and for training text; and the figures of wide contexts.

    wide has the keys that wide contexts have in some chunk, with counts summed over those chunks. The favourite of a
    context is its most frequent next word, ties by key. Figures are rows of context, times seen, favourite and
    second (keys) and their counts, all as 64-bit integers.
    """
    sizes = [len(k) for k, _ in asked]
    keys, place = np.unique(np.concatenate([*(k for k, _ in asked), wide[0]]), return_inverse=True)
    times = np.zeros(len(keys), np.int64)
    np.add.at(times, place, np.concatenate([*(t for _, t in asked), wide[1]]).astype(np.int64))
    context = keys >> np.uint64(NEXT_BITS)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    width = np.diff(np.append(first, len(keys)))
    several = width > 1
    group = np.repeat(np.arange(len(first)), width)
    seen = np.add.reduceat(times, first)

    def most(n):
        """The first key of each context that has the most, and how much that is."""
        top = np.maximum.reduceat(n, first)
        there = np.flatnonzero(n == top[group])
        of = group[there]
        return there[np.append(True, of[1:] != of[:-1])], top

    best, n_best = most(times)
    rest = times.copy()
    rest[best] = -1  # keys that only held-out text has have 0
    second, n_second = most(rest)
    n_second = np.where(several, n_second, 0)
    hit = np.arange(len(keys)) == best[group]
    held, trained = _codes(hit, seen[group], n_best[group], n_second[group], (~several | (best < second))[group])
    at = np.searchsorted(context[first].astype(np.uint64), contexts_of(wide[0]).astype(np.uint64))
    figures = np.stack([x.view(np.int64) for x in (context[first], seen, keys[best], keys[second], n_best, n_second)], axis=1)[at]
    cuts = np.cumsum(sizes)
    return list(zip(np.split(held[place[: cuts[-1]]], cuts[:-1]), np.split(trained[place[: cuts[-1]]], cuts[:-1]), strict=True)) if sizes else [], figures


def wide_codes(keys: np.ndarray, figures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a chunk's keys of wide contexts, from the figures of all of these contexts in any order."""
    figures = figures[np.argsort(figures[:, 0])]
    _, seen, best, second, n_best, n_second = figures[np.searchsorted(figures[:, 0], (keys >> np.uint64(NEXT_BITS)).astype(np.int64))].T
    best, second = best.copy().view(np.uint64), second.copy().view(np.uint64)
    return _codes(keys == best, seen, n_best, n_second, best <= second)
