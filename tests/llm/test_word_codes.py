"""Known words told by mixing along codes."""

import math
from collections import defaultdict

import numpy as np

from eocatalog.llm import _codes, _follow, _online, lm_score


def vocabulary(n=400, seed=2):
    """Hashes, and counts by class and leaf, in which the first 30 words have leaves of their own."""
    rng = np.random.default_rng(seed)
    hashes = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    times = rng.integers(1, 50, (lm_score.N_CLASSES, len(hashes))) * (np.arange(lm_score.N_CLASSES) < 3)[:, None]
    heavy = np.sort(hashes[:30])
    leaves = np.zeros((lm_score.N_CLASSES, len(heavy) + _codes.BINS))
    codes = _codes.Codes(heavy, leaves)
    at = codes.leaf_of(hashes)
    for row, own in zip(leaves, times, strict=True):
        np.add.at(row, at, own)
    return hashes, times, _codes.Codes(heavy, leaves), at


def test_counts_along_codes_are_the_shares_of_words():
    hashes, times, codes, leaf = vocabulary()
    ones, known = np.full(len(hashes), 1, np.intp), times.sum(axis=0)
    of, bit, _, given = codes.expand(leaf, ones, False)
    for logits, counts in zip(given, (times[1], known), strict=True):
        p = np.bincount(of, np.log10(1 / (1 + np.exp(np.where(bit, -logits, logits)))), len(leaf))
        in_leaf = np.array([counts[leaf == x].sum() for x in leaf])
        assert np.abs(p - np.log10(in_leaf / counts.sum())).max() < 0.1  # but for what is added to both counts
    shares = 10 ** codes.within(leaf, ones, times[1], known, 0 * ones)
    assert np.allclose(np.bincount(leaf, shares)[np.unique(leaf)], 1)
    # codes are those of a whole tree
    lens = codes.lens.astype(float)
    assert math.isclose((2.0**-lens).sum(), 1)


def test_own_occurrence_is_left_out_along_a_code():
    hashes, times, codes, leaf = vocabulary()
    some = np.array([3, 200, 77])
    less = codes.leaf_counts[:-1].astype(float)
    of, bit, _, given = codes.expand(leaf[some], np.array([0, 1, 2]), True)
    for k, (word, cls) in enumerate(zip(some, (0, 1, 2), strict=True)):
        without = less.copy()
        without[cls, leaf[word]] -= 1
        path = slice(codes.starts[leaf[word]], codes.starts[leaf[word]] + codes.lens[leaf[word]])
        nodes = codes.places[path] // 2
        for rows, logits in ((without[cls], given[0]), (without.sum(axis=0), given[1])):
            n = np.bincount(codes.places, np.repeat(rows, codes.lens), 2 * (len(codes.lens) - 1)).reshape(-1, 2)[nodes]
            assert np.allclose(logits[of == k], np.log((n[:, 1] + _codes.PRIOR) / (n[:, 0] + _codes.PRIOR)), atol=1e-4)


def plain_code_mixer(given, contexts, bits, rate=0.02):
    counts, n_given = defaultdict(lambda: [0.4, 0.4]), len(given)
    weights = np.array([[0.9 / n_given] * n_given + [0.2]] * 4)
    squares, out = np.full(weights.shape, 1e-3), [0.0] * len(bits)
    for t in range(min(_online.STRETCH, len(bits))):
        changes = []
        for i in range(t, len(bits), _online.STRETCH):
            slot = int(contexts[i]) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - 19)
            zeros, ones = counts[slot]
            gate = sum(zeros + ones > x for x in _online.CodeMixer.LEVELS)
            inputs = [*(g[i] for g in given), math.log(ones / zeros)]
            p = 1 / (1 + math.exp(-min(_online._LIMIT, max(-_online._LIMIT, float(np.dot(weights[gate], inputs))))))
            out[i] = math.log10(p if bits[i] else 1 - p)
            changes.append((gate, slot, inputs, bits[i] - p, int(bits[i])))
        for g in {x[0] for x in changes}:
            slope = np.mean([[x[3] * v for v in x[2]] for x in changes if x[0] == g], axis=0)
            squares[g] += slope**2
            weights[g] += rate * slope / np.sqrt(squares[g])
        for _, slot, _, _, bit in changes:
            counts[slot][bit] += 1
    return out


def test_code_mixer_equals_a_plain_one():
    rng = np.random.default_rng(4)
    n = 7 * _online.STRETCH + 5
    contexts = _follow.scramble(rng.integers(0, 60, n).astype(np.uint64))
    given = [rng.normal(size=n).astype(np.float32) for _ in range(2)]
    bits = (contexts % np.uint64(3) == 0) ^ (rng.random(n) < 0.2)
    got = _online.CodeMixer(2, 1).predict(given, [contexts], bits, True)
    assert np.abs(got - plain_code_mixer(given, contexts, bits)).max() < 1e-3


def test_known_words_are_told_by_the_word_before():
    # words are equally frequent, and after each come eight of 64 words only: counts alone take log10(64) a word
    rng = np.random.default_rng(6)
    hashes = np.sort(rng.integers(0, 1 << 63, 64).astype(np.uint64) * np.uint64(2))
    words = [0]
    for _ in range(60_000):
        words.append((words[-1] * 8 + int(rng.integers(0, 8))) % 64)
    words = np.array(words)
    leaves = np.zeros((lm_score.N_CLASSES, 64 + _codes.BINS))
    learns = np.arange(len(words)) < 50_000
    leaves[0, :64] = np.bincount(words[learns], minlength=64)
    codes = _codes.Codes(hashes, leaves)
    at = np.arange(len(words))
    got = lm_score.tell(codes, codes.leaf_of(hashes)[words], np.zeros(len(words), np.int8), at, hashes[words], 0 * at, learns)
    by_counts = np.log10(leaves[0, words] / learns.sum())
    assert got[~learns].mean() > by_counts[~learns].mean() + 0.5
    assert got[~learns].mean() <= -math.log10(8) + 0.02


def test_spelling_leaves_a_learned_word_out(spark):
    words = [bytes([97 + k % 7, 98 + k % 5, 99 + k % 3, 100 + k]) for k in range(20)]
    model = lm_score.train(spark.createDataFrame([(0, bytearray(w), 1) for w in words], "cls int, word binary, n long"), 1)
    classes = np.zeros(len(words), int)
    with_it, without = model.log10_words(words, classes), model.log10_words(words, classes, np.arange(20) < 10)
    assert (without[:10] < with_it[:10] - 0.1).all() and np.allclose(without[10:], with_it[10:])


def test_beginnings_that_words_share_are_spelled_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = list({bytes(rng.integers(97, 101, rng.integers(0, 9)).astype(np.uint8)) for _ in range(3000)})
    classes, learned = rng.integers(0, 3, len(words)), rng.random(len(words)) < 0.5
    words[5], classes[5], learned[5] = words[4], classes[4], learned[4]
    vocabulary = [(int(k), bytearray(w), 1) for w, k in zip(words, classes, strict=True)]
    model = lm_score.train(spark.createDataFrame(vocabulary, "cls int, word binary, n long"), 2)
    alone = [model.log10_words([w], classes[k : k + 1], learned[k : k + 1])[0] for k, w in enumerate(words)]
    told, inputs = [], lm_score.Model.inputs
    monkeypatch.setattr(lm_score.Model, "inputs", lambda self, hashes, d, node, *more: (told.append(len(node)), inputs(self, hashes, d, node, *more))[1])
    assert np.allclose(model.log10_words(words, classes, learned), alone, rtol=1e-6, atol=1e-6)
    prefixes = {(k, x, (w + b" ")[:n]) for w, k, x in zip(words, classes.tolist(), learned.tolist(), strict=True) for n in range(1, len(w) + 2)}
    assert told == [len(prefixes)] * 8
    told.clear()
    lm_score.learn(model, words, classes, np.ones(len(words), int), np.zeros((lm_score.N_GATES, lm_score.N_CONTEXTS)), np.zeros((2, 256 * lm_score.MAP_STEPS)), 0.03)
    assert told == [len({(k, w) for k, _, w in prefixes})] * 8


def test_what_followed_last_in_a_text():
    rng = np.random.default_rng(3)
    lens = rng.integers(1, 40, 60)
    text = np.repeat(np.arange(60), lens)
    words = rng.integers(0, 6, len(text))
    words[np.cumsum(lens) - 1] = 7  # the end
    want, last = [], {}
    for k, word in enumerate(words.tolist()):
        key = (text[k], words[k - 1])
        within = k > 0 and text[k - 1] == text[k]
        want.append((within and key in last, within and last.get(key) == word))
        if within:
            last[key] = word
    assert list(zip(*(x.tolist() for x in lm_score._last_in_text(words, text)), strict=True)) == want


def test_keys_are_counted_without_their_places():
    rng = np.random.default_rng(2)
    keys = (rng.zipf(1.3, 3000) % 400).astype(np.uint64) * np.uint64(9000)
    trained = rng.random(3000) < 0.7
    for some in (slice(None), slice(0)):
        whole = _follow.requests(keys[some], trained[some], 3)
        for a, b in zip(_follow.requests(keys[some], trained[some], 3, places=False), whole[:4], strict=True):
            assert a.dtype == b.dtype and a.tolist() == b.tolist()
