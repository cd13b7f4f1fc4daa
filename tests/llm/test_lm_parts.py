"""The parts of LM scoring against plain versions: what follows two words, online mixing, independence of dealing."""

import math
from collections import defaultdict

import numpy as np
import pytest

from eocatalog.llm import _follow, _online, lm_score


def plain_codes(chunks):
    """For each token the codes for held-out and for training text, by counting in dictionaries."""
    counts = defaultdict(lambda: defaultdict(int))
    for keys, trained in chunks:
        for key, t in zip(keys.tolist(), trained.tolist(), strict=True):
            counts[key >> 16][key] += int(t)

    def code(seen, favourite, hit):
        level = sum(seen >= x for x in _follow.SEEN)
        share = sum(favourite / max(seen, 1) >= x for x in _follow.SHARE)
        return (level * 4 + share) * 2 + hit if level and favourite else 0

    def favourite_of(nexts):
        return min(nexts, key=lambda k: (-nexts[k], k))

    out = []
    for keys, _ in chunks:
        held, trained = [], []
        for key in keys.tolist():
            nexts = counts[key >> 16]
            best, seen = favourite_of(nexts), sum(nexts.values())
            held.append(code(seen, nexts[best], key == best))
            less = dict(nexts)
            less[key] = less[key] - 1
            after = favourite_of(less) if key == best else best
            trained.append(code(max(seen - 1, 0), less[after] if key == best else nexts[best], key == best == after))
        out.append((held, trained))
    return out


@pytest.mark.parametrize(("wide", "shards"), [(32, 3), (5, 7), (0, 2), (10**9, 1)])
def test_followers_equal_plain_counts(wide, shards):
    rng = np.random.default_rng(1)
    chunks = []
    for _ in range(4):
        contexts = (rng.zipf(1.3, 2500) % 300).astype(np.uint64)
        keys = (_follow.scramble(contexts) >> np.uint64(16) << np.uint64(16)) | (rng.zipf(1.5, 2500) % 500).astype(np.uint64)
        chunks.append((keys, rng.random(2500) < 0.8))
    asked = [_follow.requests(k, t, wide) for k, t in chunks]
    answers, figures = [([], []) for _ in chunks], []
    wide_keys, wide_times = np.concatenate([r[2] for r in asked]), np.concatenate([r[3] for r in asked])
    for s in range(shards):
        own = [slice(*_follow.by_shard(r[0], shards)[s : s + 2]) for r in asked]
        mine = (_follow.shard_of(wide_keys, shards) == s) & (wide_times > 0)
        keys, place = np.unique(wide_keys[mine], return_inverse=True)
        found, some = _follow.answer([(r[0][x], r[1][x]) for r, x in zip(asked, own, strict=True)], (keys, np.bincount(place, wide_times[mine], len(keys)).astype(np.int64)))
        figures.append(some)
        for a, (held, trained) in zip(answers, found, strict=True):
            a[0].append(held)
            a[1].append(trained)
    for r, a, want in zip(asked, answers, plain_codes(chunks), strict=True):
        of_wide = _follow.wide_codes(r[2], np.concatenate(figures)) if len(r[2]) else [np.empty(0, np.uint8)] * 2
        for k in (0, 1):
            assert np.append(np.concatenate(a[k]), of_wide[k])[r[4]].tolist() == want[k]


def test_no_shard_begins_within_a_context():
    keys = np.sort(_follow.scramble(np.arange(200, dtype=np.uint64)) >> np.uint64(16) << np.uint64(16))
    keys = np.unique(np.concatenate([keys + np.uint64(k) for k in (0, 9, 65535)]))
    shards = _follow.shard_of(keys, 1013)
    by_context = defaultdict(set)
    for key, shard in zip(keys.tolist(), shards.tolist(), strict=True):
        by_context[key >> 16].add(shard)
    assert all(len(x) == 1 for x in by_context.values())
    cuts = _follow.by_shard(keys, 1013)
    assert all(cuts[s] <= k < cuts[s + 1] for k, s in enumerate(shards.tolist()))


def plain_mixer(n_ctx, n_gates, contexts, gates, bits, learns, rate=0.02):
    """A decision at a time, with dictionaries of counts; those at one place of their stretches see the same state."""
    counts = defaultdict(lambda: [0.4, 0.4])
    weights, squares = np.full((n_gates, n_ctx), 1.2 / n_ctx), np.full((n_gates, n_ctx), 1e-3)
    limit, steps = _online._LIMIT, _online._STEPS
    seen = {(g, s): [8.0, 8.0 / (1 + math.exp(limit - 2 * limit * s / steps))] for g in range(n_gates) for s in range(steps + 1)}
    out = [0.0] * len(bits)
    for t in range(min(_online.STRETCH, len(bits))):
        changes = []
        for i in range(t, len(bits), _online.STRETCH):
            own = [(k, int(contexts[k][i]) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - _online.TABLE_BITS)) for k in range(n_ctx)]
            inputs = [math.log(counts[s][1] / counts[s][0]) for s in own]
            mixed = min(limit, max(-limit, sum(w * x for w, x in zip(weights[gates[i]], inputs, strict=True))))
            p = 1 / (1 + math.exp(-mixed))
            place = gates[i], round((mixed + limit) * steps / (2 * limit))
            refined = min(1 - 1e-5, max(1e-5, (p + seen[place][1] / seen[place][0]) / 2))
            out[i] = math.log10(refined if bits[i] else 1 - refined)
            if learns[i]:
                changes.append((gates[i], own, inputs, bits[i] - p, place, bool(bits[i])))
        for g in {x[0] for x in changes}:
            mine = [x for x in changes if x[0] == g]
            slope = np.mean([[x[3] * v for v in x[2]] for x in mine], axis=0)
            squares[g] += slope**2
            weights[g] += rate * slope / np.sqrt(squares[g])
        for _, own, _, _, place, bit in changes:
            seen[place][0] += 1
            seen[place][1] += bit
            for s in own:
                counts[s][bit] += 1
    return out


def test_mixer_equals_a_plain_one():
    rng = np.random.default_rng(4)
    n = 5 * _online.STRETCH + 17
    contexts = _follow.scramble(rng.integers(0, 40, (3, n)).astype(np.uint64))
    gates, learns = rng.integers(0, 2, n), rng.random(n) < 0.8
    bits = (contexts[0] % np.uint64(3) == 0) ^ (rng.random(n) < 0.1)
    got = _online.Mixer(3, 2).predict(contexts, gates, bits, learns)
    want = plain_mixer(3, 2, contexts, gates, bits, learns)
    assert np.abs(got - want).max() < 2e-2 and abs(got.sum() - sum(want)) < 1e-2
    assert np.median(np.abs(got - want)) < 1e-4


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    # over 32 different first words, so the context of a text's beginning is wide
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(150)]
    rows = [(i % 190, " ".join(words[k % 150] for k in rng.zipf(1.4, 40))) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    scores = [sorted((r.doc_id, r.n_tokens, r.score) for r in lm_score.score(d).collect()) for d in (df.coalesce(1), df.orderBy("text").repartition(5))]
    assert scores[0] == scores[1]


def test_words_are_packed_and_unpacked():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 4)), bytes(rng.integers(0, 256, rng.integers(0, 9), np.uint8)), int(rng.integers(0, 16)), int(rng.integers(0, 2**50)), int(rng.integers(0, 300)), -float(rng.integers(0, 64)) / 4) for _ in range(500)]
    names = ["chunk", "word", "cls", "n", "known", "lp"]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.float32()), strict=True)], names)
    back = []
    for out in lm_score._pack_words([batch.slice(0, 200), batch.slice(0, 0), batch.slice(200)]):
        for k in range(out.num_rows):
            own = lm_score._unpack_words(pa.Table.from_batches([out.slice(k, 1)]))
            back += [(out.column("in_chunk")[k].as_py(), *r) for r in zip(own[0], *(x.tolist() for x in own[1:]), strict=True)]
    assert sorted(back) == sorted(rows)
