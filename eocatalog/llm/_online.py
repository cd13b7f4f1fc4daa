"""Online mixing of adaptive bit predictors along texts, many stretches of text side by side.

Each decision has several hashed contexts; each context has counts of zeros and ones that give a
prediction, a gate picks the weights that mix the predictions in the logistic domain, and an adaptive map
refines the mix. Every decision is predicted before its bit updates counts, weights and map. Decisions of held-out
texts update nothing.
"""

from __future__ import annotations

import numpy as np

TABLE_BITS = 16
STRETCH = 96
_STEPS, _LIMIT = 24, 9.0


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _turned(xs: list[np.ndarray], stretch: int) -> np.ndarray:
    """For each array, a row for each place in its stretches, filled up with zeros."""
    n = len(xs[0])
    out = np.zeros((len(xs), stretch, -(-n // stretch)), xs[0].dtype)
    whole = n // stretch
    for x, turned in zip(xs, out, strict=True):
        turned.T[:whole] = x[: whole * stretch].reshape(whole, stretch)
        turned[: n % stretch, whole:] = x[whole * stretch :, None]
    return out


def _slots(contexts, bits: int) -> list[np.ndarray]:
    """Where the counts of zeros of 64-bit hashes lie; those of ones are beside them. Each context has so many slots, as a power of two."""
    shift, out = np.uint64(64 - bits), []
    for k, x in enumerate(contexts):
        slot = x * np.uint64(0x9E3779B97F4A7C15)
        slot >>= shift
        slot <<= np.uint64(1)
        slot += np.uint64(k * (2 << bits))
        out.append(slot.view(np.intp))
    return out


def _slopes(gate: np.ndarray, error: np.ndarray, inputs: np.ndarray, n_gates: int) -> np.ndarray:
    """The mean of error times input, by input and gate."""
    out = np.empty((len(inputs), n_gates))
    for k, x in enumerate(inputs):
        out[k] = np.bincount(gate, error * x, n_gates)
    out /= np.maximum(np.bincount(gate, minlength=n_gates), 1)
    return out.astype(np.float32)


def _mixed(weights: np.ndarray, gate: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    out = weights[0][gate] * inputs[0]
    for w, x in zip(weights[1:], inputs[1:], strict=True):
        out += w[gate] * x
    return np.clip(out, -_LIMIT, _LIMIT, out=out)


class Mixer:
    """Counts of each context, weights by gate, and the refining map, all of which learn as they predict."""

    def __init__(self, n_ctx: int, n_gates: int, rate: float = 0.02):
        self.n_gates, self.rate = n_gates, rate
        # zeros and ones of a slot side by side, one context after another
        self.counts = np.full(n_ctx * (2 << TABLE_BITS), 0.4, np.float32)
        # a row for each context
        self.weights = np.full((n_ctx, n_gates), 1.2 / n_ctx, np.float32)
        self.squares = np.full((n_ctx, n_gates), 1e-3, np.float32)
        centres = 1 / (1 + np.exp(-np.linspace(-_LIMIT, _LIMIT, _STEPS + 1)))
        self.map_all = np.full(n_gates * (_STEPS + 1), 8.0, np.float32)
        self.map_ones = np.tile(8.0 * centres, n_gates).astype(np.float32)

    def predict(self, contexts: np.ndarray, gates: np.ndarray, bits: np.ndarray, learns: np.ndarray) -> np.ndarray:
        """The log10 probability of each bit, in order.

        contexts has a row of 64-bit hashes for each predictor. The decisions are cut into stretches of STRETCH,
        which are taken a decision at a time, all stretches together.
        """
        n = len(bits)
        stretch = STRETCH if learns.any() else 1  # without learning the order doesn't matter
        slots, gates = _turned(_slots(contexts, TABLE_BITS), stretch), _turned([gates], stretch)[0]
        bits, learns = _turned([bits, learns], stretch)
        out = np.ones(bits.shape, np.float32)
        for t in range(min(stretch, n)):
            own = len(range(t, n, stretch))
            out[t, :own] = self._step(slots[:, t, :own], gates[t, :own], bits[t, :own], learns[t, :own])
        return np.log10(out).T.ravel()[:n]

    def _step(self, slots: np.ndarray, gate: np.ndarray, bit: np.ndarray, learns: np.ndarray) -> np.ndarray:
        """The probability of each bit."""
        inputs = self.counts.take(slots + 1)
        inputs /= self.counts.take(slots)
        np.log(inputs, out=inputs)
        mixed = _mixed(self.weights, gate, inputs)
        p = 1 / (1 + np.exp(-mixed))
        mixed += np.float32(_LIMIT)
        mixed *= np.float32(_STEPS / (2 * _LIMIT))
        place = np.rint(mixed, out=mixed).astype(np.intp)
        place += gate * (_STEPS + 1)
        refined = (p + self.map_ones.take(place) / self.map_all.take(place)) / 2
        np.clip(refined, 1e-5, 1 - 1e-5, out=refined)
        out = np.where(bit, refined, 1 - refined)
        if not learns.all():
            bit, gate, place, p, inputs, slots = bit[learns], gate[learns], place[learns], p[learns], inputs[:, learns], slots[:, learns]
        if not len(bit):
            return out
        slope = _slopes(gate, bit - p, inputs, self.n_gates)
        self.squares += slope * slope
        self.weights += self.rate * slope / np.sqrt(self.squares)
        np.add.at(self.counts, (slots + bit).ravel(), np.float32(1))
        self.map_all += np.bincount(place, minlength=len(self.map_all)).astype(np.float32)
        self.map_ones += np.bincount(place, bit, len(self.map_ones)).astype(np.float32)
        return out


class CodeMixer:
    """Mixes predictions that are given with those of hashed contexts, for the bits of codes.

    The gate is how often each of the contexts was seen; weights start with the given predictions alone.
    """

    LEVELS = (1.2, 3.2, 9.2)

    def __init__(self, n_given: int, n_ctx: int, bits: int = 19, rate: float = 0.02):
        self.n_given, self.n_gates, self.rate, self.bits = n_given, (len(self.LEVELS) + 1) ** n_ctx, rate, bits
        # zeros and ones of a slot side by side, one context after another
        self.counts = np.full(n_ctx * (2 << bits), 0.4, np.float32)
        # a row for each input
        self.weights = np.repeat(np.array([0.9 / n_given] * n_given + [0.2] * n_ctx, np.float32)[:, None], self.n_gates, axis=1)
        self.squares = np.full(self.weights.shape, 1e-3, np.float32)

    def predict(self, given: list[np.ndarray], contexts: list[np.ndarray], bits: np.ndarray, learns: bool) -> np.ndarray:
        """The log10 probability of each bit, in order; stretches as in Mixer. Either all bits teach or none does."""
        n = len(bits)
        stretch = STRETCH if learns else 1
        slots, given, bits = _turned(_slots(contexts, self.bits), stretch), _turned(given, stretch), _turned([bits], stretch)[0]
        sign = bits * np.float32(2) - np.float32(1)
        out = np.ones(bits.shape, np.float32)
        for t in range(min(stretch, n)):
            own = len(range(t, n, stretch))
            out[t, :own] = self._step(given[:, t, :own], slots[:, t, :own], bits[t, :own], sign[t, :own], learns)
        return np.log10(out).T.ravel()[:n]

    def _step(self, given: np.ndarray, slots: np.ndarray, bit: np.ndarray, sign: np.ndarray, learns: bool) -> np.ndarray:
        """The probability of each bit; sign is 1 for a one and -1 for a zero."""
        inputs, gate = np.empty((len(self.weights), len(bit)), np.float32), np.zeros(len(bit), np.intp)
        zeros, ones = self.counts.take(slots), self.counts.take(slots + 1)
        inputs[: self.n_given] = given
        np.log(ones / zeros, out=inputs[self.n_given :])
        zeros += ones
        level = (zeros > np.float32(self.LEVELS[0])).view(np.int8)
        for least in self.LEVELS[1:]:
            level += zeros > np.float32(least)
        for x in level:
            gate *= len(self.LEVELS) + 1
            gate += x
        mixed = _mixed(self.weights, gate, inputs)
        mixed *= -sign
        hit = 1 / (1 + np.exp(mixed))  # the probability of the bit that came
        if learns:
            slope = _slopes(gate, (1 - hit) * sign, inputs, self.n_gates)
            self.squares += slope * slope
            self.weights += self.rate * slope / np.sqrt(self.squares)
            np.add.at(self.counts, (slots + bit).ravel(), np.float32(1))
        return hit
