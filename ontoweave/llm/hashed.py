"""Hashed word features of whole texts, and a softmax model over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ontoweave.llm.words import Texts, hashed_spans, mix64, words_of

BITS = 16
_U = np.uint64
_TRIM = np.zeros(256, bool)
_TRIM[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


@dataclass
class Sparse:
    """Distinct hashed features of each text: those of text i are ``ids[bounds[i]:bounds[i + 1]]``."""

    ids: np.ndarray
    bounds: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Summed weight rows of each text."""
        total = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(weights[self.ids], axis=0)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def word_features(texts: Texts, bits: int = BITS) -> tuple[Sparse, np.ndarray]:
    """(features, words of each text). A feature is a lower-cased word without marks around it, or its kind of marks.

    Letters beyond A-Z keep their case.
    """
    words = words_of(texts)
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        live = start < end
        start[live] += _TRIM[texts.data[start[live]]]
        live = start < end
        end[live] -= _TRIM[texts.data[end[live] - 1]]
    text = words.text_of()
    bare = hashed_spans(texts.data, start, end, lower=True)
    marks = hashed_spans(texts.data, end, words.end) ^ _U(1)
    first, second = texts.data[words.start], texts.data[np.maximum(words.end - 1, 0)]
    upper = (first >= 65) & (first <= 90) & (texts.data[np.minimum(words.start + 1, words.end - 1)] <= 90) & (second <= 90)
    echo = np.zeros(len(text), bool)
    echo[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    shape = mix64(upper.astype(_U) * _U(2) + echo.astype(_U) + _U(77))
    size = _U(1 << bits)
    key = np.concatenate([(text.astype(_U) * size) | (h % size) for h in (bare, marks, shape)]) if len(text) else np.empty(0, _U)
    key = np.unique(key)
    bounds = np.searchsorted(key, np.arange(len(texts) + 1, dtype=_U) * size)
    return Sparse((key % size).astype(np.int64), bounds), np.diff(words.bounds)


@dataclass
class Softmax:
    weights: np.ndarray  # (features, classes)
    bias: np.ndarray

    def posteriors(self, features: Sparse) -> np.ndarray:
        z = features.sums(self.weights) + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def telling(features: Sparse, targets: np.ndarray, bits: int, least: float) -> np.ndarray:
    """Features whose number of texts in a class lies ``least`` standard deviations off what their total suggests."""
    n, text = len(targets), features.text_of()
    total = np.bincount(features.ids, minlength=1 << bits)
    found = np.zeros(1 << bits, bool)
    for c in range(targets.shape[1]):
        share = targets[:, c].mean()
        own = np.bincount(features.ids, targets[text, c], 1 << bits)
        spread = np.sqrt(np.maximum(total * share * (1 - share) * (1 - total / (n + 1)), 1e-9))
        found |= (total >= 4) & (np.abs(own - total * share) >= least * spread)
    return found


def fit_softmax(
    features: Sparse, targets: np.ndarray, bits: int = BITS, rounds: int = 200, rate: float = 0.05, shrink: float = 0.1, least: float = 5.0
) -> Softmax:
    """Adam on the cross-entropy with soft ``targets`` (texts, classes), over the features that tell classes apart."""
    n, k = targets.shape
    model = Softmax(np.zeros((1 << bits, k)), np.log(np.maximum(targets.mean(axis=0), 1e-6)))
    used = telling(features, targets, bits, least)[features.ids]
    features = Sparse(features.ids[used], np.concatenate([[0], np.cumsum(used)])[features.bounds])
    text = features.text_of()
    state = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros(k), np.zeros(k)]
    for step in range(1, rounds + 1):
        gap = (targets - model.posteriors(features)) / n
        slope = np.stack([np.bincount(features.ids, gap[text, c], 1 << bits) for c in range(k)], axis=1) - shrink * model.weights / n
        for value, s, i in ((model.weights, slope, 0), (model.bias, gap.sum(axis=0), 2)):
            state[i] = 0.9 * state[i] + 0.1 * s
            state[i + 1] = 0.999 * state[i + 1] + 0.001 * s * s
            value += rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.999**step)) + 1e-8)
    return model


def joined(parts: list[Sparse]) -> Sparse:
    ids = np.concatenate([np.empty(0, np.int64), *(p.ids for p in parts)])
    return Sparse(ids, np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *(np.diff(p.bounds) for p in parts)]))]))


