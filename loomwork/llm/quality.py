"""Quality: naive Bayes log-count ratios on n-gram indicators, then a linear hinge-loss model (NBSVM).

A text is a sequence of words and of their shapes, of the whole of each word: runs of upper-case letters, lower-case letters and digits become A, a
and 0, other characters stay, repeats of one are cut to two; a word equal to the one before it is the shape "=". The
n-grams of one to three shapes and those of one or two words, hashed to the two halves of 2^19 buckets, are
there or not. Each indicator is scaled by the log ratio
of its smoothed shares in the two classes, and a linear model with hinge loss is fitted by dual coordinate
descent. Platt's sigmoid makes margins into scores.

Defined cases: null and empty texts have the score of no n-grams; equal texts, repeated rows among them, have equal scores; long texts are read
whole; without labels all texts score 0.5, with labels of one class near that class, and `with_quality` then keeps every row; an empty
table gives no rows; columns are picked by exact name.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from loomwork.llm.labelled import SAMPLE_ROWS, calibrate, examples, filtered, verdicts

HALF = 1 << 18  #: of the buckets: shapes lie below, words from here
BUCKETS = 2 * HALF
FOLDS, HELD_OUT = 5, 0
SAME = 1  #: the shape of a word that repeats the one before it


def shape_of(word: str) -> str:
    classes = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1\1+", r"\1\1", re.sub(r"([Aa0])\1+", r"\1", classes))


def _code(word: str) -> int:
    """The hash of a word above the 16-bit hash of its shape."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) << 16 | (zlib.crc32(shape_of(word).encode("utf-8", "surrogatepass")) % 65521 + 2)


def ngrams_of(text: str, known: dict[str, int] | None = None) -> np.ndarray:
    """The sorted distinct buckets of a text's n-grams."""
    words = text.split()
    known = {} if known is None else known
    for w in set(words).difference(known):
        known[w] = _code(w)
    codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    shapes, w = codes & 0xFFFF, (codes >> 16).astype(np.uint64)
    if len(codes) > 1:
        shapes[1:][codes[1:] == codes[:-1]] = SAME
    s = shapes.astype(np.uint64)
    mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)  # noqa: E731  the upper 18 bits
    two = (s[:-1] << np.uint64(17)) + s[1:] + np.uint64(1 << 60)
    three = (s[:-2] << np.uint64(34)) + (s[1:-1] << np.uint64(17)) + s[2:] + np.uint64(1 << 61)
    pairs = w[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[1:] + np.uint64(1 << 62)
    of_words = np.concatenate([mix(w), mix(pairs)]) + np.uint64(HALF)
    return np.unique(np.concatenate([mix(s), mix(two), mix(three), of_words]).astype(np.uint32))


@dataclass
class NBSVM:
    """The weight of each bucket (ratio and linear weight in one), the margin's offset, and the sigmoid's a and b."""

    weights: np.ndarray
    offset: float
    a: float
    b: float
    fitted: bool = True

    def score(self, texts: list[str]) -> np.ndarray:
        known: dict[str, int] = {}
        margins = np.empty(len(texts))
        for n, text in enumerate(texts):
            if len(known) > 150_000:
                known.clear()
            margins[n] = self.weights[ngrams_of(text, known)].sum() + self.offset
        return 1 / (1 + np.exp(-np.clip(self.a * margins + self.b, -30, 30)))


def fit(features: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 20, seed: int = 7) -> NBSVM:
    if not len(labels) or labels.min() == labels.max():
        return NBSVM(np.zeros(BUCKETS), 0.0, 1.0, 0.0 if not len(labels) else (5.0 if labels[0] else -5.0), False)
    counts = np.zeros((2, BUCKETS))
    for f, label in zip(features, labels, strict=True):  # a text's buckets are distinct
        counts[int(label), f] += 1
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    p1 = (counts[1] + 1) / (n1 + 2)
    p0 = (counts[0] + 1) / (n0 + 2)
    ratio = np.log(p1 / p0)
    ratio[counts.sum(0) < 3] = 0  # too rare to tell
    y = np.where(labels > 0, 1.0, -1.0)
    norms = np.array([(ratio[f] ** 2).sum() + 1.0 for f in features])
    w, offset, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            f, v = features[i], ratio[features[i]]  # looked up again, so that the driver holds the buckets only
            g = y[i] * (w[f] @ v + offset) - 1.0
            if (alpha[i] == 0 and g >= 0) or (alpha[i] == c and g <= 0):
                continue
            new = min(max(alpha[i] - g / norms[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[f] += step * v
            offset += step
            most = max(most, abs(g))
        if most < 1e-3:
            break
    weights = w * ratio
    margins = np.array([weights[f].sum() + offset for f in features])
    return NBSVM(weights, offset, *calibrate(margins, labels))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> NBSVM:
    """Fitted on at most `most` rows of labels outside the held-out fold."""
    return fit(*examples(docs, labels, "quality", FOLDS, HELD_OUT, ngrams_of, most))


def score_quality(docs: DataFrame, model: NBSVM) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    return verdicts(docs, model.score, FOLDS, HELD_OUT)


def with_quality(docs: DataFrame, model: NBSVM, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold."""
    return filtered(docs, model, lambda score: score >= threshold)
