"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct words (lower-cased, marks at either end dropped) and their first four and five
characters, hashed to 2^18 buckets. A term is there or not, so a long text doesn't thin out an
insult. Every bucket that LEAST_ROWS sampled texts have gets a linear weight and a
vector; the score is sigmoid(w0 + sum of weights + sum over pairs of vector products), so
pairs of terms, such as an insult with the mention of a group, have a weight that neither has alone.

Fitted by Adam on the logistic loss, with fixed seed and order, on a bounded sample of labelled rows: first the
MOST_TERMS (2,000) terms whose shares differ most between the classes, then, from there, all terms, with steps that fade with the
gradient, so what the first leave unexplained moves terms that matter only in pairs. How long the second part runs is
found on rows set apart: a fit without every fourth sampled row is held against those rows after each epoch, the number of epochs with the least loss there is taken (it may be 0),
and the fit is made anew with all sampled rows. With few labels the second part would otherwise learn them by heart.
Defined cases: null and empty texts have the score of no terms; equal texts, repeated rows among them, have equal scores; long texts are read whole, their terms
counted once; without labels all texts score 0.5, with labels of one class near that class, and `without_toxic` then keeps every row; an empty table
gives no rows; columns are picked by exact name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from loomwork.llm.labelled import SAMPLE_ROWS, examples, filtered, verdicts

BUCKETS = 1 << 18
FOLDS, HELD_OUT = 4, 2
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
MOST_TERMS, LEAST_Z, FACTORS = 2000, 4.0, 4  #: terms that are fitted first, at most and by what z; the length of vectors
LEAST_ROWS = 3  #: sampled texts that must have a term
APART = 4  #: one sampled row in so many is set apart to say when to stop
RATE = 0.004  #: of Adam's steps for all terms
LEAST_STEPS = 300  #: of Adam for the first terms, as few labels make few steps an epoch; for all terms about so many are enough


def word_terms(word: str) -> tuple[int, ...]:
    word = word.strip(EDGES)
    if not word:
        return ()
    terms = [word, *(f"{n}:{word[:n]}" for n in (4, 5) if len(word) >= n)]
    return tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms)


def terms_of(text: str) -> np.ndarray:
    """The sorted distinct buckets of a text."""
    found: set[int] = set()
    for w in set(text.lower().split()):
        found.update(word_terms(w))
    return np.array(sorted(found), np.uint32)


@dataclass
class FactorizationMachine:
    """bias, and for each bucket in `buckets` a weight and a row of `vectors`."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    fitted: bool = True

    def score(self, texts: list[str]) -> np.ndarray:
        place = np.full(BUCKETS, -1, np.int32)
        place[self.buckets] = np.arange(len(self.buckets))
        place = place.tolist()
        known: dict[str, tuple[int, ...]] = {}
        out = np.empty(len(texts))
        for n, text in enumerate(texts):
            if len(known) > 150_000:
                known.clear()
            found: set[int] = set()
            for w in set(text.lower().split()):
                if (t := known.get(w)) is None:
                    t = known[w] = tuple(place[b] for b in word_terms(w) if place[b] >= 0)
                if t:
                    found.update(t)
            at = np.sort(np.fromiter(found, np.int64, len(found)))
            v = self.vectors[at]
            out[n] = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _raw(theta: np.ndarray, bias: float, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log odds of the rows, the terms of all rows, the row of each, the rows' sums of vectors)."""
    at = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    own = theta[at]
    total = np.stack([np.bincount(of, own[:, k], len(rows)) for k in range(1 + FACTORS)], 1)
    s, squares = total[:, 1:], np.bincount(of, (own[:, 1:] ** 2).sum(1), len(rows))
    return np.clip(bias + total[:, 0] + 0.5 * ((s**2).sum(1) - squares), -30, 30), at, of, s


def _descend(
    theta: np.ndarray, bias: float, rows: list[np.ndarray], labels: np.ndarray, epochs: int, rate: float, damp: float, rng: np.random.Generator, after: Callable[[float], None] | None = None
) -> float:
    """Adam over rows of term positions; theta (weight, vector for each term) is changed in place, the new bias returned.

    rate: of a step. damp is Adam's epsilon: gradients far below it hardly move anything. after: called with the bias at the end of each epoch.
    """
    mean, square, t = np.zeros_like(theta), np.zeros_like(theta), 0
    bias_mean = bias_square = 0.0
    decay = np.array([1e-4] + [1e-3] * FACTORS, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), 256):
            b, t = order[a : a + 256], t + 1
            raw, at, of, s = _raw(theta, bias, [rows[i] for i in b])
            g = (1 / (1 + np.exp(-raw)) - labels[b]) / len(b)
            each = np.concatenate([g[:, None], g[:, None] * s], 1)
            grad = np.stack([np.bincount(at, each[of, k], len(theta)) for k in range(1 + FACTORS)], 1).astype(np.float32)
            grad[:, 1:] -= grad[:, :1] * theta[:, 1:]
            grad += decay * theta
            mean += 0.1 * (grad - mean)
            square += 0.001 * (grad**2 - square)
            theta -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + damp)
            bias_mean += 0.1 * (g.sum() - bias_mean)
            bias_square += 0.001 * (g.sum() ** 2 - bias_square)
            bias -= 0.02 * (bias_mean / (1 - 0.9**t)) / (np.sqrt(bias_square / (1 - 0.999**t)) + 1e-8)
        if after:
            after(float(bias))
    return float(bias)


def fit(features: list[np.ndarray], labels: np.ndarray, epochs: int = 30, seed: int = 7) -> FactorizationMachine:
    most = min(2 * epochs // 3, -(-LEAST_STEPS // max(1, -(-len(labels) // 256))))
    apart = np.arange(len(labels)) % APART == 1
    if len(set(labels[apart])) < 2 or len(set(labels[~apart])) < 2:
        return _fit(features, labels, epochs, seed, most)[0]  # too few rows to set any apart
    _, losses = _fit([f for f, x in zip(features, apart, strict=True) if not x], labels[~apart], epochs, seed, most, ([f for f, x in zip(features, apart, strict=True) if x], labels[apart]))
    return _fit(features, labels, epochs, seed, int(np.argmin(losses)))[0]


def _fit(
    features: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int, second: int, against: tuple[list[np.ndarray], np.ndarray] | None = None
) -> tuple[FactorizationMachine, list[float]]:
    """The machine after `second` epochs over all terms, and the losses on the rows `against` after each of them, from 0 on."""
    if not len(labels) or labels.min() == labels.max():  # nothing to tell apart
        bias = 0.0 if not len(labels) else (5.0 if labels[0] else -5.0)
        return FactorizationMachine(bias, np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, FACTORS)), False), []
    counts = np.zeros((2, BUCKETS))
    for f, label in zip(features, labels, strict=True):  # a text's buckets are distinct
        counts[int(label), f] += 1
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    c0, c1 = counts
    p = (c1 + c0) / len(labels)
    z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    z[c1 + c0 < LEAST_ROWS] = 0
    first = np.sort(np.argsort(-np.abs(z), kind="stable")[:MOST_TERMS])
    first = first[np.abs(z[first]) > LEAST_Z]
    buckets = np.flatnonzero(c1 + c0 >= LEAST_ROWS)

    rng = np.random.default_rng(seed)
    theta = np.zeros((BUCKETS, 1 + FACTORS), np.float32)
    theta[:, 1:] = rng.normal(0, 0.005, (BUCKETS, FACTORS))
    theta[first, 1:] = rng.normal(0, 0.05, (len(first), FACTORS))
    bias = float(np.log(n1 / n0))
    rounds = max(epochs, -(-LEAST_STEPS // -(-len(labels) // 256)))
    losses: list[float] = []
    for terms, rounds, rate, damp in ((first, rounds, 0.02, 1e-8), (buckets, second, RATE, 1e-2)):
        place = np.full(BUCKETS, -1, np.int32)
        place[terms] = np.arange(len(terms), dtype=np.int32)
        known = lambda found, place=place: [at[at >= 0] for at in (place[f.view(np.int32)] for f in found)]
        own, after = theta[terms], None
        if terms is buckets and against:
            apart = known(against[0])

            def after(bias: float, own=own, apart=apart) -> None:
                raw = _raw(own, bias, apart)[0]
                losses.append(float(np.mean(np.logaddexp(0, np.where(against[1] > 0, -raw, raw)))))

            after(bias)
        bias = _descend(own, bias, known(features), labels, rounds, rate, damp, rng, after)
        theta[terms] = own
    return FactorizationMachine(bias, buckets.astype(np.uint32), theta[buckets, 0], theta[buckets, 1:]), losses


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fitted on at most `most` rows of labels outside the held-out fold."""
    return fit(*examples(docs, labels, "toxic", FOLDS, HELD_OUT, terms_of, most))


def score_toxicity(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    return verdicts(docs, model.score, FOLDS, HELD_OUT)


def without_toxic(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that score under the threshold."""
    return filtered(docs, model, lambda score: score < threshold)
