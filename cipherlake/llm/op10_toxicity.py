"""Toxicity: a small convolutional text classifier.

Every word has the sum of hashed embeddings of the word itself and of its leading letters. Filters of several widths run
over the words, each filter keeps its largest value (max pooling), and a logistic layer joins them. numpy trains it on a
bounded sample of labelled rows: the first embedding dimension starts as the log odds of a bucket, the rest at random. A
fifth of the sample isn't trained on; it calibrates scores to probabilities and gives each language its own threshold.

Scoring is one narrow pass over whole texts. Since a filter is linear in the embeddings, each distinct word's product
with all filters is kept in a bounded table, and a document is a gather, a few shifted sums and a maximum; long texts go
in overlapping blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm import labelled
from cipherlake.llm.common import bucket

WORD_BITS, DIMENSIONS, FILTERS, WIDTHS = 16, 12, 8, (1, 2, 3)
PER_LABEL = 3000
MAX_TRAINING_CHARS = 40_000
BLOCK_WORDS = 20_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class Model(NamedTuple):
    table: np.ndarray  # buckets x DIMENSIONS
    filters: list[np.ndarray]  # for each width: width x DIMENSIONS x FILTERS
    bias: np.ndarray  # of all filters
    out: np.ndarray
    slope: float  # of the calibration
    offset: float
    thresholds: dict  # by language; None is for the others


def units(word: str) -> list[int]:
    """Three buckets of a word: the word, its first four and its first five letters; bucket 0 is for none."""
    plain = _EDGES.sub("", word.lower())
    if not plain:
        return [0, 0, 0]
    heads = [bucket(f"{n}:{plain[:n]}", WORD_BITS) if len(plain) > n else 0 for n in (4, 5)]
    return [bucket(plain, WORD_BITS), *heads]


def _pooled(x: np.ndarray, filters: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest value of every filter over the word vectors x, and where it starts."""
    best, at = [], []
    for w, f in zip(WIDTHS, filters, strict=True):
        n = len(x) - w + 1
        c = sum(x[k : k + n] @ f[k] for k in range(w))
        at.append(c.argmax(0))
        best.append(c[at[-1], np.arange(FILTERS)])
    return np.concatenate(best), at


def train(docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 5, rate: float = 0.02, batch: int = 16, seed: int = 11) -> tuple:
    """Embeddings, filters, biases and output weights. A document is an array of words x 3 buckets."""
    rng = np.random.default_rng(seed)
    size = 1 << WORD_BITS
    hits = np.zeros((2, size))
    for d, y in zip(docs, labels, strict=True):
        hits[int(y), np.unique(d)] += 1
    n = np.bincount(labels.astype(int), minlength=2) + 1
    odds = np.log((hits[1] + 0.5) / n[1]) - np.log((hits[0] + 0.5) / n[0])
    table = rng.normal(0, 0.05, (size, DIMENSIONS))
    table[:, 0] = np.where(hits.sum(0) >= 3, np.clip(odds, -2, 4), 0) / 3
    table[0] = 0
    filters = [rng.normal(0, 0.1, (w, DIMENSIONS, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, :2] += 1 / len(f)
    bias, out = np.full(FILTERS * len(WIDTHS), -0.3), np.full(FILTERS * len(WIDTHS) + 1, 0.3)
    out[-1] = -2.0
    params = [*filters, bias, out]
    first, second, steps = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    seen = np.full((size, DIMENSIONS), 1e-2)
    for _ in range(epochs if len(docs) else 0):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            grads = [np.zeros_like(p) for p in params]
            ids_all, rows_all = [], []
            for k in part:
                d = docs[k]
                x = table[d].sum(1)
                best, at = _pooled(x, filters)
                h = np.maximum(best + bias, 0)
                z = h @ out[:-1] + out[-1]
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[k]) * weights[k] / len(part)
                grads[-1][:-1] += e * h
                grads[-1][-1] += e
                dh = e * out[:-1] * (best + bias > 0)
                grads[-2] += dh
                for j, (w, f, a) in enumerate(zip(WIDTHS, filters, at, strict=True)):
                    g = dh[j * FILTERS : (j + 1) * FILTERS]
                    for s in range(w):
                        grads[j][s] += x[a + s].T * g
                        ids_all.append(d[a + s].reshape(-1))
                        rows_all.append(np.repeat(f[s].T * g[:, None], d.shape[1], axis=0))
            steps += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
            ids, rows = np.concatenate(ids_all), np.concatenate(rows_all)
            unique, inverse = np.unique(ids, return_inverse=True)
            total = np.zeros((len(unique), DIMENSIONS))
            np.add.at(total, inverse, rows)
            total[unique == 0] = 0
            seen[unique] += total**2
            table[unique] -= 0.05 * total / np.sqrt(seen[unique])
    return table, filters, bias, out


class Scorer:
    """Raw scores with a bounded table of each distinct word's products with the filters."""

    def __init__(self, model: Model, limit: int = 100_000):
        self.model, self.limit = model, limit
        self.columns = sum(WIDTHS) * FILTERS
        self.matrix = np.concatenate([f[k] for f in model.filters for k in range(len(f))], 1).astype(np.float32)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((limit + 1, self.columns), np.float32)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list(words)
        if new:
            at = len(self.known) + 1
            self.rows[at : at + len(new)] = self.model.table[np.array([units(w) for w in new])].sum(1) @ self.matrix
            self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def _block(self, words: list[str]) -> np.ndarray:
        self._learn(set(words))
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        m, best, at = self.rows[ids], [], 0
        for w in WIDTHS:
            n = len(ids) - w + 1
            c = m[:n, at : at + FILTERS].copy()
            for k in range(1, w):
                c += m[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
            best.append(c.max(0))
            at += w * FILTERS
        return np.concatenate(best)

    def __call__(self, text: str | None) -> float:
        words = ((text or "").split() or [""]) + [""] * (max(WIDTHS) - 1)  # an empty word is nothing
        step = BLOCK_WORDS - max(WIDTHS) + 1
        best = np.max([self._block(words[k : k + BLOCK_WORDS]) for k in range(0, len(words) - max(WIDTHS) + 1, step)], axis=0)
        h = np.maximum(best + self.model.bias, 0)
        return float(h @ self.model.out[:-1] + self.model.out[-1])


def calibrate(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through raw scores, by Newton steps with a weak pull to (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weights * (p - labels) * z).sum() + (a - 1), (weights * (p - labels)).sum() + 0.1 * b])
        s = weights * p * (1 - p)
        hessian = np.array([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.1]])
        a, b = (float(v) for v in np.array([a, b]) - np.linalg.solve(hessian, g))
    return max(a, 0.05), b


def best_threshold(p: np.ndarray, labels: np.ndarray, weights: np.ndarray, default: float) -> float:
    """The threshold with the largest F1; the default where a label is missing or rare."""
    if labels.sum() < 5 or (1 - labels).sum() < 5:
        return default
    cuts = np.linspace(0.05, 0.95, 91)
    f1 = [2 * (weights * labels)[p >= c].sum() / max(1e-9, weights[p >= c].sum() + (weights * labels).sum()) for c in cuts]
    return float(np.mean(cuts[np.array(f1) >= max(f1) - 1e-12]))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "toxic", lang_col: str | None = None, default_threshold: float = 0.3,
        per_label: int = PER_LABEL, max_chars: int = MAX_TRAINING_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most `per_label` rows of either label, calibrated to the shares of all allowed labels. lang_col only
    names the groups that get thresholds of their own; scores don't know it."""
    rows, share = labelled.sample(docs, labels, label_col, allowed, per_label, max_chars, id_col, text_col, (lang_col,) if lang_col else ())

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, list[int]] = {}
        for b in batches:
            out = []
            for text in b["text"]:
                if len(memo) > 200_000:
                    memo.clear()
                words = text.split() or [""]
                for w in set(words):
                    if w not in memo:
                        memo[w] = units(w)
                out.append(np.array([memo[w] for w in words], np.int32).tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "lang": b["lang"], "ids": out})

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    got = rows.select("doc_id", "label", "text", lang.alias("lang")).mapInPandas(buckets, "doc_id long, label int, lang string, ids binary").toPandas().sort_values("doc_id")
    y, share = got["label"].to_numpy(float), 0.1 if share is None else share
    blank = np.zeros((max(WIDTHS) - 1, 3), np.int64)
    made = [np.concatenate([np.frombuffer(i, np.int32).reshape(-1, 3).astype(np.int64), blank]) for i in got["ids"]]
    weights = np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean())) if len(y) else y
    test = np.arange(len(y)) % 5 == 4
    parts = train([d for d, t in zip(made, test, strict=True) if not t], y[~test], np.sqrt(weights[~test]) if len(y) else y)
    model = Model(*parts, 1.0, 0.0, {None: default_threshold})
    z = np.array([np.maximum(_pooled(model.table[d].sum(1), model.filters)[0] + model.bias, 0) @ model.out[:-1] + model.out[-1] for d, t in zip(made, test, strict=True) if t])
    if len(z) and 0 < y[test].sum() < test.sum():
        slope, offset = calibrate(z, y[test], weights[test])
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        langs = got["lang"].to_numpy()[test]
        own = {g: best_threshold(p[langs == g], y[test][langs == g], weights[test][langs == g], default_threshold) for g in sorted({g for g in langs if isinstance(g, str)})}
        model = model._replace(slope=slope, offset=offset, thresholds={None: best_threshold(p, y[test], weights[test], default_threshold)} | own)
    return model._replace(table=model.table.astype(np.float32))


def score(model: Model, text: Column) -> Column:
    """Calibrated score in 0..1 of whole texts; null counts as empty."""
    ready: list[Scorer] = []

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not ready:
            ready.append(Scorer(model))
        for texts in batches:
            z = np.array([ready[0](t) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(model.slope * z + model.offset, -30, 30))))

    return run(text.cast("string"))


def flagged(model: Model, score_col: Column, lang: Column) -> Column:
    """True where a score reaches the threshold of its language (those of no known one share another)."""
    rest = F.lit(model.thresholds[None])
    own = [x for g, t in model.thresholds.items() if g is not None for x in (F.lit(g), F.lit(t))]
    return score_col >= (F.coalesce(F.create_map(*own)[lang], rest) if own else rest)
