"""Quality classifier: a factorisation machine.

A document's features are its hashed words and word shapes (weighted by their share of the words), structure statistics
and numeric metadata, the latter two cut into intervals. The score has a bias, a weight for each feature and, for each
pair of features, the product of low-rank vectors; the sum over all pairs is taken in linear time as half the square of
the sum less the sum of squares. Training is numpy on a bounded sample of labelled rows; scoring is one narrow pass over
whole texts, no shuffle, with memory bounded by a batch."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm import labelled
from cipherlake.llm.common import Memo, bucket

WORD_BITS, SHAPE_BITS, RANK = 15, 11, 8
STATISTICS, INTERVALS = 14, 16
PER_LABEL = 4000
MAX_TRAINING_CHARS = 60_000
_RUN = re.compile(r"(.)\1+")
_EDGES = re.compile(r"^\W+|\W+$")


class Model(NamedTuple):
    bias: float
    weight: np.ndarray  # a weight for each feature
    vector: np.ndarray  # RANK numbers for each feature
    metadata: int


def shape(word: str) -> str:
    """The kinds of a word's characters, runs shortened."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word[:200])
    return _RUN.sub(r"\1\1", kinds)


def word_features(word: str) -> tuple[int, int]:
    plain = _EDGES.sub("", word.lower()) or word
    return bucket(plain, WORD_BITS), (1 << WORD_BITS) + bucket(shape(word), SHAPE_BITS)


_KIND = np.full(256, 5)  # of UTF-8 bytes: upper, lower, digit, white, sign, part of another letter
_KIND[33:127] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 2, 0, 1


def statistics(text: str, counts: Counter) -> list[float]:
    """STATISTICS numbers on a document's structure, most of them from 0 to 1."""
    data = np.frombuffer(text.encode(), np.uint8)
    n, words = max(1, len(data)), max(1, sum(counts.values()))
    kinds = np.bincount(_KIND[data], minlength=6) / n
    lines = text.split("\n")
    upper = kinds[0] / max(1e-9, kinds[0] + kinds[1])
    most = counts.most_common(2)
    return [*kinds.tolist(), upper, len(counts) / words, most[0][1] / words if most else 0.0, most[1][1] / words if len(most) > 1 else 0.0,
            len(set(lines)) / len(lines), min(1.0, n / words / 20), min(1.0, np.log1p(words) / 12), min(1.0, np.log1p(words / len(lines)) / 8)]


def intervals(values: list[float], first: int) -> list[int]:
    """A feature for each number: finer intervals near 0 and 1; missing numbers get the last one."""
    out = []
    for k, x in enumerate(values):
        if x != x:
            at = INTERVALS - 1
        else:
            at = min(INTERVALS - 2, int(np.searchsorted(_CUTS, x)))
        out.append(first + k * INTERVALS + at)
    return out


_CUTS = np.array([0.002, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.55, 0.7, 0.8, 0.9, 0.96, 0.99])
_FIRST_STATISTIC = (1 << WORD_BITS) + (1 << SHAPE_BITS)


def scaled(metadata: Column) -> Column:
    """Metadata as the logarithm of its size, scaled to about 0..1; null stays null."""
    return (F.log1p(F.abs(metadata.cast("double"))) / 20).cast("double")


def features(text: str | None, metadata: list[float], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and values. Null counts as empty: only statistics and metadata speak then."""
    counts = Counter((text or "").split())
    n = max(1, sum(counts.values()))
    ids = np.array([memo[w] for w in counts], np.int64).reshape(-1)
    share = np.repeat(np.fromiter(counts.values(), float, len(counts)) / n, 2)
    fixed = intervals(statistics(text or "", counts) + metadata, _FIRST_STATISTIC)
    return np.concatenate([ids, np.array(fixed, np.int64)]), np.concatenate([share * 4, np.full(len(fixed), 0.5)])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, metadata: int = 0, epochs: int = 8,
          rate: float = 0.05, decay: float = 1e-5, batch: int = 128, seed: int = 7) -> Model:
    """Fit by AdaGrad on the logistic loss."""
    size = _FIRST_STATISTIC + (STATISTICS + metadata) * INTERVALS
    rng = np.random.default_rng(seed)
    weight, vector = np.zeros(size), rng.normal(0, 0.05, (size, RANK))
    prior = float(np.average(labels, weights=weights)) if len(labels) else 0.5
    bias = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
    sw, sv, sb = np.full(size, 1e-3), np.full((size, RANK), 1e-3), 1e-3
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            lens = np.array([len(rows[k][0]) for k in part])
            ids, x = np.concatenate([rows[k][0] for k in part]), np.concatenate([rows[k][1] for k in part])
            starts, doc = np.cumsum(lens) - lens, np.repeat(np.arange(len(part)), lens)
            v = vector[ids] * x[:, None]
            total = np.add.reduceat(v, starts)
            z = bias + np.add.reduceat(weight[ids] * x, starts) + 0.5 * (total**2 - np.add.reduceat(v**2, starts)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weights[part]
            e = error[doc] * x
            unique, inverse = np.unique(ids, return_inverse=True)
            gw = np.bincount(inverse, e) + decay * weight[unique]
            gv_rows = (total[doc] - v) * e[:, None]
            gv = np.stack([np.bincount(inverse, gv_rows[:, f]) for f in range(RANK)], 1) + decay * vector[unique]
            sw[unique] += gw**2
            sv[unique] += gv**2
            weight[unique] -= rate * gw / np.sqrt(sw[unique])
            vector[unique] -= rate * gv / np.sqrt(sv[unique])
            g = float(error.sum())
            sb += g * g
            bias -= rate * g / sb**0.5
    return Model(bias, weight.astype(np.float32), vector.astype(np.float32), metadata)


def probability(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Scores of documents given as feature ids and values."""
    lens = np.array([len(ids) for ids, _ in rows])
    starts = np.cumsum(lens) - lens
    ids, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    v = model.vector[ids] * x[:, None]
    total = np.add.reduceat(v, starts)
    z = model.bias + np.add.reduceat(model.weight[ids] * x, starts) + 0.5 * (total**2 - np.add.reduceat(v**2, starts)).sum(1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "quality", metadata_cols: tuple[str, ...] = (),
        per_label: int = PER_LABEL, max_chars: int = MAX_TRAINING_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most `per_label` rows of either label, weighted to the shares of all allowed labels."""
    rows, share = labelled.sample(docs, labels, label_col, allowed, per_label, max_chars, id_col, text_col, metadata_cols)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(word_features)
        for b in batches:
            made = [features(t, [float(v) for v in meta], memo) for t, *meta in b[["text", *metadata_cols]].itertuples(index=False)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "ids": [i.astype(np.int32).tobytes() for i, _ in made], "x": [x.astype(np.float32).tobytes() for _, x in made]})

    ready = rows.select("doc_id", "label", "text", *[scaled(F.col(c)).alias(c) for c in metadata_cols])
    share = 0.5 if share is None else share

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"doc_id": [], "label": [], "ids": [], "x": []}), *batches]).sort_values("doc_id")
        y = got["label"].to_numpy(float)
        weights = np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean())) if len(y) else y
        pairs = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(float)) for i, x in zip(got["ids"], got["x"], strict=True)]
        model = train(pairs, y, weights, len(metadata_cols))
        yield pd.DataFrame({"bias": [model.bias], "weight": [model.weight.tobytes()], "vector": [model.vector.tobytes()]})

    # the sample is bounded, so one task takes it; the driver gets the model alone
    made = ready.mapInPandas(featurise, "doc_id long, label int, ids binary, x binary").repartition(1).mapInPandas(learn, "bias double, weight binary, vector binary").collect()
    if not made:
        return train([], np.empty(0), np.empty(0), len(metadata_cols))
    return Model(made[0]["bias"], np.frombuffer(made[0]["weight"], np.float32), np.frombuffer(made[0]["vector"], np.float32).reshape(-1, RANK), len(metadata_cols))


def score(model: Model, text: Column, *metadata: Column) -> Column:
    """Score in 0..1 of whole texts; higher means label 1 is likelier. Null and empty texts get a score too."""
    memo: list[Memo] = []

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        if not memo:
            memo.append(Memo(word_features))
        for texts, *meta in batches:
            columns = [m.astype(float).tolist() for m in meta]
            out = []
            for at in range(0, len(texts), 200):
                part = [features(t, [c[at + k] for c in columns], memo[0]) for k, t in enumerate(texts.iloc[at : at + 200])]
                out.append(probability(model, part))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    if metadata:
        def with_metadata(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            yield from run(batches)

        with_metadata.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
        return F.pandas_udf(with_metadata, "double")(text.cast("string"), *[scaled(m) for m in metadata])

    def text_alone(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run((b,) for b in batches)

    text_alone.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(text_alone, "double")(text.cast("string"))
