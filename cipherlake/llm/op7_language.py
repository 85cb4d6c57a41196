"""Language identification as inference of a mixture.

For every language, letter n-grams (one to four characters, word ends included) are counted over all training texts in
hashed buckets; a word's likelihood in a language is the product of those of its n-grams. A document is a mixture:
expectation-maximisation over its words estimates the languages' shares, and languages are dropped one after another
while the likelihood, penalised by the number of languages, doesn't fall. The predicted language has the largest share.

Counting is one pass that sends a bounded number of rows per task (languages x buckets); prediction is one narrow pass
over whole texts. The model is languages x buckets numbers, whatever the size of the corpus."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15
ORDERS = (1, 2, 3, 4)
ROUNDS = 12
PENALTY = 3.0
FLOOR = 12.0
STRENGTH = 1.5


class Model(NamedTuple):
    languages: list[str]
    logp: np.ndarray  # buckets x languages


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def characters(text: str) -> np.ndarray:
    """Code points of a text in lower case, 0 for what isn't a letter, with a 0 at either end."""
    codes = np.frombuffer(f"\n{text.lower()}\n".encode("utf-32-le", "replace"), np.uint32)
    return np.where(_is_letter()[codes], codes, 0)


def grams(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the n-grams of one length start, and their buckets. An n-gram may start or end between words, but not
    reach across."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = codes[:n] > 0 if order == 1 else np.ones(n, bool)
    for k in range(1, order - 1):
        inside &= codes[k : k + n] > 0
    if order == 2:
        inside &= (codes[:n] > 0) | (codes[1:] > 0)
    at = np.flatnonzero(inside)
    h = np.full(len(at), order, np.uint64)
    for k in range(order):
        h = h * np.uint64(0x100000001B3) + codes[at + k].astype(np.uint64)
    return at, (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def pieces(text: str, size: int = 1_000_000) -> Iterator[str]:
    """A text cut at spaces or line feeds, which go. No n-gram reaches across one, and either end of a piece counts as
    one, so the pieces have the n-grams of the whole text. Without a place to cut, a piece grows up to the next."""
    lo = 0
    while len(text) - lo > size:
        at = max(text.rfind(" ", lo, lo + size), text.rfind("\n", lo, lo + size))
        if at < 0:
            at = min((x for x in (text.find(" ", lo + size), text.find("\n", lo + size)) if x >= 0), default=len(text))
        yield text[lo:at]
        lo = at + 1
    yield text[lo:]


def gram_counts(text: str, size: int = 1_000_000) -> np.ndarray:
    """How often the n-grams of a text fall into each bucket, computed for `size` characters at a time."""
    total = np.zeros(1 << BITS, np.int64)
    for piece in pieces(text, size):
        codes = characters(piece)
        for order in ORDERS:
            total += np.bincount(grams(codes, order)[1], minlength=1 << BITS)
    return total


def fit(docs: DataFrame, allowed: Column, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Count n-grams by language over all allowed rows with a language and a text."""
    known = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                total = totals.setdefault(lang, np.zeros(1 << BITS, np.int64))
                total += gram_counts(text)
        for lang, total in totals.items():
            at = np.nonzero(total)[0]
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": total[at]})

    found = known.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique()) if len(found) else []
    counts = np.zeros((1 << BITS, len(languages)))
    if languages:
        counts[found["bucket"], found["lang"].map({g: k for k, g in enumerate(languages)})] = found["n"]
    smoothed = counts + 0.5 * counts.sum(1, keepdims=True) / max(1.0, counts.sum()) * 1000 + 0.01
    return Model(languages, np.log(smoothed / smoothed.sum(0)).astype(np.float32))


def mixtures(likelihood: np.ndarray, count: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float = PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """Shares of the languages in each document (rows), zero for languages not in its set.

    likelihood: words x languages, each row scaled to a largest value of 1; doc: ascending document numbers of the words,
    with at least one word for each document."""
    k = likelihood.shape[1]
    starts = np.searchsorted(doc, np.arange(n_docs))
    words = np.add.reduceat(count, starts)

    def settle(shares: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """EM for the documents of `part`; their shares and log likelihood."""
        inside = np.isin(doc, part) if len(part) < n_docs else np.ones(len(doc), bool)
        like, n, d = likelihood[inside], count[inside], np.searchsorted(part, doc[inside])
        first, pi = np.searchsorted(d, np.arange(len(part))), shares[part]
        for _ in range(rounds):
            r = like * pi[d]
            r *= (n / np.maximum(r.sum(1), 1e-300))[:, None]
            pi = np.add.reduceat(r, first) / words[part][:, None]
        return pi, np.add.reduceat(n * np.log(np.maximum((like * pi[d]).sum(1), 1e-300)), first)

    shares = np.full((n_docs, k), 1 / k)
    every = np.arange(n_docs)
    shares, value = settle(shares, every)
    shares[shares < 1e-4] = 0
    shares /= shares.sum(1, keepdims=True)
    open_docs = every[(shares > 0).sum(1) > 1]
    while len(open_docs):
        trial = shares.copy()
        rows = trial[open_docs]
        least = np.where(rows > 0, rows, 2).argmin(1)
        rows[np.arange(len(rows)), least] = 0
        trial[open_docs] = rows / rows.sum(1, keepdims=True)
        pi, new = settle(trial, open_docs)
        better = new + penalty * np.log1p(words[open_docs]) / 2 >= value[open_docs]
        won = open_docs[better]
        shares[won], value[won] = pi[better], new[better]
        open_docs = won[(shares[won] > 0).sum(1) > 1]
    return shares


class Reader:
    """Likelihoods of words under all languages, kept for a bounded number of distinct words."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit, self.known = model, limit, {}
        self.rows = np.zeros((limit, len(model.languages)))
        self.spelt = np.zeros(limit, bool)  # has a letter

    def likelihoods(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each word, scaled to a largest value of 1, and whether the word has a letter."""
        text = "\n".join(words).lower()
        codes = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "replace"), np.uint32)
        word = np.cumsum(codes == 10) - 1
        codes = np.where(_is_letter()[codes], codes, 0)
        total = np.zeros((len(words) + 1, len(self.model.languages)))
        for order in ORDERS:
            at, found = grams(codes, order)
            owner = word[at]
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(at):
                total[owner[starts]] += np.add.reduceat(self.model.logp[found].astype(float), starts)
        total = total[:-1] * (STRENGTH / len(ORDERS))
        spelt = np.bincount(word[codes > 0], minlength=len(words))[: len(words)] > 0
        return np.exp(np.maximum(total - total.max(1, keepdims=True), -FLOOR)), spelt

    def words(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Likelihood rows and counts of each text's distinct words that have letters."""
        counts = [Counter(t.split()) for t in texts]
        new = list({w for c in counts for w in c if w not in self.known})
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list({w for c in counts for w in c})
            if len(new) > self.limit:  # more words than the table holds
                if len(texts) > 1:
                    return [self.words([t])[0] for t in texts]
                parts = [self.likelihoods(new[k : k + self.limit]) for k in range(0, len(new), self.limit)]
                spelt = np.concatenate([p[1] for p in parts])
                return [(np.concatenate([p[0] for p in parts])[spelt], np.array([counts[0][w] for w in new], float)[spelt])]
        if new:
            at = len(self.known)
            self.rows[at : at + len(new)], self.spelt[at : at + len(new)] = self.likelihoods(new)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        out = []
        for c in counts:
            at = np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))
            n, spelt = np.fromiter(c.values(), float, len(c)), self.spelt[at]
            out.append((self.rows[at[spelt]], n[spelt]))
        return out


RESULT = "lang_pred string, score double, languages array<string>, shares array<double>"


def predict(model: Model, text: Column) -> Column:
    """A struct of the predicted language, its share, and the whole language set with shares, largest first (equal
    shares by name). Texts that are null or have no letter, and all texts where nothing was learned, get `und`, score 0
    and an empty set."""
    ready: list[Reader] = []

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not ready:
            ready.append(Reader(model))
        names = np.array(model.languages, object)
        for texts in batches:
            out = [("und", 0.0, [], [])] * len(texts)
            for lo in range(0, len(texts), 100) if model.languages else ():
                part = [(lo + k, t) for k, t in enumerate(texts.iloc[lo : lo + 100]) if t]
                found = [(k, *x) for (k, _), x in zip(part, ready[0].words([t for _, t in part]), strict=True) if len(x[1])]
                if not found:
                    continue
                sizes = [len(x[2]) for x in found]
                shares = mixtures(np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found]), np.repeat(np.arange(len(found)), sizes), len(found))
                for (k, *_), row in zip(found, shares, strict=True):
                    order = [g for g in np.argsort(-row, kind="stable") if row[g] > 0]
                    out[k] = (names[order[0]], min(1.0, float(row[order[0]])), names[order].tolist(), row[order].tolist())
            yield pd.DataFrame(out, columns=["lang_pred", "score", "languages", "shares"])

    return run(text.cast("string"))
