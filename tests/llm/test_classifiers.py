import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherlake.llm import op2_quality, op7_language, op10_toxicity
from cipherlake.llm.catalog import QUERIES
from cipherlake.llm.common import Memo, fold
from tests.llm.fixtures import edge_docs, no_docs, prose

SF = "/root/testdata/sf0.1"


def held_out(spark, rows, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = rows.join(labels, "doc_id").where("held_out").select("score", "predicted", label).toPandas()
    order = got["score"].rank()
    ones = got[label] == 1
    auc = (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    return auc, (got["predicted"] == got[label]).mean(), got["predicted"][ones].mean()


def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op2_quality_classifier"](spark, SF).cache()
    auc, right, _ = held_out(spark, rows, "quality")
    assert auc > 0.97 and right > 0.97
    assert rows.where("score is null or score < 0 or score > 1 or predicted != cast(score >= 0.5 as int)").count() == 0
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_toxicity_on_held_out_rows(spark):
    rows = QUERIES["op10_toxicity_classifier"](spark, SF).cache()
    auc, right, found = held_out(spark, rows, "toxic")
    assert auc > 0.95 and right > 0.97 and found > 0.85
    assert rows.where("score is null or score < 0 or score > 1 or predicted != cast(score >= 0.3 as int)").count() == 0


def test_language_on_held_out_rows(spark):
    rows = QUERIES["op7_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    got = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.99


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    size = op2_quality._FIRST_STATISTIC + op2_quality.STATISTICS * op2_quality.INTERVALS
    model = op2_quality.Model(0.3, rng.normal(size=size), rng.normal(0, 0.3, (size, op2_quality.RANK)), 0)
    ids, x = np.array([5, 9, 11, 40]), np.array([0.5, 1.0, 0.2, 0.7])
    z = 0.3 + sum(model.weight[i] * v for i, v in zip(ids, x, strict=True))
    z += sum(model.vector[ids[a]] @ model.vector[ids[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert op2_quality.probability(model, [(ids, x)])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_scores_dont_depend_on_batches_or_other_columns(spark):
    model = op2_quality.train([op2_quality.features(prose(k, 50) + "!!" * (k % 2), [], Memo(op2_quality.word_features)) for k in range(60)], np.arange(60) % 2 * 1.0, np.ones(60))
    docs = edge_docs(spark)
    one = [r[0] for r in docs.select(op2_quality.score(model, F.col("text"))).collect()]
    two = [r[0] for r in docs.select("text").repartition(1).select(op2_quality.score(model, F.col("text"))).collect()]
    assert len(one) == docs.count() and all(0 <= s <= 1 for s in one) and sorted(one) == pytest.approx(sorted(two))


def test_a_long_texts_convolution_equals_the_plain_one():
    rng = np.random.default_rng(2)
    shape = lambda *s: rng.normal(size=s)
    filters = [shape(w, op10_toxicity.DIMENSIONS, op10_toxicity.FILTERS) for w in op10_toxicity.WIDTHS]
    n = op10_toxicity.FILTERS * len(filters)
    table = shape(1 << op10_toxicity.WORD_BITS, op10_toxicity.DIMENSIONS)
    table[0] = 0
    model = op10_toxicity.Model(table, filters, shape(n), shape(n + 1), 1.0, 0.0, {None: 0.3})
    for text in (prose(3, 45_000), "one", "", None, "two words"):
        words = (text or "").split()
        units = np.array([op10_toxicity.units(w) for w in words], np.int64).reshape(-1, 3)
        x = np.concatenate([table[units].sum(1), np.zeros((2, op10_toxicity.DIMENSIONS))])
        best = op10_toxicity._pooled(x, filters)[0] if words else np.zeros(n)
        z = np.maximum(best + model.bias, 0) @ model.out[:-1] + model.out[-1]
        if words:
            assert op10_toxicity.Scorer(model, limit=5000 if len(words) < 50 else 40_000)(text) == pytest.approx(z, rel=1e-3, abs=1e-3)


def test_classifier_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 0, 0), (6, 1, 1), (6, None, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    allowed = ~fold(F.col("doc_id"), 3, 1)
    for some in (labels, labels.limit(0)):
        quality = op2_quality.fit(docs, some, allowed, metadata_cols=("n_chars", "score"))
        toxic = op10_toxicity.fit(docs, some, allowed, lang_col="lang")
        for d in (docs, no_docs(spark)):
            rows = d.select(op2_quality.score(quality, F.col("text"), F.col("n_chars"), F.col("score")).alias("a"), op10_toxicity.score(toxic, F.col("text")).alias("b")).collect()
            assert len(rows) == d.count() and all(0 <= r["a"] <= 1 and 0 <= r["b"] <= 1 for r in rows)


def test_mixtures_find_planted_shares():
    rng = np.random.default_rng(4)
    like = np.array([[1, 1e-4, 1e-4], [1e-4, 1, 1e-4], [0.5, 1, 0.4]])
    words = np.concatenate([np.repeat([0, 1], [70, 30]), rng.permutation(np.repeat([0, 2], [90, 10])), [1]])
    doc = np.repeat([0, 1, 2], [100, 100, 1])
    shares = op7_language.mixtures(like[words], np.ones(len(words)), doc, 3)
    assert shares[0] == pytest.approx([0.7, 0.3, 0], abs=0.02)
    assert shares[1] == pytest.approx([1, 0, 0]) and shares[2] == pytest.approx([0, 1, 0])
    assert shares.sum(1) == pytest.approx(np.ones(3))


def test_language_of_mixed_and_odd_texts(spark):
    rows = [(k, prose(k, 80), "xx") for k in range(20)] + [(100 + k, " ".join(f"zqw{c}yj" for c in "abcdefgh"), "yy") for k in range(20)]
    rows += [(500, None, "xx"), (501, "some", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op7_language.fit(docs, F.lit(True))
    assert model.languages == ["xx", "yy"]
    texts = [prose(77, 60), "ZQWAYJ zqwbyj", prose(78, 60) + " " + " ".join(f"zqw{c}yj" for c in "abcdefgh" * 8), None, "", "123 !! 4", "İzqwayj\nzqwbyj " + "z" * 200_000]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").orderBy("k").select(op7_language.predict(model, F.col("text"))).collect()]
    assert [g["lang_pred"] for g in got] == ["xx", "yy", got[2]["lang_pred"], "und", "und", "und", "yy"]
    assert sorted(got[2]["languages"]) == ["xx", "yy"] and sum(got[2]["shares"]) == pytest.approx(1)
    assert all(0 <= g["score"] <= 1 for g in got)
    small = op7_language.Reader(model, limit=3)
    big = op7_language.Reader(model)
    for (a, n), (b, m) in zip(small.words(texts[:3]), big.words(texts[:3]), strict=True):
        assert np.allclose(np.sort((a * n[:, None]).sum(0)), np.sort((b * m[:, None]).sum(0)))


def test_language_edges(spark):
    for docs in (edge_docs(spark), no_docs(spark)):
        model = op7_language.fit(docs, ~fold(F.col("doc_id"), 5, 0))
        rows = docs.select(op7_language.predict(model, F.col("text")).alias("p")).select("p.*").collect()
        assert len(rows) == docs.count() and all(r["lang_pred"] in (*model.languages, "und") for r in rows)


def plain_gram_counts(text):
    """N-grams of whole texts, one after another: a gram has a letter at either end or borders on a word, and letters inside."""
    codes = [ord(c) if c.isalpha() else 0 for c in f"\n{text.lower()}\n"]
    total = {}
    for order in op7_language.ORDERS:
        for k in range(len(codes) - order + 1):
            gram = codes[k : k + order]
            if all(gram[1:-1]) if order > 2 else any(gram):
                h = order
                for c in gram:
                    h = (h * 0x100000001B3 + c) % 2**64
                bucket = (h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - op7_language.BITS)
                total[bucket] = total.get(bucket, 0) + 1
    return total


@pytest.mark.parametrize("size", [1, 2, 7, 30, 1_000_000])
def test_long_training_texts_lose_no_grams(size):
    """Texts cut for training have the n-grams of the whole text, wherever the cuts fall."""
    texts = ["", " ", "a", "one two  three\nfour, five", "ΟΔΟΣ ΣΟΦΟΣ. Σ", "x" * 50, "x" * 50 + " yz " + "w" * 40, "\n\n  \n", "İstanbul straße\tÉté 12a b3"]
    for text in texts + [" ".join(texts * 3)]:
        got = op7_language.gram_counts(text, size)
        assert {int(k): int(got[k]) for k in np.nonzero(got)[0]} == plain_gram_counts(text), (text, size)


def plain_mixture(like, count, penalty, rounds):
    """Shares of one document by plain loops: EM over all languages, then one language after another goes."""
    k, words = len(like[0]), sum(count)

    def settle(pi):
        for _ in range(rounds):
            new = [0.0] * k
            for row, n in zip(like, count, strict=True):
                whole = sum(p * x for p, x in zip(pi, row, strict=True))
                for j in range(k):
                    new[j] += n * pi[j] * row[j] / whole
            pi = [x / words for x in new]
        return pi, sum(n * np.log(sum(p * x for p, x in zip(pi, row, strict=True))) for row, n in zip(like, count, strict=True))

    pi, value = settle([1 / k] * k)
    pi = [0.0 if p < 1e-4 else p for p in pi]
    pi = [p / sum(pi) for p in pi]
    while sum(p > 0 for p in pi) > 1:
        least = min((j for j in range(k) if pi[j] > 0), key=lambda j: pi[j])
        trial = [0.0 if j == least else p for j, p in enumerate(pi)]
        trial, new = settle([p / sum(trial) for p in trial])
        if new + penalty * np.log1p(words) / 2 < value:
            break
        pi, value = trial, new
    return pi


def test_mixtures_equal_a_plain_version():
    rng = np.random.default_rng(5)
    like, count, doc = [], [], []
    for d in range(60):
        own = rng.choice(4, size=rng.integers(1, 4), replace=False)
        for _ in range(int(rng.integers(1, 25))):
            row = rng.uniform(1e-4, 0.3, 4)
            row[rng.choice(own)] = 1.0
            like.append(row)
            count.append(float(rng.integers(1, 6)))
            doc.append(d)
    like, count, doc = np.array(like), np.array(count), np.array(doc)
    got = op7_language.mixtures(like, count, doc, 60)
    sets = set()
    for d in range(60):
        want = plain_mixture(like[doc == d].tolist(), count[doc == d].tolist(), op7_language.PENALTY, op7_language.ROUNDS)
        assert np.allclose(got[d], want, atol=1e-9), d
        sets.add(sum(p > 0 for p in want))
    assert len(sets) > 1
