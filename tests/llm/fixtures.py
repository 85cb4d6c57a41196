"""Small inputs shared by the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, node string, ref long, entries string"


def prose(seed, words, vocabulary=4000):
    r = random.Random(seed)
    made = ["".join(r.choice(["ka", "lo", "mi", "ten", "ru", "sa", "vo", "pel", "dri", "un"]) for _ in range(r.randint(1, 4))) for _ in range(vocabulary)]
    return " ".join(made[min(vocabulary - 1, int(r.paretovariate(0.5)))] for _ in range(words))


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, rows repeated in part and as a whole."""
    long_text = prose(1, 120_000) + "\n" + "x" * 300_000 + " " + "1" * 50_000 + " " * 3000
    row = lambda i, t: (i, t, None, None, None, None, None, None, None, None)
    return [row(1, "alpha beta gamma delta epsilon zeta"), row(1, "alpha beta gamma delta epsilon zeta"), row(1, "other text under the same id, quite different"), row(None, "a text without an id"),
            row(None, None), row(2, None), row(3, ""), row(4, " \n\t\n "), row(5, long_text), row(6, "ümläut ñandú 你好 ﬀ 𝒳"), row(7, "<|endoftext|> and more"), row(8, "a"),
            (9, "tagged", "en", "s", 6, 0.5, "k", "n", 1, "e")]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
