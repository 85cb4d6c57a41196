import hashlib
import re

import numpy as np
import pytest

from cipherlake.llm import op8_pii
from cipherlake.llm.catalog import QUERIES
from tests.llm.fixtures import documents, edge_docs, edge_rows, no_docs

PATTERNS = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def passes(kind, match):
    digits = "".join(c for c in match if c in "0123456789")
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, p) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if passes(kind, m.group())]
    return [(k, a, b) for a, _, k, b in sorted(found)]


TEXTS = ["mail bob.42@mail8.example.com, now", "a@b.c_d@e.f and x@y@z.com a@b.c@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.003.255 1.2.3 .4.5.6.7", "4111 1111 1111 1111 and 4111111111111112 4-1-1-1", "+1 (988) 555-2485 +49 30 123456 +12 +1((((((((((9",
         "+4111111111111111 and +1 4111 1111 1111 1111", "ñandú 你好 𝒳𝒳 bob@ex.org 𝒳 10.0.0.1", "@@@ . @a.b a@.b a@b. %+-@x.y", "12345678901234567890123 4111111111111111.5", "a" * 30_000 + "@b." + "c." * 9_000, "1" * 60_000 + " " + "1." * 20_000, "+1" + "(" * 30_000,
         "x" * 40_000 + " y@z.de", "7 " * 20_000, "\n10.1.1.1\n10.1.1.1\n", "", None]


def test_base_spans_equal_the_patterns(spark):
    rows = list(enumerate(TEXTS))
    got = {r["doc_id"]: r["found"] for r in op8_pii.find(documents(spark, rows)).collect()}
    for k, text in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in got[k] if s["base"]] == plain(text), (text or "")[:60]


def test_query_equals_the_plain_digest(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_weak_supervision_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in op8_pii.KINDS] == [sum(x[0] == k for x in base) for k in op8_pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))


def test_added_spans(spark):
    plain_rows = [(k, f"please mail user{k}@mail.example.com or call +1 (988) 555-{1000 + k} from host 10.0.{k % 200}.7 soon") for k in range(100)]
    more = [(1000, "please contact jane.doe [at] example [dot] com today"), (1001, "call (988) 555-2485 today"), (1002, "server 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up"), (1003, "they met at the dot of noon and 555 people came"), (1004, "order 988-555-2485"), (1005, "id abc988-555-2485x"),
            (1006, "phone=(988) 555-2485"), (1007, "invoice 988-555-2485 of may"), (1008, "contact: max (at) example (dot) org"), (1009, "release 10[.]20[.]30[.]40 is out")]
    got = {r["doc_id"]: [(s["kind"], s["base"], s["match"]) for s in r["found"]] for r in op8_pii.find(documents(spark, plain_rows + more)).collect()}
    assert got[1000] == [("email", False, "jane.doe [at] example [dot] com")]
    assert got[1001] == [("phone", False, "(988) 555-2485")] and got[1002][0][0] == "ip"
    assert got[1003] == got[1004] == got[1005] == got[1007] == got[1009] == []
    assert got[1006] == [("phone", False, "(988) 555-2485")] and got[1008] == [("email", False, "max (at) example (dot) org")]
    assert all(len(got[k]) == 3 and all(b for _, b, _ in got[k]) for k in range(100))


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.7
    right = [0.95, 0.9, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(4000) < 0.2, 0, np.where(rng.random(4000) < p, 1, -1) * np.where(truth, 1, -1)) for p in right], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, chance = op8_pii.reliabilities(list(zip(map(tuple, patterns), counts, strict=True)))
    assert share == pytest.approx(0.7, abs=0.03)
    assert [chance[k, 1, 2] / (chance[k, 1, 2] + chance[k, 1, 0]) for k in range(5)] == pytest.approx(right, abs=0.04)
    guess = np.array([op8_pii.probability(share, chance, v) > 0.5 for v in votes])
    assert (guess == truth).mean() > 0.95


def test_the_classifier_fits_pattern_probabilities():
    """Weights are at the optimum of the stated loss, and a rare pattern tells in a large corpus as in a small one."""
    size = len(op8_pii.FEATURES)
    rows = [((1,) * size, 0.95, 1000), ((0,) * size, 0.2, 300), ((1,) + (0,) * (size - 1), 0.7, 50), ((1, 1, 1, 1) + (0,) * (size - 4), 0.02, 8)]
    score = lambda w, f: 1 / (1 + np.exp(-(np.dot(w[:-1], f) + w[-1])))
    w = op8_pii.classifier(rows)
    assert [score(w, f) for f, _, _ in rows] == pytest.approx([p for _, p, _ in rows], abs=0.05)
    many = op8_pii.classifier([*rows[:3], (rows[0][0], 0.95, 10_000_000), rows[3]])
    assert score(many, rows[3][0]) < 0.1
    assert not op8_pii.classifier([]).any()


def test_redaction(spark):
    rows = [(1, "to 𝒳 bob@ex.org, 10.0.0.1."), (2, "none"), (3, None), (4, "a +30569309025904 b"), (5, "4111111111111111")]
    got = {r["doc_id"]: r["text_redacted"] for r in op8_pii.redact(documents(spark, rows)).collect()}
    assert got == {1: "to 𝒳 <email>, <ip>.", 2: "none", 3: None, 4: "a <phone> b", 5: "<card>"}


def test_no_python_in_the_plan(spark):
    plan = op8_pii.find(documents(spark, [(1, "a@b.cd")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pii_edges(spark):
    rows = op8_pii.find(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    assert op8_pii.find(no_docs(spark)).collect() == []


def test_repeated_rows_have_the_spans_of_their_text(spark):
    text = "mail bob@ex.org, ann@ex.org or 10.0.0.1, card 4111 1111 1111 1111, call +1 (988) 555-2485"
    rows = [(1, text), (1, text), (1, "bob@ex.org"), (None, text), (None, text), (None, "see 10.0.0.1"), (2, text)]
    docs = documents(spark, rows)
    got = op8_pii.find(docs).collect()
    spans = lambda found: [(s["kind"], s["start"], s["end"]) for s in found if s["base"]]
    assert sorted(map(str, ((r["doc_id"], spans(r["found"])) for r in got))) == sorted(map(str, ((i, plain(t)) for i, t in rows)))
    cut = "mail <email>, <email> or <ip>, card <card>, call <phone>"
    assert sorted(map(str, map(tuple, op8_pii.redact(docs).collect()))) == sorted(map(str, [(1, cut), (1, cut), (1, "<email>"), (None, cut), (None, cut), (None, "see <ip>"), (2, cut)]))
