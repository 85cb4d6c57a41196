"""Counts by language: same matches in less time, and code that the JVM compiles."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.operators import features as FT
from cipherlake.sources import corpus as C

CALLS = r"\w+\s*\("
DECLARED = [(CALLS, FT.CALLS), *FT.SPELLINGS.items()]


@pytest.mark.parametrize("letters", [["a", "b_1", " ", "\n", "(", ")", "{", ";", "é", "́", "\r", "\x0b", " "], ["a", " ", "(", ")", "{"]])
def test_spellings_count_the_same_matches(spark, letters):
    rng = random.Random(7)
    df = spark.createDataFrame([("".join(rng.choices(letters, k=rng.randint(0, 40))),) for _ in range(20_000)], "t string")
    for declared, spelled in DECLARED:
        both = df.select("t", F.regexp_count("t", F.lit(declared)).alias("a"), F.regexp_count("t", F.lit(spelled)).alias("b"))
        assert both.filter("a > 0").count() > 0
        assert both.filter("a != b").collect() == []


def test_structure_counts_of_every_language(spark):
    text = ("func f(a) { var x = 1 }\nfunction g(b) { let y = 2 }\n  def h(c):\n  z = 3\nint main (void) {\nclass K {\npublic int k(d) {\n"
            "interface I\nfn r() { let q = 4 }\ntype T struct\nimpl R\nf(g (h(1)));\nstatic int s(int a, int b)\n{ }\nint t(1); { }\n")
    files = spark.createDataFrame([(f"r/f.{e}", "r", text) for e in V.LANGUAGE_TABLES["features"][0]] + [("r/f.MD", "r", text), ("r/n.go", "r", None), ("r/e.c", "r", "")],
                                  "path string, repo string, content string")
    got = {r["path"]: r.asDict() for r in FT.language_structure(files).collect()}
    assert {p for p in got if got[p]["calls"] is None} == {"r/n.go"} and got["r/n.go"]["functions"] is None and got["r/e.c"]["functions"] == 0
    merged = {"typescript": "javascript", "cpp": "c"}
    groups = {f"r/f.{e}": merged.get(n, n) for e, n in V.LANGUAGE_TABLES["features"][0].items()}
    assert set(got) - {"r/n.go", "r/e.c"} == {p for p, g in groups.items() if g in FT.STRUCTURE}
    for path in set(got) - {"r/n.go", "r/e.c"}:
        assert got[path]["language_group"] == groups[path]
        for what, pattern in FT.STRUCTURE[groups[path]].items():
            assert got[path][what] == len(re.findall(pattern, text)), (path, what)
        assert got[path]["calls"] == len(re.findall(CALLS, text))


def test_structure_method_is_not_too_long_to_compile(spark, sf_dir):
    """The JVM interprets methods of over 8,000 bytes, however often they run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = FT.language_structure(C.code_files(spark, sf_dir))._jdf.queryExecution().executedPlan()
        code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenString(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_a_long_word_is_passed_once(spark):
    """Tried from each of its characters, a word of 400,000 takes minutes."""
    files = spark.createDataFrame([("r/f.c", "r", "a" * 400_000 + " f(x) {")], "path string, repo string, content string")
    start = time.time()
    assert FT.language_structure(files).select("functions", "calls").first() == (1, 1)
    assert FT.complexity(files).first()["halstead_complexity"] == 1.5
    assert time.time() - start < 30
