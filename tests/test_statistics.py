"""Medians, label tables, splits and model registry against plain versions."""

import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherlake.operators import embedded as EM
from cipherlake.operators import encoding as EC
from cipherlake.operators import models as MD
from cipherlake.operators import splitting as SP
from cipherlake.operators.ordering import exact_medians


def median_rows():
    r = random.Random(3)
    groups = {"one": [0.5], "two": [1.0, 2.0], "same": [7.25] * 1000, None: [3.0, 1.0, 2.0], "skewed": [10.0 ** r.uniform(-30, 30) for _ in range(801)],
              "signed": [r.uniform(-1, 1) for _ in range(900)], "pairs": [float(k // 2) for k in range(500)], "ends": [0.0] * 50 + [1.0] * 50, "far": [0.0, 1e-300, 1e300, 5e299]}
    return [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("empty", None)], {g: statistics.median(vs) for g, vs in groups.items()}


@pytest.mark.parametrize(("ranges", "limit"), [(4096, 50_000), (8, 3), (64, 1)])
def test_medians_equal_a_sort(spark, ranges, limit):
    """Whatever the number of ranges and rounds, also for values that spread over sixty orders of magnitude."""
    rows, want = median_rows()
    counted = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {r["g"]: r["median"] for r in exact_medians(counted, "g", "v", ranges=ranges, limit=limit).collect()}
    assert set(got) == set(want) and all(math.isclose(got[g], want[g], rel_tol=1e-12) for g in want)
    assert exact_medians(counted.limit(0), "g", "v").collect() == []


def test_median_of_a_million_values(spark):
    df = spark.range(1_000_001).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 1_000_003 / 1e6).alias("v"), F.lit(1).alias("n"))
    want = statistics.median(k * 7919 % 1_000_003 / 1e6 for k in range(1_000_001))
    assert exact_medians(df, "g", "v").first()["median"] == want


def test_label_tables(spark):
    rows = [("b", "x", 1), ("a", None, 2), ("b", "y", 3), (None, "x", 4), ("unknown", "z", 5)]
    df = spark.createDataFrame(rows, "p string, q string, id int")
    labels = EC.fit_labels(df, ["p", "q"])
    got = {(r["column"], r["label"]): (r["code"], r["n"]) for r in labels.collect()}
    assert got == {("p", "a"): (0, 1), ("p", "b"): (1, 2), ("p", "unknown"): (2, 2), ("q", "unknown"): (0, 1), ("q", "x"): (1, 2), ("q", "y"): (2, 1), ("q", "z"): (3, 1)}
    more = df.unionByName(spark.createDataFrame([("new", "y", 6)], df.schema))
    for rows_to_broadcast in (100, -1):
        out = EC.encode_labels(more, labels, ["p", "q"], broadcast_rows=rows_to_broadcast)
        assert sorted((r["id"], r["p_code"], r["q_code"]) for r in out.collect()) == [(1, 1, 1), (2, 0, 0), (3, 1, 2), (4, 2, 1), (5, 2, 3), (6, 0, 2)]
    back = EC.decode_labels(out, labels, "p", "p_code", "label")
    assert {r["id"]: r["label"] for r in back.collect()} == {1: "b", 2: "a", 3: "b", 4: "unknown", 5: "unknown", 6: "a"}
    assert EC.fit_labels(df.limit(0), ["p"]).collect() == []


def test_labels_are_not_gathered(spark):
    """A hundred thousand labels keep their order without a window over all of them or a list on the driver."""
    df = spark.range(100_000).select(F.format_string("rule-%06d", F.col("id") * 7919 % 100_000).alias("r"))
    got = EC.fit_labels(df, ["r"]).agg(F.min("code"), F.max("code"), F.count_if(F.col("label") != F.format_string("rule-%06d", "code"))).first()
    assert tuple(got) == (0, 99_999, 0)


def test_split_shares_are_exact(spark):
    sizes = {"hot": 7001, "b": 13, "c": 1, "d": 2, "e": 3, None: 20}
    rows = [(f"{g}-{k}", g) for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "id string, label string")
    out = SP.stratified(df, "label", "id").collect()
    for g, n in sizes.items():
        order = sorted((hashlib.md5(f"{i}:42".encode()).hexdigest(), i) for i, x in rows if x == g)
        assert {r["id"] for r in out if r["label"] == g and r["is_test"]} == {i for _, i in order[: math.floor(n * 0.2 + 0.5)]}
    assert len(out) == len(rows)
    again = SP.stratified(df.repartition(17), "label", "id").collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert SP.stratified(df, "label", "id", share=0.0).where("is_test").count() == 0 and SP.stratified(df, "label", "id", share=1.0).where("is_test").count() == len(rows)
    assert SP.stratified(df.limit(0), "label", "id").collect() == []


def test_registry_scores_any_rows(spark):
    names = ["a", "b"]
    models = (MD.Registry().add("sum", MD.batch_model("custom", names, lambda: lambda x: x.sum(1) / 10, batch_size=3)).add("nan", MD.batch_model("broken", names, lambda: lambda x: np.full(len(x), np.nan)))
              .add("tree", MD.column_model("decision_tree", names, lambda x: EM.tree_score({"feature": 1, "threshold": 1.0, "left": {"value": 0.2}, "right": {"value": 0.9}}, x, 2))))
    rows = [(1, 1.0, 2.0), (2, None, 2.0), (3, float("nan"), 1.0), (4, float("inf"), 1.0), (5, 0.0, 0.5), (6, 4.0, 6.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    out = {r["id"]: (r["score_sum"], r["score_nan"], r["score_tree"], r["score"]) for r in models.score(df).collect()}
    assert out == {1: (0.3, 0.5, 0.9, 0.3), 2: (0.5, 0.5, 0.5, 0.5), 3: (0.5, 0.5, 0.5, 0.5), 4: (0.5, 0.5, 0.5, 0.5), 5: (0.05, 0.5, 0.2, 0.05), 6: (1.0, 0.5, 0.9, 0.5)}
    arrays = spark.sql("select * from values (1, array(1D, 2D)), (2, array(1D)), (3, null), (4, array(1D, null)) as t(id, x)")
    assert [r[0] for r in arrays.orderBy("id").select(models.predict("sum", F.col("x"))).collect()] == [0.3, 0.5, 0.5, 0.5]
    assert models.score(df.limit(0)).collect() == [] and [m["kind"] for m in models.describe()] == ["custom", "broken", "decision_tree"]
    with pytest.raises(ValueError):
        models.add("sum", MD.column_model("x", names, lambda x: x[0]))
