"""Near-duplicate findings: pairs of vectors by banded hyperplane hashes, verified by their cosine.

Random hyperplanes cut the space; a vector's signs in one band of them are its bucket there, and vectors at a small angle
share a bucket in some band with near certainty (at a cosine of 0.95, 24 bands of 12 signs miss fewer than one pair in
two thousand).  Equal vectors are one vector first, so a group of copies of any size is one row.  Buckets are compared in
tiles: one of more than ``tile`` members is dealt into several, and each pair of tiles is compared by itself, so a hot bucket is
neither gathered nor dropped.  Only verified pairs leave a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.session import checkpoint

BANDS, SIGNS, TILE = 24, 12, 2000


def planes(width: int, bands: int, signs: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, bands * signs))


def band_codes(vector: Column, width: int, bands: int = BANDS, signs: int = SIGNS) -> Column:
    """A bucket number for each band."""

    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        side = (np.stack(vectors.to_numpy()).astype(np.float64) @ planes(width, bands, signs) > 0).reshape(len(vectors), bands, signs)
        return pd.Series(list((side * (1 << np.arange(signs))).sum(2).astype(np.int32)))

    return run(vector)


def distinct_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v, copies): each different vector once, under its smallest key.  Null and zero vectors and those with
    missing or non-finite numbers are left out: they are similar to nothing."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).alias("vec_id"), v.alias("v")).where(fine & F.col("vec_id").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))


def near_duplicates(vectors: DataFrame, key: str, vector: str, threshold: float = 0.95, bands: int = BANDS, signs: int = SIGNS, tile: int = TILE) -> DataFrame:
    """(left_id, right_id, similarity): pairs of different vectors with a cosine of at least ``threshold``, each under the
    smallest key that holds it, the smaller one left.  Vectors of other lengths are similar to nothing.  Exact in what
    it returns; a pair is missed only if it shares no bucket in any band."""
    one = checkpoint(distinct_vectors(vectors, key, vector))
    parts = []
    for width in sorted(r["w"] for r in one.select(F.size("v").alias("w")).distinct().collect()):  # one, where vectors have one source
        coded = checkpoint(one.where(F.size("v") == width).select("vec_id", "v", band_codes(F.col("v"), width, bands, signs).alias("codes")))
        member = coded.select("vec_id", F.posexplode("codes").alias("band", "code"))
        sizes = member.groupBy("band", "code").agg(F.count("*").alias("n")).where("n > 1")
        held = member.join(sizes, ["band", "code"]).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
        own = F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int")
        dealt = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.select("band", "code", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "vec_id")
        dealt = dealt.join(coded.select("vec_id", "v"), "vec_id")
        group = ["band", "code", "low", "high"]
        parts.append(dealt.repartition(*group).sortWithinPartitions(*group, "vec_id").mapInPandas(_compare(threshold), f"left_id {_kind(one)}, right_id {_kind(one)}, similarity double"))
    out = vectors.sparkSession.createDataFrame([], f"left_id {_kind(one)}, right_id {_kind(one)}, similarity double")
    for p in parts:
        out = out.unionByName(p)
    return out.groupBy("left_id", "right_id").agg(F.max("similarity").alias("similarity"))


def _kind(one: DataFrame) -> str:
    return one.schema["vec_id"].dataType.simpleString()


def _pairs(ids: np.ndarray, own: np.ndarray, rows: np.ndarray, apart: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a group that reach the threshold; ``apart``: of different tiles only."""
    found = []
    for at in range(0, len(ids), 512):
        near = rows[at : at + 512] @ rows[at:].T
        i, j = np.nonzero(near >= threshold)
        keep = (i < j) & ((not apart) | (own[at + i] != own[at + j]))
        found.append((ids[at + i[keep]], ids[at + j[keep]], np.minimum(near[i[keep], j[keep]], 1.0)))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _compare(threshold: float):
    """Over sorted rows: groups follow each other, and the last group of a batch may go on in the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for last, batch in _with_end(batches):
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            names = rows[["band", "code", "low", "high"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(1)])) if len(rows) else np.empty(0, int)
            ends = np.append(starts[1:], len(rows)) if len(rows) else starts
            if not last and len(starts):
                rest, starts, ends = rows.iloc[starts[-1] :], starts[:-1], ends[:-1]
            if len(starts):
                v = np.stack(rows["v"].to_numpy()[: ends[-1]])
                unit, ids, own = v / np.sqrt((v * v).sum(1))[:, None], rows["vec_id"].to_numpy(), rows["own"].to_numpy()
                found = [_pairs(ids[x:y], own[x:y], unit[x:y], names[x, 2] != names[x, 3], threshold) for x, y in zip(starts, ends, strict=True) if y - x > 1]
                for at in range(0, len(found), 1000):
                    i, j, s = (np.concatenate([f[k] for f in found[at : at + 1000]]) for k in range(3))
                    yield pd.DataFrame({"left_id": i, "right_id": j, "similarity": s})

    return run


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    before = None
    for b in batches:
        if before is not None:
            yield False, before
        before = b
    if before is not None:
        yield True, before
