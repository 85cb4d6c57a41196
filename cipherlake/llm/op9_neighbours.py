"""Embedding near-duplicates by tiled comparison in the order of principal components.

Vectors are scaled to length 1 and rotated into the basis of their principal components, which changes no product.
Equal vectors count once, with their number. Sorted by the leading component, the vectors are cut into tiles; a pair of
tiles whose leading components are too far apart for the threshold is never made. A task compares two tiles: products of
the leading dimensions are accumulated first, the rest is bounded by the product of suffix norms, and only pairs
that can still reach the threshold go on to the next dimensions. Last, the cosine is taken in full double precision.

A tile pair sends back link counts and the links of a local forest, at most one row per vector, so a group of thousands of
near copies never becomes all its pairs. Comparisons are exact: no candidate is given up unless its bound is below the
threshold. The work is quadratic where vectors spread evenly; tiles bound the memory of a task, not the total."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import cut
from cipherlake.llm.components import components

THRESHOLD = 0.95
TILE = 4096
STRIP = 256
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>) of the vectors that can have a cosine."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))


def unit(values: list) -> np.ndarray:
    """A vector scaled to length 1; scaled by its largest number first, so that squares neither overflow nor vanish."""
    x = np.asarray(values, float)
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def basis(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal directions (columns, leading first) of all vectors, padded to `width`. Each task sends the second
    moments of its vectors, width x width numbers."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            for lo in range(0, len(b), 2000):
                x = np.zeros((len(b.iloc[lo : lo + 2000]), width))
                for k, v in enumerate(b["vector"].iloc[lo : lo + 2000]):
                    x[k, : len(v)] = unit(v)
                total += x.T @ x
        yield pd.DataFrame({"row": range(width), "numbers": list(total)})

    found = vectors.select("vector").mapInPandas(moments, "row int, numbers array<double>")
    sums = found.select("row", F.posexplode("numbers").alias("column", "x")).groupBy("row", "column").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((width, width))
    for r in sums:
        total[r["row"], r["column"]] = r["x"]
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (in a, in b) of the pairs with product >= threshold, strip by strip."""
    width = a.shape[1]
    levels = [n for n in (max(4, width // 4), width // 2) if n < width]
    rest_a = [np.sqrt((a[:, n:] ** 2).sum(1)) for n in levels]
    rest_b = [np.sqrt((b[:, n:] ** 2).sum(1)) for n in levels]
    for lo in range(0, len(a), STRIP):
        s = a[lo : lo + STRIP]
        if levels:
            n = levels[0]
            i, j = np.nonzero(s[:, :n] @ b[:, :n].T + rest_a[0][lo : lo + STRIP, None] * rest_b[0] >= threshold - SLACK)
            if len(i) > 0.05 * len(s) * len(b):
                i, j = np.nonzero(s @ b.T >= threshold - SLACK)
            else:
                for n, ra, rb in zip(levels[1:], rest_a[1:], rest_b[1:], strict=True):
                    may = np.einsum("ij,ij->i", s[i, :n], b[j, :n]) + ra[lo + i] * rb[j] >= threshold - SLACK
                    i, j = i[may], j[may]
        else:
            i, j = np.nonzero(s @ b.T >= threshold - SLACK)
        for at in range(0, len(i), 200_000):
            p, q = i[at : at + 200_000], j[at : at + 200_000]
            sure = np.einsum("ij,ij->i", s[p], b[q]) >= threshold
            if sure.any():
                yield lo + p[sure], q[sure]


class Forest:
    """Union of row numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Hang both ends of all links on their common smallest root, until every link is inside one tree."""
        while len(i):
            ri, rj = self.up[i], self.up[j]
            np.minimum.at(self.up, ri, rj)
            np.minimum.at(self.up, rj, ri)
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]
            apart = self.up[i] != self.up[j]
            i, j = i[apart], j[apart]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: id, n_links (other rows with cosine >= threshold), component_id (smallest id reachable by
    links, itself included) and kept (id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing; vectors of different lengths
    don't link either. Rows of equal ids stay rows of their own, each counted as another vector. A row of null id links
    like any other; its component is the smallest id that isn't null, and kept is false. Other columns aren't looked at;
    an empty table gives no rows."""
    good = usable(vectors, id_col, vector_col)
    width = good.agg(F.max(F.size("vector"))).first()[0] or 1
    axes = basis(good, width)

    def rotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                part = b.iloc[lo : lo + 2000]
                x = np.zeros((len(part), width))
                for k, v in enumerate(part["vector"]):
                    x[k, : len(v)] = unit(v)
                keys = [hashlib.blake2b((np.asarray(v, float) + 0.0).tobytes(), digest_size=16).digest() for v in part["vector"]]
                y = x @ axes
                yield pd.DataFrame({"id": part["id"], "node": keys, "size": [len(v) for v in part["vector"]], "lead": y[:, 0], "numbers": [r.tobytes() for r in y]})

    as_text = good.select(F.col("id").cast("string").alias("id"), "vector")
    rows = cut(as_text.mapInPandas(rotate, "id string, node binary, size int, lead double, numbers binary").withColumn("id", F.col("id").cast(vectors.schema[id_col].dataType)))
    nodes = rows.groupBy("node").agg(F.count("*").alias("copies"), F.first("size").alias("size"), F.first("lead").alias("lead"), F.first("numbers").alias("numbers"))
    # equal leading numbers are spread by a hash, so that no tile outgrows the others
    nodes = cut(nodes.withColumn("lead", F.col("lead") + F.xxhash64("node") / F.lit(2.0**63) * 1e-9))
    n_tiles = max(1, -(-nodes.count() // tile))
    cuts = nodes.agg(F.percentile_approx("lead", [k / n_tiles for k in range(1, n_tiles)], 100 * n_tiles)).first()[0] if n_tiles > 1 else []
    cuts = sorted(set(cuts or []))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    lows = [-2.0, *cuts]
    first = [max(0, int(np.searchsorted(lows, lows[k] - reach, side="right")) - 1) for k in range(len(lows))]  # tiles that may reach up into tile k
    last = [int(np.searchsorted(first, k, side="right")) for k in range(len(lows))]  # one past the tiles that tile k may reach up to

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.searchsorted(cuts, b["lead"].to_numpy(), side="right") if cuts else np.zeros(len(b), int)
            for lo in range(0, len(b), 500):
                out = [(low, high, side, *row) for t, row in zip(at[lo : lo + 500], b[["node", "copies", "size", "numbers"]].iloc[lo : lo + 500].itertuples(index=False), strict=True)
                       for low, high, side in [*[(int(t), k, 0) for k in range(t, last[t])], *[(k, int(t), 1) for k in range(first[t], t)]]]
                yield pd.DataFrame(out, columns=["low", "high", "side", "node", "copies", "size", "numbers"])

    dealt = nodes.mapInPandas(place, "low int, high int, side int, node binary, copies long, size int, numbers binary")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        sides = [group[group["side"] == s].reset_index(drop=True) for s in (0, 1)]
        same = key[0] == key[1]
        x = [np.frombuffer(b"".join(s["numbers"]), float).reshape(-1, width) for s in sides]
        names = np.array([*sides[0]["node"], *([] if same else sides[1]["node"])], object)
        copies = np.concatenate([sides[0]["copies"].to_numpy(), [] if same else sides[1]["copies"].to_numpy()])
        lengths = np.concatenate([sides[0]["size"].to_numpy(), [] if same else sides[1]["size"].to_numpy()])
        shift = 0 if same else len(x[0])
        links, forest = np.zeros(len(names)), Forest(len(names))
        for i, j in close_pairs(x[0], x[0] if same else x[1], threshold):
            ok = (lengths[i] == lengths[j + shift]) & ((i != j) if same else True)
            i, j = i[ok], j[ok] + shift
            links += np.bincount(i, copies[j], minlength=len(names))
            if not same:
                links += np.bincount(j, copies[i], minlength=len(names))
            forest.join(i, j)
        hit = np.nonzero(links)[0]
        return pd.DataFrame({"node": names[hit], "links": links[hit].astype(np.int64), "root": names[forest.up[hit]]})

    found = cut(dealt.groupBy("low", "high").applyInPandas(compare, "node binary, links long, root binary"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found, "node", "root")
    whole = rows.groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    whole = whole.join(counts, "node", "left").join(joined, "node", "left").select("node", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    roots = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = whole.join(roots, "root").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    out = rows.select("id", "node").join(linked, "node").select("id", "n_links", "component_id")
    every = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bad = every.where(~F.coalesce(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False)))
    out = out.unionAll(bad.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
