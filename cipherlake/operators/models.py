"""Pluggable models: a registry of scorers over a feature array.

A model turns ``array<double>`` into a double between 0 and 1.  Two kinds share one registry: column models compile to
expressions (trees, forests, linear models), batch models are any Python object scored in Arrow batches, loaded once per
worker by ``predict_batch_udf``.  Scores are columns like others: nothing is collected, and no model sees more than a batch.

```python
models = Registry()
models.add("tree", column_model("decision_tree", ["confidence", "severity"], lambda x: tree_score(TREE, x, 2)))
models.add("net", batch_model("network", ["confidence", "severity"], load_network))   # load_network() -> f(matrix) -> vector
scored = models.score(findings, ["net", "tree"])      # score_net, score_tree and, by their order, score
```"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cipherlake.operators.embedded import with_fallback

DEFAULT = 0.5  # where a model can't tell


@dataclass(frozen=True)
class Model:
    """A scorer, the features it reads in their order, and what it is."""

    kind: str
    features: tuple[str, ...]
    apply: Callable[[Column], Column]
    version: str = "1.0"


def column_model(kind: str, features: list[str], build: Callable[[Column], Column], version: str = "1.0") -> Model:
    """A model that is an expression over the feature array."""
    return Model(kind, tuple(features), build, version)


def batch_model(kind: str, features: list[str], load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 8192, version: str = "1.0") -> Model:
    """A model that scores a float64 matrix (rows, features); ``load`` runs once per Python worker."""
    width = len(features)

    def make() -> Callable[[np.ndarray], np.ndarray]:
        predict = load()
        return lambda rows: np.asarray(predict(rows.astype(np.float64)), np.float64).reshape(len(rows))

    udf = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[width]])
    return Model(kind, tuple(features), lambda x: udf(x), version)


class Registry:
    """Models by name, in the order in which they were added."""

    def __init__(self) -> None:
        self._models: dict[str, Model] = {}

    def add(self, name: str, model: Model) -> Registry:
        if name in self._models:
            raise ValueError(f"a model named {name} is there already")
        self._models[name] = model
        return self

    def describe(self) -> list[dict]:
        return [{"name": n, "kind": m.kind, "version": m.version, "features": list(m.features)} for n, m in self._models.items()]

    def predict(self, name: str, features: Column) -> Column:
        """Score of a feature array.  A null array, one of another length and one with a missing or non-finite number
        score ``DEFAULT``, and so does a model's own missing result; batch models never see such rows as they are."""
        model = self._models[name]
        n = len(model.features)
        fit = F.coalesce((F.size(features) == n) & F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
        clean = F.when(fit, features).otherwise(F.array_repeat(F.lit(0.0), n))
        found = model.apply(clean)
        return F.when(fit & found.isNotNull() & ~F.isnan(found), found).otherwise(F.lit(DEFAULT))

    def score(self, df: DataFrame, names: list[str] | None = None, prefix: str = "score") -> DataFrame:
        """Add ``<prefix>_<name>`` for each model, from the columns that the model names as its features, and ``<prefix>``:
        the first of them strictly between 0 and 1, else ``DEFAULT``.  Batch models share one pass over the rows."""
        names = list(self._models) if names is None else names
        columns = {f"{prefix}_{n}": self.predict(n, F.array(*[F.col(c).cast("double") for c in self._models[n].features])) for n in names}
        out = df.withColumns(columns)
        return out.withColumn(prefix, with_fallback(*[F.col(c) for c in columns]))
