"""Scores of learned models from given weights, and the models that Spark itself can fit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from truthframe.functions.fuzzy import sigmoid
from truthframe.session import ship


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def biased_mf(pairs: DataFrame, users: DataFrame, items: DataFrame, global_bias: float = 0.0) -> DataFrame:
    """``score`` of (uid, iid): product of the factors plus the biases; ``users`` is (uid, factors, bias), ``items`` (iid, factors, bias). Unknown ones count as 0."""
    u = users.select("uid", F.col("factors").alias("uf"), F.col("bias").alias("ub"))
    i = items.select("iid", F.col("factors").alias("vf"), F.col("bias").alias("vb"))
    both = pairs.join(u, "uid", "left").join(i, "iid", "left")
    zero = F.lit(0.0)
    score = F.coalesce(_dot(F.col("uf"), F.col("vf")), zero) + F.coalesce("ub", zero) + F.coalesce("vb", zero) + F.lit(global_bias)
    return both.withColumn("score", score).drop("uf", "ub", "vf", "vb")


def svdpp(pairs: DataFrame, users: DataFrame, items: DataFrame, history: DataFrame, implicit: DataFrame, global_bias: float = 0.0) -> DataFrame:
    """Biased factors with a user's vector moved by the mean of the implicit vectors of its history.

    ``history`` is (uid, iid), ``implicit`` (iid, vector). Means are taken by position in the vector, aggregated on the map side.
    """
    e = history.join(implicit, "iid").select("uid", F.posexplode("vector").alias("k", "v")).groupBy("uid", "k").agg(F.avg("v").alias("v"))
    mean = e.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("moved"))  # one vector's places
    moved = users.join(mean, "uid", "left").withColumn("factors", F.coalesce(F.zip_with("factors", "moved", lambda a, b: a + b), "factors")).drop("moved")
    return biased_mf(pairs, moved, items, global_bias)


class LogicNet:
    """Neural logic of DNF sentences: vectors for variables, small networks for and, or, not; the score is the likeness to TRUE.

    ``weights`` has for each of ``and``, ``or``, ``not`` a list of (matrix, bias), with ReLU between layers.
    """

    def __init__(self, variables: np.ndarray, true: np.ndarray, weights: dict[str, list[tuple[np.ndarray, np.ndarray]]], sharpness: float = 10.0):
        self.variables, self.true, self.weights, self.sharpness = variables, true, weights, sharpness

    def _net(self, name: str, x: np.ndarray) -> np.ndarray:
        layers = self.weights[name]
        for i, (w, b) in enumerate(layers):
            x = x @ w + b
            if i < len(layers) - 1:
                x = np.maximum(x, 0.0)
        return x

    def _fold(self, name: str, parts: list[np.ndarray]) -> np.ndarray:
        out = parts[0]
        for p in parts[1:]:
            out = self._net(name, np.concatenate([out, p], axis=-1))
        return out

    def scores(self, sentences: Sequence[Sequence[Sequence[int]]]) -> np.ndarray:
        """Of all sentences, those of one shape together: a product of matrices for each step."""
        out = np.zeros(len(sentences))
        shapes: dict[tuple, list[int]] = {}
        for i, dnf in enumerate(sentences):
            shapes.setdefault(tuple(map(len, dnf)), []).append(i)
        for shape, at in shapes.items():
            groups = []
            for g, size in enumerate(shape):
                ids = np.array([list(sentences[i][g]) for i in at]).reshape(len(at), size)
                values = self.variables[np.abs(ids)]
                values = np.where((ids > 0)[..., None], values, self._net("not", values))
                groups.append(self._fold("and", [values[:, k] for k in range(size)]))
            vectors = self._fold("or", groups)
            out[at] = self._likeness(vectors, np.broadcast_to(self.true, vectors.shape))
        return out

    def score(self, dnf: Sequence[Sequence[int]]) -> float:
        return float(self.scores([dnf])[0])

    def regularisers(self, vectors: np.ndarray) -> dict[str, float]:
        """How far the networks are from the laws of logic, each summed over the vectors: 0 where a law holds. ``length`` is the sum of the vectors' lengths."""
        true = np.broadcast_to(self.true, vectors.shape)
        no = lambda x: self._net("not", x)
        two = lambda name, x, y: self._net(name, np.concatenate([x, y], axis=-1))
        false, inverse = no(true), no(vectors)
        like = lambda x, y: self._likeness(x, y).sum()
        unlike = lambda x, y: (1 - self._likeness(x, y)).sum()
        return {
            "length": float(np.linalg.norm(vectors, axis=-1).sum()),
            "not_true": float(self._likeness(false[:1], true[:1]).sum()),
            "not_self": float(like(inverse, vectors)),
            "not_not_self": float(unlike(no(inverse), vectors)),
            "and_true": float(unlike(two("and", vectors, true), vectors)),
            "and_false": float(unlike(two("and", vectors, false), false)),
            "and_self": float(unlike(two("and", vectors, vectors), vectors)),
            "and_not_self": float(unlike(two("and", vectors, inverse), false)),
            "or_true": float(unlike(two("or", vectors, true), true)),
            "or_false": float(unlike(two("or", vectors, false), vectors)),
            "or_self": float(unlike(two("or", vectors, vectors), vectors)),
            "or_not_self": float(unlike(two("or", vectors, inverse), true)),
        }

    def _likeness(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(x, axis=-1) * np.linalg.norm(y, axis=-1)
        cosine = np.divide((x * y).sum(axis=-1), norms, out=np.zeros_like(norms), where=norms > 0)
        return 1 / (1 + np.exp(-self.sharpness * cosine))

    def column(self, dnf: Column) -> Column:
        net = self

        @F.pandas_udf(DoubleType())
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                known = s[s.notna()]
                yield pd.Series(net.scores(known.tolist()), known.index, dtype="Float64").reindex(s.index)

        ship()
        return run(dnf)


class Recurrent:
    """A gated recurrent unit over item vectors; the score of an item is its product with the last state."""

    def __init__(self, items: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray):
        self.items, self.w, self.u, self.b = items, w, u, b

    def states(self, histories: Sequence[Sequence[int]]) -> np.ndarray:
        """The last state of each history, all of them a step at a time; a history that has ended keeps its state."""
        n = self.u.shape[0]
        sizes = np.array([len(h) for h in histories], np.int64)
        h = np.zeros((len(sizes), n))
        squash = lambda x: 1 / (1 + np.exp(-x))
        for step in range(sizes.max(initial=0)):
            on = np.nonzero(sizes > step)[0]
            x = self.items[[histories[i][step] for i in on]] @ self.w + self.b
            now = h[on]
            z = squash(x[:, :n] + now @ self.u[:, :n])
            r = squash(x[:, n : 2 * n] + now @ self.u[:, n : 2 * n])
            h[on] = (1 - z) * now + z * np.tanh(x[:, 2 * n :] + (r * now) @ self.u[:, 2 * n :])
        return h

    def column(self, history: Column, item: Column) -> Column:
        net = self

        @F.pandas_udf(DoubleType())
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for hs, items in batches:
                yield pd.Series((net.states(hs.tolist()) * net.items[items.to_numpy()]).sum(axis=1), dtype="float64")

        ship()
        return run(history, item)


def attention_score(history: Column, weights: Column, item: Column) -> Column:
    """Likeness of an item's vector to the weighted mean of a history's vectors, through a sigmoid."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    scaled = F.zip_with(history, weights, lambda v, w: F.transform(v, lambda x: x * w / total))
    mean = F.aggregate(scaled, F.transform(item, lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return sigmoid(_dot(mean, item))


def fit_classifier(df: DataFrame, features: str, label: str, kind: str = "forest", **params):
    """A random forest or linear support vector machine of Spark's library over an array column."""
    from pyspark.ml.classification import LinearSVC, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    model = RandomForestClassifier if kind == "forest" else LinearSVC
    rows = df.withColumn("features__", array_to_vector(features))
    return model(featuresCol="features__", labelCol=label, **params).fit(rows)


def fit_word_vectors(sentences: DataFrame, words: str, size: int = 32, seed: int = 1, **params):
    """Word vectors of Spark's library over an array column of words."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(inputCol=words, outputCol="vector", vectorSize=size, seed=seed, **params).fit(sentences)
