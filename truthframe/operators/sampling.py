"""Splits and samples by hash order: the same rows always fall the same way, whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_order(key: Column, seed: int = 42) -> Column:
    """A pseudo-random order that other engines can reproduce."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def ranked(df: DataFrame, key: str, strata: Sequence[str], seed: int = 42) -> DataFrame:
    """``rank__`` from 1 of each row in its stratum, in md5 order of the key, and ``total__``, the stratum's rows.

    Counted in two steps, within groups of a stratum by the first digits of the hash and over the groups' sizes, so that a
    stratum of very many rows isn't sorted by one task.
    """
    df = df.withColumns({"order__": md5_order(F.col(key), seed)}).withColumn("group__", F.substring("order__", 1, 3))
    groups = df.groupBy(*strata, "group__").agg(F.count("*").alias("size__"))  # at most 4096 rows a stratum
    w = Window.partitionBy(*strata)
    groups = groups.withColumns({"before__": F.coalesce(F.sum("size__").over(w.orderBy("group__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total__": F.sum("size__").over(w)}).drop("size__")
    own = F.row_number().over(Window.partitionBy(*strata, "group__").orderBy("order__", key))
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*strata, "group__")]
    out = df.withColumn("own__", own).alias("a").join(groups.alias("b"), cond).select("a.*", "b.before__", "b.total__")
    return out.withColumn("rank__", F.col("before__") + F.col("own__")).drop("order__", "group__", "own__", "before__")


def stratified_split(df: DataFrame, key: str, strata: Sequence[str], shares: Sequence[tuple[str, float]], seed: int = 42) -> DataFrame:
    """``split`` by shares within each stratum: the first ``floor(n * share)`` rows in md5 order to the first split and so on; the last takes the rest.

    No stratum is sorted by one task (``ranked``).
    """
    out = ranked(df, key, strata, seed)
    rank, edge, split = F.col("rank__"), F.lit(0), None
    for name, share in shares[:-1]:
        edge = edge + F.floor(F.col("total__") * share + 1e-9)
        split = F.when(rank <= edge, name) if split is None else split.when(rank <= edge, name)
    split = F.lit(shares[-1][0]) if split is None else split.otherwise(shares[-1][0])
    return out.withColumn("split", split).drop("rank__", "total__")


def random_split(df: DataFrame, key: str, validation: float, test: float, seed: int = 42) -> DataFrame:
    """Test and validation get exactly ``int(n * share)`` rows, training the rest."""
    return stratified_split(df.withColumn("all__", F.lit(1)), key, ["all__"], [("test", test), ("validation", validation), ("train", 1 - validation - test)], seed).drop("all__")


def balanced_batches(df: DataFrame, key: str, label: str, batch_size: int, seed: int = 42) -> DataFrame:
    """``batch`` for each row such that batches take the classes in turn: the n-th row of a class goes to batch n * classes / size."""
    classes = df.select(label).distinct().count()
    per = max(1, batch_size // max(1, classes))
    return ranked(df, key, [label], seed).withColumn("batch", F.floor((F.col("rank__") - 1) / per).cast("int")).drop("rank__", "total__")


def balanced_sample(df: DataFrame, key: str, label: str, per_class: int, seed: int = 42) -> DataFrame:
    """At most ``per_class`` rows of each class, the first in md5 order."""
    return ranked(df, key, [label], seed).filter(F.col("rank__") <= per_class).drop("rank__", "total__")


def candidate_labels(df: DataFrame, labels: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """``candidates``: k labels for each row, its own among them, in hash order. ``labels`` is the (small) table of all labels."""
    every = labels.select(label).distinct().agg(F.array_sort(F.collect_set(label)).alias("all__"))
    order = lambda c: F.transform(c, lambda x: F.struct(md5_order(F.concat_ws(":", F.col(key).cast("string"), x.cast("string")), seed).alias("o"), x.alias("x")))
    others = F.filter("all__", lambda x: x != F.col(label))
    picked = F.transform(F.slice(F.array_sort(order(others)), 1, k - 1), lambda s: s["x"])
    shuffled = F.transform(F.array_sort(order(F.concat(picked, F.array(label)))), lambda s: s["x"])
    return df.crossJoin(F.broadcast(every)).withColumn("candidates", shuffled).drop("all__")


def link_split(edges: DataFrame, nodes: DataFrame, validation: float, test: float, seed: int = 42) -> DataFrame:
    """Edges split for link prediction, each with a negative edge ``(src, neg)`` that doesn't occur."""
    from truthframe.operators.interactions import negatives

    out = random_split(edges.withColumn("edge__", F.concat_ws("-", "src", "dst")), "edge__", validation, test, seed).drop("edge__")
    free = negatives(edges.select("src"), nodes.toDF("dst"), edges, 1, seed, "src", "dst").withColumnRenamed("dst", "neg")
    return out.join(free, "src", "left")
