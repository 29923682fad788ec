"""Fuzzy formulas over typed variables: one id column for each free variable, and a truth ``value``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truthframe.functions import fuzzy
from truthframe.session import materialize


class Fuzzy:
    """A formula's values for each combination of its free variables' individuals."""

    def __init__(self, df: DataFrame, free: Sequence[str], locked: Sequence[str] = ()):
        self.df, self.free, self.locked = df, list(free), list(locked)

    def take(self, variable: str, ids) -> Fuzzy:
        """One individual (the variable is gone) or several of them."""
        if isinstance(ids, (list, tuple)):
            return Fuzzy(self.df.filter(F.col(variable).isin(list(ids))), self.free)
        return Fuzzy(self.df.filter(F.col(variable) == ids).drop(variable), [v for v in self.free if v != variable])

    def reorder(self, free: Sequence[str]) -> Fuzzy:
        if set(free) != set(self.free):
            raise ValueError("the same variables are needed")
        return Fuzzy(self.df.select(*free, "value"), free, self.locked)


def variable(df: DataFrame, name: str, id_col: str, features: str) -> DataFrame:
    """Individuals of a variable: the id in a column named after it, and its features as an array of doubles beside it."""
    f = F.col(features)
    f = f.cast("array<double>") if df.schema[features].dataType.typeName() == "array" else F.array(f.cast("double"))
    return df.select(F.col(id_col).alias(name), f.alias(f"{name}__features"))


def predicate(fn: Callable[..., Column]) -> Callable[..., Fuzzy]:
    """``fn`` over feature columns, as a formula over every combination of the variables' individuals."""

    def call(*variables: DataFrame) -> Fuzzy:
        free = [v.columns[0] for v in variables]
        df = variables[0]
        for v in variables[1:]:
            df = df.crossJoin(v)
        return Fuzzy(df.select(*free, fn(*(F.col(f"{v}__features") for v in free)).alias("value")), free)

    return call


def diagonal(*variables: DataFrame) -> DataFrame:
    """Variables of equal length on one axis: their individuals side by side, by rank of id.

    Ranks are counted within ranges of the ids, so that no single task orders a whole variable.
    """
    out = None
    for v in variables:
        ranked = with_rank(v, v.columns[0], "rank__")
        out = ranked if out is None else out.join(ranked, "rank__")
    return out.drop("rank__")


def with_rank(df: DataFrame, order: str, name: str) -> DataFrame:
    """A gapless rank from 1 in the order of a column: positions within range partitions, shifted by the sizes of those before.

    The partitions are written out, as ranges are sampled anew whenever they are computed.
    """
    placed = materialize(df.repartitionByRange(order).withColumn("part__", F.spark_partition_id()), "ranges")
    inside = placed.withColumn("own__", F.row_number().over(Window.partitionBy("part__").orderBy(order)))
    sizes = inside.groupBy("part__").agg(F.count("*").alias("size__"))  # a row a partition
    shift = sizes.select("part__", F.coalesce(F.sum("size__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift__"))
    return inside.join(F.broadcast(shift), "part__").withColumn(name, F.col("own__") + F.col("shift__")).drop("part__", "own__", "shift__")


def broadcast_formulas(*formulas: Fuzzy) -> tuple[DataFrame, list[str]]:
    """All values side by side (value0, value1...): joined on shared variables, combined freely on the others."""
    free: list[str] = []
    out = None
    for i, f in enumerate(formulas):
        df = f.df.select(*f.free, F.col("value").alias(f"value{i}"))
        shared = [v for v in f.free if v in free]
        out = df if out is None else out.join(df, shared) if shared else out.crossJoin(df)
        free += [v for v in f.free if v not in free]
    return out, free


def connective(op: Callable[..., Column]) -> Callable[..., Fuzzy]:
    def call(*formulas: Fuzzy) -> Fuzzy:
        df, free = broadcast_formulas(*formulas)
        return Fuzzy(df.select(*free, op(*(F.col(f"value{i}") for i in range(len(formulas)))).alias("value")), free)

    return call


def quantifier(aggregate: Callable[[Column], Column], semantics: str) -> Callable[..., Fuzzy]:
    """``call(variables, formula, mask)``: the aggregate over the variables, of the rows that the mask keeps.

    The mask is a Fuzzy whose ``value`` is a boolean. A group of which nothing is kept has the value of the empty
    quantifier: 1 for ``forall``, 0 for ``exists``.
    """
    empty = fuzzy.EMPTY[semantics]

    def call(variables: Sequence[str], formula: Fuzzy, mask: Fuzzy | None = None) -> Fuzzy:
        df, free = (formula.df, formula.free) if mask is None else broadcast_formulas(formula, mask)
        if mask is not None:
            df = df.select(*free, F.when(F.col("value1"), F.col("value0")).alias("value"), F.col("value1").alias("kept"))
        rest = [v for v in free if v not in variables]
        # a null isn't aggregated, and a group of nulls stays a group
        out = df.groupBy(*rest).agg(F.coalesce(aggregate(F.col("value")), F.lit(empty)).alias("value"))
        return Fuzzy(out, rest)

    return call
