"""Relations of groundings: key columns and truth bounds ``l``, ``u``, one row for each grounding."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truthframe.functions import bounds as B
from truthframe.session import local_frame


class Relation:
    """A predicate's groundings. Missing groundings have the bounds of its world; keys are strings unless given otherwise.

    ``df`` holds current bounds; ``leaves`` the asserted ones that ``reset`` returns to. Frames are immutable, so
    every method that changes bounds returns a new relation.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], world: str = "OPEN", leaves: DataFrame | None = None):
        self.keys, self.world = list(keys), world
        self.df = df.select(*self.keys, F.col("l").cast("double").alias("l"), F.col("u").cast("double").alias("u"))
        self.leaves = self.df if leaves is None else leaves

    @classmethod
    def from_facts(cls, spark: SparkSession, keys: Sequence[str], facts: Mapping, world: str = "OPEN") -> Relation:
        """``facts``: grounding (a string or tuple) -> True, False, a fact's name or a pair of bounds."""
        schema = ", ".join([*(f"{k} string" for k in keys), "l double", "u double"])
        return cls(local_frame(spark, [(*_grounding(g), *_bounds(v)) for g, v in facts.items()], schema), keys, world)

    def _with(self, df: DataFrame, leaves: DataFrame | None = None) -> Relation:
        return Relation(df, self.keys, self.world, self.leaves if leaves is None else leaves)

    def add_data(self, other: DataFrame) -> Relation:
        """Asserts the groundings of ``other``: new ones come in, known ones are overwritten. Of a grounding given twice, the tightest bounds hold."""
        new = merge(other.select(*self.keys, "l", "u"), self.keys)
        kept = lambda df: df.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new)
        return self._with(kept(self.df), kept(self.leaves))

    def tighten(self, proofs: DataFrame, side: str = "both") -> Relation:
        """Bounds after proofs (keys, l, u), several for one grounding allowed; new groundings start from the world's bounds."""
        return self._with(self.tightened(proofs, side))

    def tightened(self, proofs: DataFrame, side: str = "both") -> DataFrame:
        """Keys and bounds after proofs, and ``moved``: by how much either bound of a grounding changed, from the world's where it is new."""
        low, high = B.WORLDS[self.world]
        new = merge(proofs.select(*self.keys, "l", "u"), self.keys).select(*self.keys, F.col("l").alias("pl"), F.col("u").alias("pu"))
        both = self.df.join(new, self.keys, "full") if self.keys else self.df.crossJoin(new)
        old = F.coalesce("l", F.lit(low)), F.coalesce("u", F.lit(high))
        l, u = B.tighten(old, (F.coalesce("pl", F.lit(0.0)), F.coalesce("pu", F.lit(1.0))), side)
        return both.select(*self.keys, l.alias("l"), u.alias("u"), (F.abs(l - old[0]) + F.abs(u - old[1])).alias("moved"))

    def reset(self) -> Relation:
        return self._with(self.leaves)

    def flush(self) -> Relation:
        """All known groundings become unknown."""
        return self._with(self.df.select(*self.keys, F.lit(0.0).alias("l"), F.lit(1.0).alias("u")))

    def in_world(self, world: str) -> Relation:
        return Relation(self.df, self.keys, world, self.leaves)

    def get(self, groundings: DataFrame) -> DataFrame:
        """Bounds of the asked groundings, the world's where there are none."""
        low, high = B.WORLDS[self.world]
        return groundings.select(*self.keys).join(self.df, self.keys, "left").select(*self.keys, F.coalesce("l", F.lit(low)).alias("l"), F.coalesce("u", F.lit(high)).alias("u"))

    def groundings(self) -> DataFrame:
        return self.df.select(*self.keys)

    def states(self) -> DataFrame:
        return self.df.withColumn("state", B.state((F.col("l"), F.col("u"))))

    def contradictions(self) -> DataFrame:
        return self.df.filter(B.is_contradiction((F.col("l"), F.col("u"))))

    def true_groundings(self) -> DataFrame:
        return self.states().filter("state = 'T'").select(*self.keys).distinct()

    def bind(self, arguments: Sequence[str | Const]) -> DataFrame:
        """The relation called with variables and constants: columns named after variables, in order of first appearance.

        A constant keeps the rows that hold it and drops the column; a repeated variable keeps rows with equal values.
        """
        df, chosen = self.df, {}
        for key, arg in zip(self.keys, arguments, strict=True):
            if isinstance(arg, Const):
                df = df.filter(F.col(key) == arg.value)
            elif arg in chosen:
                df = df.filter(F.col(key).eqNullSafe(F.col(chosen[arg])))
            else:
                chosen[arg] = key
        return df.select(*(F.col(k).alias(v) for v, k in chosen.items()), "l", "u")

    def with_labels(self, labels: DataFrame) -> DataFrame:
        """Bounds beside the labels (keys, label_l, label_u) of the labelled groundings."""
        return self.get(labels).join(labels, self.keys)


class Const:
    """A constant in a variable's place."""

    def __init__(self, value: str):
        self.value = value

    def __repr__(self) -> str:
        return f"'{self.value}'"


def _grounding(g) -> tuple:
    return g if isinstance(g, tuple) else (g,)


def _bounds(v) -> tuple[float, float]:
    if isinstance(v, (bool, str)):
        return B.FACTS[v]
    return float(v[0]), float(v[1])


def merge(proposals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Several proposals for one grounding: the largest lower and the smallest upper bound."""
    return proposals.groupBy(*keys).agg(F.max("l").alias("l"), F.min("u").alias("u"))


def unique_variables(calls: Iterable[Sequence]) -> list[str]:
    """Variables in order of first appearance."""
    return list(dict.fromkeys(v for call in calls for v in call if not isinstance(v, Const)))


def dual_key_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """The grounding join of two sets of key tuples: all pairs, each shared column once with the left and once with the right value.

    If either side is empty, what remains are the rows that are complete in all columns.  The result has
    |left| * |right| * 2 rows at most and is quadratic by definition; ``natural_join`` keeps the agreeing pairs only.
    """
    shared = [c for c in left.columns if c in right.columns]
    columns = [*left.columns, *(c for c in right.columns if c not in shared)]
    other = right.select(*(F.col(c).alias(f"{c}__r") for c in right.columns))
    pairs = left.crossJoin(other)
    rest = [F.col(f"{c}__r").alias(c) for c in right.columns if c not in shared]
    ours = pairs.select(*left.columns, *rest)
    theirs = pairs.select(*(F.col(f"{c}__r").alias(c) if c in shared else F.col(c) for c in left.columns), *rest)
    out = ours.union(theirs)
    for side, against in ((left, right), (right, left)):  # complete rows of one side survive an empty other
        if set(side.columns) == set(columns):
            out = out.union(side.select(*columns).join(against.limit(1), F.lit(True), "left_anti"))
    return out.distinct()


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs that agree on the shared columns, and rows of a side that has all columns anyway; no shared column makes it a product."""
    shared = [c for c in left.columns if c in right.columns]
    out = left.join(right, shared) if shared else left.crossJoin(right)
    for side in (left, right):
        if set(side.columns) == set(out.columns):
            out = out.unionByName(side)
    return out.distinct()


def groundings_of(calls: Sequence[DataFrame], natural: bool = False) -> DataFrame:
    """Groundings of a connective over bound operands: the union if all have the same variables, else joined from left to right."""
    keys = [c.drop("l", "u") for c in calls]
    if all(set(k.columns) == set(keys[0].columns) for k in keys):
        return reduce(lambda a, b: a.unionByName(b), keys).distinct()
    return reduce(natural_join if natural else dual_key_join, keys)


def common_groundings(calls: Sequence[DataFrame]) -> DataFrame:
    """Groundings that every operand has."""
    return reduce(lambda a, b: a.intersect(b), (c.drop("l", "u") for c in calls))


def gather(groundings: DataFrame, calls: Sequence[DataFrame], worlds: Sequence[str]) -> DataFrame:
    """Bounds ``l0, u0, l1, u1...`` of each operand beside the groundings, the operand's world where it has none."""
    out = groundings
    for i, (call, world) in enumerate(zip(calls, worlds, strict=True)):
        low, high = B.WORLDS[world]
        keys = [c for c in call.columns if c not in ("l", "u")]
        # one row for each grounding, also after bindings
        own = merge(call, keys).select(*keys, F.col("l").alias(f"l{i}"), F.col("u").alias(f"u{i}"))
        out = out.join(own, keys, "left") if keys else out.crossJoin(F.broadcast(own))
        out = out.withColumns({f"l{i}": F.coalesce(f"l{i}", F.lit(low)), f"u{i}": F.coalesce(f"u{i}", F.lit(high))})
    return out


def forall_up(df: DataFrame, free: Sequence[str]) -> DataFrame:
    """Upper bounds only: the conjunction over a group's rows."""
    return df.groupBy(*free).agg(F.lit(0.0).alias("l"), F.greatest(F.lit(0.0), 1 - F.sum(1 - F.col("u"))).alias("u"))


def exists_up(df: DataFrame, free: Sequence[str]) -> DataFrame:
    """Lower bounds only: the disjunction over a group's rows."""
    return df.groupBy(*free).agg(F.least(F.lit(1.0), F.sum("l")).alias("l"), F.lit(1.0).alias("u"))


def forall_up_grounded(df: DataFrame, free: Sequence[str]) -> DataFrame:
    """Both bounds, if the groups are known to be complete."""
    both = [F.greatest(F.lit(0.0), 1 - F.sum(1 - F.col(c))).alias(c) for c in ("l", "u")]
    return df.groupBy(*free).agg(*both)


def exists_up_grounded(df: DataFrame, free: Sequence[str]) -> DataFrame:
    return df.groupBy(*free).agg(*(F.least(F.lit(1.0), F.sum(c)).alias(c) for c in ("l", "u")))


def _group_sums(df: DataFrame, free: Sequence[str]) -> DataFrame:
    """Sums over a group beside each of its rows: aggregated on the map side and joined back, so no group is gathered in one task."""
    sums = df.groupBy(*free).agg(F.sum(1 - F.col("u")).alias("su"), F.sum(1 - F.col("l")).alias("sl"))
    return df.join(sums, list(free)) if free else df.crossJoin(F.broadcast(sums))


def forall_down(df: DataFrame, whole: DataFrame, free: Sequence[str]) -> DataFrame:
    """What the quantified formula's bounds ``whole`` (free, l, u) force on each row of a group: the conjunction's residual."""
    keys = [c for c in df.columns if c not in ("l", "u")]
    w = whole.select(*free, F.col("l").alias("wl"), F.col("u").alias("wu"))
    both = _group_sums(df, free)
    both = both.join(w, list(free)) if free else both.crossJoin(F.broadcast(w))
    low = F.when(F.col("wl") > 1 - B.ALPHA, B.clamp(F.col("wl") + F.col("su") - (1 - F.col("u")))).otherwise(0.0)
    high = F.when(F.col("wu") < B.ALPHA, B.clamp(F.col("wu") + F.col("sl") - (1 - F.col("l")))).otherwise(1.0)
    return both.select(*keys, low.alias("l"), high.alias("u"))


def exists_down(df: DataFrame, whole: DataFrame, free: Sequence[str]) -> DataFrame:
    swap = lambda x: x.select(*(c for c in x.columns if c not in ("l", "u")), (1 - F.col("u")).alias("l"), (1 - F.col("l")).alias("u"))
    return swap(forall_down(swap(df), swap(whole), free))
