"""Relational calculus over predicates by arity: one frame per arity, with coordinates x1..xr and channel columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truthframe.functions import fuzzy


def all_distinct(columns: Sequence[str]) -> Column:
    """No two coordinates are equal."""
    return reduce(lambda a, b: a & b, (F.col(a) != F.col(b) for a, b in combinations(columns, 2)), F.lit(True))


def expand(df: DataFrame, domain: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """A further free coordinate: every row for every object of the domain (of the same graph, with ``by``)."""
    objects = domain.select(*by, F.col([c for c in domain.columns if c not in by][0]).alias(name))
    return df.join(objects, list(by)) if by else df.crossJoin(objects)


def reduce_last(df: DataFrame, coordinates: Sequence[str], channels: Sequence[str], by: Sequence[str] = (), exclude_self: bool = True) -> DataFrame:
    """exists and forall over the last coordinate: ``<channel>_exists`` (maximum) and ``<channel>_forall`` (minimum).

    With ``exclude_self`` tuples with equal coordinates count as 0 for exists and 1 for forall, so that a group of
    only such tuples is 0 and 1.
    """
    rest = [*by, *coordinates[:-1]]
    ok = all_distinct(coordinates) if exclude_self else F.lit(True)
    aggs = []
    for c in channels:
        aggs += [F.max(F.when(ok, F.col(c)).otherwise(0.0)).alias(f"{c}_exists"), F.min(F.when(ok, F.col(c)).otherwise(1.0)).alias(f"{c}_forall")]
    return df.groupBy(*rest).agg(*aggs)


def permute(df: DataFrame, coordinates: Sequence[str], channels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A channel for every order of the coordinates: ``<channel>_p<order>`` holds the value at the coordinates so ordered.

    Needs all tuples to be there, as dense predicates have them.
    """
    keys = [*by, *coordinates]
    out = df.select(*keys)
    for order in permutations(range(len(coordinates))):
        tag = "p" + "".join(map(str, order))
        # the row at (x_order) carries its value to the row at x
        moved = df.select(*by, *(F.col(coordinates[i]).alias(coordinates[j]) for j, i in enumerate(_inverse(order))), *(F.col(c).alias(f"{c}_{tag}") for c in channels))
        out = out.join(moved, keys)
    return out


def _inverse(order: Sequence[int]) -> list[int]:
    out = [0] * len(order)
    for i, o in enumerate(order):
        out[o] = i
    return out


def meshgrid(df: DataFrame, key: str, values: Sequence[str], mode: str = "concat", by: Sequence[str] = (), exclude_self: bool = False) -> DataFrame:
    """Every pair of objects of one group, with both values (concat), their difference (diff), or how they compare (cmp: lt, eq, gt)."""
    left = df.select(*by, F.col(key).alias("x"), *(F.col(v).alias(f"{v}_x") for v in values))
    right = df.select(*by, F.col(key).alias("y"), *(F.col(v).alias(f"{v}_y") for v in values))
    pairs = left.join(right, list(by)) if by else left.crossJoin(right)
    if exclude_self:
        pairs = pairs.filter("x != y")
    if mode == "concat":
        return pairs
    out = []
    for v in values:
        a, b = F.col(f"{v}_x"), F.col(f"{v}_y")
        out += [(a - b).alias(f"{v}_diff")] if mode == "diff" else [(a < b).alias(f"{v}_lt"), (a == b).alias(f"{v}_eq"), (a > b).alias(f"{v}_gt")]
    return pairs.select(*by, "x", "y", *out)


def logic_layer(
    tensors: dict[int, DataFrame], domain: DataFrame, weights: dict[int, Sequence[tuple]], by: Sequence[str] = ("graph",), exclude_self: bool = True, residual: bool = False
) -> dict[int, DataFrame]:
    """One layer: at each arity the own channels, those expanded from below and those reduced from above, in every order of the
    coordinates, through a network given as ``[(weights, bias), ...]`` with a sigmoid at its end.

    ``tensors[r]`` has ``by``, x1..xr and channel columns in a fixed order, dense over the domain; an arity without
    weights gets no output. With ``residual`` the input channels follow the output's.
    """
    by = list(by)
    out = {}
    for r, layers in weights.items():
        coordinates = [f"x{i + 1}" for i in range(r)]
        keys = [*by, *coordinates]
        parts = []
        if r - 1 in tensors and r > 0:
            parts.append(expand(tensors[r - 1], domain, f"x{r}", by))
        if r in tensors:
            parts.append(tensors[r])
        if r + 1 in tensors:
            above = tensors[r + 1]
            inner = [*coordinates, f"x{r + 1}"]
            parts.append(reduce_last(above, inner, [c for c in above.columns if c not in (*by, *inner)], by, exclude_self))
        joined, names = None, []
        for k, part in enumerate(parts):
            channels = [c for c in part.columns if c not in keys]
            part = part.select(*keys, *(F.col(c).alias(f"c{k}_{c}") for c in channels))
            names += [f"c{k}_{c}" for c in channels]
            joined = part if joined is None else joined.join(part, keys) if keys else joined.crossJoin(part)
        if r > 1:
            joined = permute(joined, coordinates, names, by)
            names = [c for c in joined.columns if c not in keys]
        values = fuzzy.mlp([F.col(c) for c in names], layers)
        outs = joined.select(*keys, *(v.alias(f"o{i}") for i, v in enumerate(values)))
        if residual and r in tensors:
            outs = outs.join(tensors[r], keys)
        out[r] = outs
    return out


def logic_machine(tensors: dict[int, DataFrame], domain: DataFrame, layers: Sequence[dict], by: Sequence[str] = ("graph",), exclude_self: bool = True, io_residual: bool = False) -> dict[int, DataFrame]:
    """Layers one after the other; the same weights given again make recursion. With ``io_residual`` every layer also sees the input."""
    first, now = tensors, tensors
    for i, w in enumerate(layers):
        now = logic_layer(now, domain, w, by, exclude_self)
        now = {r: df.select(*(F.col(c).alias(f"l{i}_{c}") if c.startswith("o") else F.col(c) for c in df.columns)) for r, df in now.items()}
        if io_residual and i < len(layers) - 1:
            now = {r: df.join(first[r], [*by, *(f"x{k + 1}" for k in range(r))]) if r in first else df for r, df in now.items()}
    return now


def masked_pool(df: DataFrame, by: Sequence[str], channels: Sequence[str], valid: Column) -> DataFrame:
    """Mean and maximum of each channel over a group's valid rows; -1e9 where there is none."""
    aggs = []
    for c in channels:
        v = F.when(valid, F.col(c))
        aggs += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.max(v), F.lit(-1e9)).alias(f"{c}_max")]
    return df.groupBy(*by).agg(*aggs)


def compose(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs (a, c) with some b between them: relations ``(a, b)``."""
    r = right.select(*by, F.col("a").alias("b"), F.col("b").alias("c"))
    return left.join(r, [*by, "b"]).select(*by, "a", F.col("c").alias("b")).distinct()
