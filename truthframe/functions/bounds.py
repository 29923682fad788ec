"""Weighted Lukasiewicz logic on truth bounds: a pair of Columns (lower, upper) for every operand.

Upward functions give a formula's bounds from those of its operands, downward functions an operand's from those of
the formula and the other operands. Weights and bias default to 1.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Bounds = tuple[Column, Column]

#: The threshold from which a value counts as classically true.
ALPHA = math.erf(10 / math.sqrt(2))

TRUE, FALSE, UNKNOWN, CONTRADICTION = (1.0, 1.0), (0.0, 0.0), (0.0, 1.0), (1.0, 0.0)
#: Bounds that a grounding without any has, by the world a formula lives in.
WORLDS = {"AXIOM": TRUE, "CLOSED": FALSE, "FALSE": FALSE, "OPEN": UNKNOWN, "CONTRADICTION": CONTRADICTION}
FACTS = {"TRUE": TRUE, "FALSE": FALSE, "UNKNOWN": UNKNOWN, "CONTRADICTION": CONTRADICTION, True: TRUE, False: FALSE}


def clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def _weights(n: int, weights: Sequence[float] | None) -> list[float]:
    out = [1.0] * n if weights is None else [float(w) for w in weights]
    if len(out) != n:
        raise ValueError("a weight for each operand")
    return out


def _sum(terms) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def not_(x: Bounds) -> Bounds:
    return 1 - x[1], 1 - x[0]


def absorb(x: Bounds, w: float) -> tuple[Bounds, float]:
    """A negative weight is a weight on the negation."""
    return (x, w) if w >= 0 else (not_(x), -w)


def and_up(operands: Sequence[Bounds], weights: Sequence[float] | None = None, bias: float = 1.0) -> Bounds:
    pairs = [absorb(x, w) for x, w in zip(operands, _weights(len(operands), weights))]
    return tuple(clamp(F.lit(float(bias)) - _sum((1 - x[side]) * w for x, w in pairs)) for side in (0, 1))


def or_up(operands: Sequence[Bounds], weights: Sequence[float] | None = None, bias: float = 1.0) -> Bounds:
    pairs = [absorb(x, w) for x, w in zip(operands, _weights(len(operands), weights))]
    return tuple(clamp(F.lit(1.0 - bias) + _sum(x[side] * w for x, w in pairs)) for side in (0, 1))


def or_up_plain(operands: Sequence[Bounds], weights: Sequence[float] | None = None, bias: float = 1.0) -> Bounds:
    """The disjunction with its weights as they are, negative ones too."""
    pairs = list(zip(operands, _weights(len(operands), weights)))
    return tuple(clamp(F.lit(1.0 - bias) + _sum(x[side] * w for x, w in pairs)) for side in (0, 1))


def implies_up(x: Bounds, y: Bounds, weights: Sequence[float] | None = None, bias: float = 1.0) -> Bounds:
    return or_up([not_(x), y], weights, bias)


def and_down(whole: Bounds, operands: Sequence[Bounds], weights: Sequence[float] | None = None, bias: float = 1.0) -> list[Bounds]:
    """Bounds that the conjunction's own bounds force on each operand; siblings are read at their opposite bound.

    A lower bound of 0 says nothing about any operand, nor does an upper bound of 1. An operand of weight 0 stays
    unknown.
    """
    ws = _weights(len(operands), weights)
    total = sum(ws)
    low = whole[0] + F.when(whole[0] <= 0, F.lit(bias - total)).otherwise(0.0)
    high = whole[1] + F.when(whole[1] >= 1, F.lit(bias - 1.0)).otherwise(0.0)
    out = []
    for i, w in enumerate(ws):
        if w == 0:
            out.append((F.lit(0.0), F.lit(1.0)))
            continue
        others = [(x, v) for j, (x, v) in enumerate(zip(operands, ws)) if j != i]
        l = clamp(1 + (low - bias + _sum((1 - x[1]) * v for x, v in others)) / w)
        u = clamp(1 + (high - bias + _sum((1 - x[0]) * v for x, v in others)) / w)
        out.append((F.when(whole[0] > 1 - ALPHA, l).otherwise(0.0), F.when(whole[1] < ALPHA, u).otherwise(1.0)))
    return out


def or_down(whole: Bounds, operands: Sequence[Bounds], weights: Sequence[float] | None = None, bias: float = 1.0) -> list[Bounds]:
    return [not_(x) for x in and_down(not_(whole), [not_(x) for x in operands], weights, bias)]


def implies_down(whole: Bounds, x: Bounds, y: Bounds, weights: Sequence[float] | None = None, bias: float = 1.0) -> list[Bounds]:
    """Modus tollens for the premise, modus ponens for the conclusion."""
    premise, conclusion = and_down(not_(whole), [x, not_(y)], weights, bias)
    return [premise, not_(conclusion)]


def iff_up(x: Bounds, y: Bounds) -> Bounds:
    return and_up([implies_up(x, y), implies_up(y, x)])


def xor_up(operands: Sequence[Bounds]) -> Bounds:
    """Some operand holds, and no two of them do."""
    return and_up([or_up(operands), *(not_(and_up(pair)) for pair in combinations(operands, 2))])


def congruent_up(operands: Sequence[Bounds]) -> Bounds:
    """All operands have one truth value: the tightest bounds among them."""
    if len(operands) == 1:
        return operands[0]
    return F.greatest(*(x[0] for x in operands)), F.least(*(x[1] for x in operands))


def tighten(old: Bounds, new: Bounds, side: str = "both") -> Bounds:
    """Proofs only ever tighten; ``side`` restricts a proof to ``lower`` or ``upper``."""
    low = clamp(F.greatest(old[0], new[0])) if side != "upper" else old[0]
    high = clamp(F.least(old[1], new[1])) if side != "lower" else old[1]
    return low, high


def region(x: Column, alpha: float = ALPHA) -> Column:
    """1 false, 2 rather false, 3 midpoint, 4 rather true, 5 true."""
    return F.when(x <= 1 - alpha, 1).when(x >= alpha, 5).when(x < 0.5, 2).when(x == 0.5, 3).otherwise(4)


def is_contradiction(x: Bounds, alpha: float = ALPHA) -> Column:
    """The bounds cross, and not merely within what counts as false or as true."""
    return (x[0] > x[1]) & (x[0] > 1 - alpha) & (x[1] < alpha)


def state(x: Bounds, alpha: float = ALPHA) -> Column:
    """T, F, U, C; ~T, ~F, ~U for fuzzy bounds; =U for the exact midpoint."""
    low, high = region(x[0], alpha), region(x[1], alpha)
    return (
        F.when(is_contradiction(x, alpha), "C")
        .when((low == 1) & (high == 5), "U")
        .when((low == 1) & (high == 1), "F")
        .when((low == 5) & (high == 5), "T")
        .when((low == 3) & (high == 3), "=U")
        .when((low <= 2) & (high <= 2), "~F")
        .when((low >= 4) & (high >= 4), "~T")
        .otherwise("~U")
    )


def contradiction_loss(x: Bounds) -> Column:
    return F.sum(F.greatest(x[0] - x[1], F.lit(0.0)))


def uncertainty_loss(x: Bounds) -> Column:
    return F.sum(F.greatest(x[1] - x[0], F.lit(0.0)))


def supervised_loss(x: Bounds, label: Bounds) -> Column:
    """Mean squared distance of both bounds from their labels."""
    return F.avg((F.pow(x[0] - label[0], F.lit(2)) + F.pow(x[1] - label[1], F.lit(2))) / 2)


def logical_loss(weights: Sequence[float], bias: float, alpha: float = ALPHA) -> float:
    """How far a neuron is from behaving classically: its weights should reach alpha, its bias not exceed them."""
    slack = sum(max(0.0, alpha - w) for w in weights)
    return slack + max(0.0, bias - (1 - alpha + min(weights, default=0.0) * alpha) - 1)


def truth_table(spark: SparkSession, names: Sequence[str], states: Sequence[float] = (0.0, 1.0)) -> DataFrame:
    """Every combination of the states, a column for each name; ``len(states) ** len(names)`` rows by definition."""
    out = spark.range(1, numPartitions=1).select()
    for name in names:
        out = out.select("*", F.explode(F.array(*(F.lit(float(x)) for x in states))).alias(name))
    return out
