"""Fuzzy connectives, aggregators and predicates as Column expressions; truth values are doubles in [0, 1].

With ``stable`` the product-like operators keep their arguments away from 0 or 1 by ``EPS``, so that logarithms and
divisions stay finite.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-4


def not_zeros(x: Column) -> Column:
    return x * (1 - EPS) + EPS


def not_ones(x: Column) -> Column:
    return x * (1 - EPS)


def not_std(x: Column) -> Column:
    return 1 - x


def not_godel(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(0.0)


def and_min(x: Column, y: Column) -> Column:
    return F.least(x, y)


def and_prod(x: Column, y: Column, stable: bool = True) -> Column:
    return not_zeros(x) * not_zeros(y) if stable else x * y


def and_luk(x: Column, y: Column) -> Column:
    return F.greatest(x + y - 1, F.lit(0.0))


def or_max(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def or_prob_sum(x: Column, y: Column, stable: bool = True) -> Column:
    if stable:
        x, y = not_ones(x), not_ones(y)
    return x + y - x * y


def or_luk(x: Column, y: Column) -> Column:
    return F.least(x + y, F.lit(1.0))


def implies_kleene_dienes(x: Column, y: Column) -> Column:
    return F.greatest(1 - x, y)


def implies_godel(x: Column, y: Column) -> Column:
    return F.when(x <= y, 1.0).otherwise(y)


def implies_reichenbach(x: Column, y: Column, stable: bool = True) -> Column:
    if stable:
        x, y = not_zeros(x), not_ones(y)
    return 1 - x + x * y


def implies_goguen(x: Column, y: Column, stable: bool = True) -> Column:
    over = not_zeros(x) if stable else x
    return F.when(x <= y, 1.0).otherwise(y / over)


def implies_luk(x: Column, y: Column) -> Column:
    return F.least(1 - x + y, F.lit(1.0))


def equiv(conj: Callable, implies: Callable) -> Callable[[Column, Column], Column]:
    """The conjunction of both implications."""
    return lambda x, y: conj(implies(x, y), implies(y, x))


# aggregates over the rows of a group


def agg_min(x: Column) -> Column:
    return F.min(x)


def agg_max(x: Column) -> Column:
    return F.max(x)


def agg_mean(x: Column) -> Column:
    return F.avg(x)


def agg_pmean(x: Column, p: float = 2, stable: bool = True) -> Column:
    """The p-mean: near the mean for p = 1, nearing the maximum as p grows."""
    return F.pow(F.avg(F.pow(not_zeros(x) if stable else x, F.lit(p))), F.lit(1.0 / p))


def agg_pmean_error(x: Column, p: float = 2, stable: bool = True) -> Column:
    """1 less the p-mean of the deviations from 1: nearing the minimum as p grows."""
    return 1 - F.pow(F.avg(F.pow(1 - (not_ones(x) if stable else x), F.lit(p))), F.lit(1.0 / p))


def agg_prod(x: Column) -> Column:
    return F.product(x)


def agg_log_prod(x: Column, stable: bool = True) -> Column:
    return F.sum(F.log(not_zeros(x) if stable else x))


agg_sum_log = agg_log_prod

#: What an aggregate over no row is worth, by the quantifier it stands for.
EMPTY = {"forall": 1.0, "exists": 0.0}


def sat_agg(aggregate: Callable[[Column], Column], formulas: Sequence) -> object:
    """One satisfaction level from closed formulas, each a frame of one row and one column ``value``."""
    return reduce(lambda a, b: a.unionByName(b), (f.select("value") for f in formulas)).agg(aggregate(F.col("value")).alias("value"))


# predicates and functions over feature vectors


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def equal_strict(a: Column, b: Column) -> Column:
    return F.when(F.forall(F.zip_with(a, b, lambda x, y: x == y), lambda x: x), 1.0).otherwise(0.0)


def equal_smooth_exp(a: Column, b: Column, alpha: float = 1.0) -> Column:
    return F.exp(-alpha * distance(a, b))


def equal_smooth_inv(a: Column, b: Column, alpha: float = 1.0) -> Column:
    return 1 / (1 + alpha * distance(a, b))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by its largest so that nothing overflows."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda s, y: s + y))


def class_truth(logits: Column, index: Column, multilabel: bool = False) -> Column:
    """The truth of "this row is of class ``index``" (from 0): a sigmoid of its own logit, or its softmax probability."""
    return sigmoid(F.element_at(logits, index + 1)) if multilabel else F.element_at(softmax(logits), index + 1)


def dense(inputs: Sequence[Column], weights: Sequence[Sequence[float]], bias: Sequence[float], activation: Callable[[Column], Column] | None = None) -> list[Column]:
    """One dense layer with given weights (a row for each output) as arithmetic on columns."""
    out = []
    for row, b in zip(weights, bias, strict=True):
        z = reduce(lambda s, t: s + t, (x * F.lit(float(w)) for x, w in zip(inputs, row, strict=True)), F.lit(float(b)))
        out.append(activation(z) if activation else z)
    return out


def mlp(inputs: Sequence[Column], layers: Sequence[tuple], hidden: Callable[[Column], Column] = elu, last: Callable[[Column], Column] = sigmoid) -> list[Column]:
    """Dense layers ``(weights, bias)`` in a row, with ``hidden`` between them and ``last`` at the end."""
    for i, (weights, bias) in enumerate(layers):
        inputs = dense(inputs, weights, bias, last if i == len(layers) - 1 else hidden)
    return list(inputs)
