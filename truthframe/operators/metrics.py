"""Classification and ranking metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truthframe.session import materialize


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn, accuracy, balanced accuracy, precision, recall and F1; 0 where a denominator is."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    count = lambda c: F.count_if(c)
    out = df.groupBy(*by).agg(count(hit & pos).alias("tp"), count(hit & ~pos).alias("fp"), count(~hit & ~pos).alias("tn"), count(~hit & pos).alias("fn"))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return out.select(
        *by, "tp", "fp", "tn", "fn", _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ((r + _ratio(tn, tn + fp)) / 2).alias("balanced"), p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1")
    )


def _cumulated(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score, ascending: the score before, rows and positives at lower scores, and the totals.

    Scores are summed up before ordering; ranges of scores are then cumulated each for itself and shifted by the
    sums of the ranges below.
    """
    per = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    # written out, as ranges are sampled anew whenever they are computed
    placed = materialize(per.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part").agg(F.sum("n").alias("pn"), F.sum("p").alias("pp"), F.max("s").alias("top"))  # a row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(a) for c, a in (("pn", "n0"), ("pp", "p0"))), F.sum("pn").over(every).alias("total"), F.sum("pp").over(every).alias("positives"), F.lag("top").over(Window.orderBy("part")).alias("s0")
    )
    return (
        placed.withColumns({"nb": F.coalesce(F.sum("n").over(inside), F.lit(0)), "pb": F.coalesce(F.sum("p").over(inside), F.lit(0)), "prev": F.lag("s").over(Window.partitionBy("part").orderBy("s"))})
        .join(F.broadcast(sums), "part")
        .select("s", F.coalesce("prev", "s0").alias("prev"), "n", "p", (F.col("nb") + F.col("n0")).alias("n_below"), (F.col("pb") + F.col("p0")).alias("p_below"), "total", "positives")
    )


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the ROC curve, ties counting half; null without both classes."""
    c = _cumulated(df, score, label)
    neg_below, neg = F.col("n_below") - F.col("p_below"), F.col("n") - F.col("p")
    wins = F.sum(F.col("p") * (neg_below + neg / 2))
    pos, total = F.max("positives"), F.max("total")
    return c.agg(F.when((pos > 0) & (total > pos), wins / (pos * (total - pos))).alias("auc"))


def threshold_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """Balanced accuracy, F1 and accuracy at every candidate threshold: 0.5, below the least score, between neighbours, at each, and above the largest."""
    c = _cumulated(df, score, label)
    # a candidate is decided by the largest score below it, so each distinct score stands for the gap beneath it
    at = F.when(F.col("prev").isNull(), F.array(F.greatest(F.col("s") - 1e-12, F.lit(0.0)), F.col("s"))).otherwise(F.array((F.col("s") + F.col("prev")) / 2, F.col("s")))
    rows = c.select(F.explode(at).alias("threshold"), "n_below", "p_below", "total", "positives")
    whole = c.groupBy().agg(F.max("s").alias("s"), F.max("total").alias("total"), F.max("positives").alias("positives"))
    top = whole.filter(F.col("s") < 1).select(F.least(F.col("s") + 1e-12, F.lit(1.0)).alias("threshold"), F.col("total").alias("n_below"), F.col("positives").alias("p_below"), "total", "positives")
    half = c.agg(F.coalesce(F.sum(F.when(F.col("s") < 0.5, F.col("n"))), F.lit(0)).alias("n_below"), F.coalesce(F.sum(F.when(F.col("s") < 0.5, F.col("p"))), F.lit(0)).alias("p_below"), F.max("total").alias("total"), F.max("positives").alias("positives"))
    half = half.select(F.lit(0.5).alias("threshold"), "n_below", "p_below", "total", "positives")
    rows = rows.unionByName(top).unionByName(half).distinct()
    tp, fn = F.col("positives") - F.col("p_below"), F.col("p_below")
    tn = F.col("n_below") - F.col("p_below")
    fp = F.col("total") - F.col("positives") - tn
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return rows.select(
        "threshold", ((r + _ratio(tn, tn + fp)) / 2).alias("balanced"), _ratio(2 * p * r, p + r).alias("f1"), _ratio(tp + tn, F.col("total")).alias("accuracy"), (tp + fp).alias("called"), "total"
    )


def best_threshold(df: DataFrame, score: str, label: str, metric: str = "balanced", robust: bool = False) -> DataFrame:
    """One row: the best candidate threshold and its metrics; ties go to the better balanced accuracy, then to the lower threshold.

    ``robust`` leaves out thresholds that put all rows into one class, breaks ties by closeness to 0.5, and falls back
    to the median score if the best balanced accuracy is 0.51 or less.
    """
    t = threshold_table(df, score, label)
    r = lambda c: F.round(c, 12)
    if not robust:
        best = t.orderBy(r(F.col(metric)).desc(), r(F.col("balanced")).desc(), "threshold").limit(1)
        return best.select("threshold", "balanced", "f1", "accuracy")
    t = t.filter((F.col("called") > 0) & (F.col("called") < F.col("total")))
    best = t.orderBy(r(F.col(metric)).desc(), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)
    median = df.agg(F.percentile(score, 0.5).alias("median"))
    weak = F.coalesce(F.col("balanced") <= 0.51, F.lit(True))
    return median.join(best, F.lit(True), "left").select(F.when(weak, F.col("median")).otherwise(F.col("threshold")).alias("threshold"), "balanced", "f1", "accuracy")


def regression_errors(df: DataFrame, prediction: str, target: str) -> DataFrame:
    e = F.col(prediction) - F.col(target)
    msle = F.avg(F.pow(F.log1p(F.greatest(F.col(prediction), F.lit(0.0))) - F.log1p(F.greatest(F.col(target), F.lit(0.0))), F.lit(2)))
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), msle.alias("msle"))


def macro_precision_recall(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """Precision and recall averaged over the classes that occur as prediction or target."""
    c = df.groupBy(F.col(prediction).alias("p"), F.col(target).alias("t")).agg(F.count("*").alias("n"))
    hits = F.sum(F.when(F.col("p").eqNullSafe(F.col("t")), F.col("n")).otherwise(0))
    by_p = c.groupBy(F.col("p").alias("class")).agg((hits / F.sum("n")).alias("precision"))
    by_t = c.groupBy(F.col("t").alias("class")).agg((hits / F.sum("n")).alias("recall"))
    both = by_p.join(by_t, "class", "full").fillna(0.0, ["precision", "recall"])
    return both.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def ranked(df: DataFrame, score: str, label: str, group: Sequence[str] = ("uid", "time"), tie: Sequence[str] = ()) -> DataFrame:
    """``rank`` within each group by score and then label, both descending; ``ideal`` by label alone."""
    w = Window.partitionBy(*group)
    best = w.orderBy(F.col(score).desc(), F.col(label).desc(), *tie)
    ideal = w.orderBy(F.col(label).desc(), *tie)
    return df.withColumns({"rank": F.row_number().over(best), "ideal": F.row_number().over(ideal)})


def ranking_at_k(df: DataFrame, score: str, label: str, k: int, group: Sequence[str] = ("uid", "time"), tie: Sequence[str] = ()) -> DataFrame:
    """One row: ndcg, hit, precision (by min(k, list length)) and recall at k, averaged over the groups; a group without any positive counts 0."""
    rows = ranked(df, score, label, group, tie)
    gain = lambda at: F.col(label) / F.log2(F.col(at) + 1)
    top = F.col("rank") <= k
    per = rows.groupBy(*group).agg(
        F.sum(F.when(top, gain("rank")).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, gain("ideal")).otherwise(0.0)).alias("idcg"),
        F.sum(F.when(top & (F.col(label) > 0), 1).otherwise(0)).alias("hits"),
        F.count_if(F.col(label) > 0).alias("positives"),
        F.count("*").alias("length"),
    )
    return per.agg(
        F.avg(_ratio(F.col("dcg"), F.col("idcg"))).alias("ndcg"),
        F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("hit"),
        F.avg(F.col("hits") / F.least(F.lit(k), F.col("length"))).alias("precision"),
        F.avg(_ratio(F.col("hits"), F.col("positives"))).alias("recall"),
    )


# over an array of relevances in rank order


def reciprocal_rank(r: Column) -> Column:
    """1 over the place of the first relevant entry, 0 if there is none."""
    places = F.filter(F.transform(r, lambda x, i: F.when(x != 0, i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(places) > 0, 1 / F.element_at(F.when(F.size(places) > 0, places), 1)).otherwise(0.0)


def _hits(r: Column) -> Column:
    return F.aggregate(r, F.lit(0.0), lambda s, x: s + F.when(x != 0, 1.0).otherwise(0.0))


def precision_at(r: Column, k: int) -> Column:
    """Share of relevant entries among the first ``k``, or among all where there are fewer; 0 without any."""
    first = F.slice(r, 1, k)
    return F.when(F.size(first) > 0, _hits(first) / F.size(first)).otherwise(0.0)


def r_precision(r: Column) -> Column:
    """Precision down to the last relevant entry."""
    last = F.aggregate(F.transform(r, lambda x, i: F.when(x != 0, i + 1).otherwise(0)), F.lit(0), lambda s, x: F.greatest(s, x))
    return F.when(last > 0, _hits(r) / last).otherwise(0.0)


def average_precision(r: Column) -> Column:
    """Mean of the precisions at the relevant entries."""
    zero = F.struct(F.lit(0.0).alias("hits"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"))

    def step(s, x):
        hits = s["hits"] + F.when(x != 0, 1.0).otherwise(0.0)
        n = s["n"] + 1.0
        return F.struct(hits.alias("hits"), (s["sum"] + F.when(x != 0, hits / n).otherwise(0.0)).alias("sum"), n.alias("n"))

    return F.aggregate(r, zero, step, lambda s: F.when(s["hits"] > 0, s["sum"] / s["hits"]).otherwise(0.0))


def dcg_at(r: Column, k: int, method: int = 0) -> Column:
    """Method 0 discounts from the third place on (by log2 of the place, the first two being whole), method 1 by log2(place + 1)."""
    first = F.slice(r, 1, k)
    discount = (lambda i: F.log2(i + 2.0)) if method else (lambda i: F.when(i < 1, 1.0).otherwise(F.log2(i + 1.0)))
    terms = F.transform(first, lambda x, i: x.cast("double") / discount(i))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def ndcg_at(r: Column, k: int, method: int = 0) -> Column:
    best = dcg_at(F.reverse(F.array_sort(r)), k, method)
    return F.when(best > 0, dcg_at(r, k, method) / best).otherwise(0.0)


def bpr_max_loss(df: DataFrame, score: str, label: str, group: Sequence[str]) -> DataFrame:
    """Per group: -log of the softmax-weighted chance that the positive beats each negative."""
    pos = df.filter(F.col(label) > 0).select(*group, F.col(score).alias("sp"))
    neg = df.filter(F.col(label) <= 0).select(*group, F.col(score).alias("sn"))
    top = neg.groupBy(*group).agg(F.max("sn").alias("top"))
    e = F.exp(F.col("sn") - F.col("top"))
    both = neg.join(top, list(group)).join(pos, list(group))
    return both.groupBy(*group, "sp").agg((-F.log(F.sum(e / (1 + F.exp(F.col("sn") - F.col("sp")))) / F.sum(e))).alias("loss")).drop("sp")


def score_summary(df: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """n, mean, sd, minimum, quartiles and maximum of each class."""
    q = lambda p: F.percentile(score, p)
    return df.groupBy(*by).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("sd"), F.min(score).alias("least"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max(score).alias("most")
    )


def mean_and_std(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over seeds; a single seed deviates by 0."""
    return df.groupBy(*by).agg(*(f for v in values for f in (F.avg(v).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_std"))))


def early_stop(values: Sequence[float], patience: int, higher_is_better: bool = True) -> bool:
    """Whether the best of a history lies ``patience`` or more steps back."""
    if not values:
        return False
    best = max(values) if higher_is_better else min(values)
    return len(values) - 1 - values.index(best) >= patience


def first_number(text: Column) -> Column:
    """The first number that a text holds; null without any."""
    found = F.regexp_extract(text, r"-?[0-9]+(?:\.[0-9]+)?", 0)
    return F.when(found != "", found.cast("double"))


def text_scores(df: DataFrame, answer: str, target: str) -> DataFrame:
    """One row for answers given as text: the share that equal their target but for case and blanks, and the errors of the
    numbers in them; answers without a number count as wrong and take no part in the errors."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    a, t = first_number(F.col(answer)), first_number(F.col(target))
    return df.agg(
        F.avg(F.when(norm(F.col(answer)) == norm(F.col(target)), 1.0).otherwise(0.0)).alias("accuracy"), F.avg(F.abs(a - t)).alias("mae"), F.avg((a - t) * (a - t)).alias("mse"), F.count(a - t).alias("numbers")
    )


def label_average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``average_precision`` of each label of a multi-label task (0 without a positive), rows of equal score counting together.

    Scores are summed up first, so that a label's rows are ordered by distinct score only.
    """
    per = df.groupBy(*by, F.col(score).alias("s__")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    w = Window.partitionBy(*by).orderBy(F.col("s__").desc()).rowsBetween(Window.unboundedPreceding, 0)
    part = F.col("p") * F.sum("p").over(w) / F.sum("n").over(w)
    return per.withColumn("part", part).groupBy(*by).agg(F.when(F.sum("p") > 0, F.sum("part") / F.sum("p")).otherwise(0.0).alias("average_precision"))
