"""Interaction tables (uid, iid, label, time): histories, hold-outs, negatives, features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truthframe.session import materialize


def label_01(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn(label, F.when(F.col(label) > 0, 1).otherwise(0))


def drop_negatives(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.col(label) > 0)


def drop_first(df: DataFrame, history_col: str = "history") -> DataFrame:
    """Without rows whose history is empty or null."""
    return df.filter(F.size(history_col) > 0)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, which should be total. Rows are cut to the smallest on the map side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first__")
    return df.groupBy(*keys).agg(first).select(*keys, "first__.*").select(*df.columns)


def history(df: DataFrame, last_n: int = 10, negatives: str = "none", order: Sequence[str] = ("time",), uid: str = "uid", iid: str = "iid", label: str = "label") -> DataFrame:
    """For each row the uid's earlier items, oldest first: the last ``last_n`` (0: all) positives in ``history``.

    ``negatives``: ``none`` leaves the others out, ``signed`` has them among the history as -iid, ``column`` puts them
    into ``history_neg``. A uid's rows are one window, sorted within its task and spilled if need be.
    """
    w = Window.partitionBy(uid).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    item = F.col(iid)
    kept = {"none": F.when(F.col(label) > 0, item), "column": F.when(F.col(label) > 0, item), "signed": F.when(F.col(label) > 0, item).otherwise(-item)}[negatives]
    tail = lambda c: F.slice(c, F.greatest(F.size(c) - last_n + 1, F.lit(1)), last_n) if last_n else c
    out = df.withColumn("history", tail(F.collect_list(kept).over(w)))
    if negatives == "column":
        out = out.withColumn("history_neg", tail(F.collect_list(F.when(F.col(label) <= 0, item)).over(w)))
    return out


def full_history(df: DataFrame, train: DataFrame, order: Sequence[str] = ("time",), uid: str = "uid", iid: str = "iid", label: str = "label") -> DataFrame:
    """For each row all the uid's positives of ``train`` in order; an empty history where there are none."""
    lists = group_interactions(train.filter(F.col(label) > 0), order, uid, iid).withColumnRenamed("iids", "history")
    return df.join(lists, uid, "left").withColumn("history", F.coalesce("history", F.array().cast(lists.schema["history"].dataType)))


def group_interactions(df: DataFrame, order: Sequence[str] = ("time",), uid: str = "uid", iid: str = "iid") -> DataFrame:
    """``(uid, iids)``: each uid's items in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(iid).alias("iid__"))))
    return df.groupBy(uid).agg(F.transform(rows, lambda r: r["iid__"]).alias("iids"))


def leave_out_by_time(df: DataFrame, leave_n: int = 1, warm_n: int = 5, rounds: int = 1, order: Sequence[str] = ("time",), uid: str = "uid", label: str = "label", positives_only: bool = True) -> DataFrame:
    """``split`` for each row: ``train``, or ``out1`` (the newest), ``out2``... for the rounds of holding out.

    Positive labels only: a uid's first ``warm_n`` rows are for training; of the rest, each round takes the last ``leave_n``.
    0/1 labels: training has all up to the row after the ``warm_n``-th positive (the last positive if there are
    fewer; none without a positive); of the rest, each round takes all from the ``leave_n``-th positive from the end
    on, the first positive if there are fewer, and what has no positive left goes back to training.
    """
    up = Window.partitionBy(uid).orderBy(*order)
    down = Window.partitionBy(uid).orderBy(*(F.col(c).desc() for c in order))
    if positives_only:
        df = df.withColumns({"first__": F.row_number().over(up), "last__": F.row_number().over(down)})
        turn = F.ceil(F.col("last__") / leave_n).cast("int")
        split = F.when((F.col("first__") > warm_n) & (turn <= rounds), F.concat(F.lit("out"), turn)).otherwise("train")
        return df.withColumn("split", split).drop("first__", "last__")
    hit = F.when(F.col(label) > 0, 1).otherwise(0)
    everything = Window.partitionBy(uid)
    df = df.withColumns({"nth__": F.row_number().over(up), "seen__": F.sum(hit).over(up), "all__": F.sum(hit).over(everything)})
    # the row of the warm_n-th positive, or of the last
    mark = F.max(F.when((hit == 1) & (F.col("seen__") == F.least(F.lit(warm_n), F.col("all__"))), F.col("nth__"))).over(everything)
    df = df.withColumn("warm__", F.coalesce(F.col("nth__") <= mark + 1, F.lit(False)))
    # positives from the end, among what is left; a round ends where leave_n of them are passed
    left = F.when(~F.col("warm__"), hit).otherwise(0)
    df = df.withColumns({"tail__": F.sum(left).over(down), "rest__": F.sum(left).over(everything)})
    # a row behind the last positive belongs to round 1; a row before the first positive to none
    turn = F.greatest(F.ceil(F.col("tail__") / leave_n), F.lit(1)).cast("int")
    # a row between two positives is taken with the earlier one: those with no new positive count to the positive before them
    own = F.ceil((F.col("tail__") + F.when(left == 1, 0).otherwise(1)) / leave_n).cast("int")
    turn = F.when(left == 1, turn).otherwise(own)
    reach = F.ceil(F.col("rest__") / leave_n).cast("int")
    before_first = (left == 0) & (F.col("tail__") == F.col("rest__"))
    split = F.when(~F.col("warm__") & (F.col("rest__") > 0) & ~before_first & (turn <= F.lit(rounds)) & (turn <= reach), F.concat(F.lit("out"), turn)).otherwise("train")
    return df.withColumn("split", split).drop("nth__", "seen__", "all__", "warm__", "tail__", "rest__")


def negatives(users: DataFrame, items: DataFrame, known: DataFrame, per_user: int, seed: int = 0, uid: str = "uid", iid: str = "iid") -> DataFrame:
    """``per_user`` items for each user that aren't known for it, in hash order: all there are if there are fewer.

    Candidates are drawn by probing: with the items numbered from 1, a user tries pseudo-random numbers, ``seen + 2 * per_user``
    and some, so nothing grows with users times items. Users that need more than half of what is left, and those
    whose tries yield too few, take from all items.
    """
    from truthframe.operators.fuzzy_logic import with_rank

    numbered = with_rank(items.select(iid).distinct(), iid, "rank__")
    size = numbered.count()
    seen = known.select(uid, iid).join(numbered.select(iid), iid, "left_semi").select(uid, iid).distinct()
    counts = users.select(uid).distinct().join(seen.groupBy(uid).agg(F.count("*").alias("seen__")), uid, "left").fillna(0, ["seen__"])
    counts = counts.withColumn("wanted__", F.least(F.lit(per_user).cast("long"), F.lit(size) - F.col("seen__")))
    many = F.col("wanted__") * 2 > F.lit(size) - F.col("seen__")
    tries = F.col("seen__") + 2 * per_user + 8
    probes = counts.filter(~many & (F.col("wanted__") > 0)).withColumn("try__", F.explode(F.sequence(F.lit(0), tries.cast("int"))))
    probes = probes.withColumn("rank__", F.pmod(F.xxhash64(uid, "try__", F.lit(seed)), F.lit(max(size, 1))).cast("int") + 1)
    fresh = materialize(probes.join(numbered, "rank__").select(uid, iid).distinct().join(seen, [uid, iid], "left_anti"), "probes")
    got = fresh.groupBy(uid).agg(F.count("*").alias("got__"))
    short = counts.join(got, uid, "left").filter(F.coalesce("got__", F.lit(0)) < F.col("wanted__")).select(uid)
    listed = short.crossJoin(F.broadcast(numbered.select(iid))) if size <= 100_000 else short.join(numbered.select(iid))
    found = fresh.join(short, uid, "left_anti").unionByName(listed.join(seen, [uid, iid], "left_anti"))
    w = Window.partitionBy(uid).orderBy(F.xxhash64(uid, iid, F.lit(seed)), iid)
    return found.withColumn("nth__", F.row_number().over(w)).filter(F.col("nth__") <= per_user).drop("nth__")


def all_negatives(users: DataFrame, items: DataFrame, known: DataFrame, uid: str = "uid", iid: str = "iid") -> DataFrame:
    """Every item that isn't known for a user; the answer is as large as users times items."""
    every = users.select(uid).distinct().crossJoin(items.select(iid).distinct())
    return every.join(known.select(uid, iid).distinct(), [uid, iid], "left_anti")


def with_features(df: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None, uid: str = "uid", iid: str = "iid") -> DataFrame:
    """User and item features beside each interaction."""
    if users is not None:
        df = df.join(users, uid, "left")
    return df.join(items, iid, "left") if items is not None else df


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """``name``: 1..n by the rank of the value among the distinct ones."""
    from truthframe.operators.fuzzy_logic import with_rank

    return df.join(with_rank(df.select(column).filter(F.col(column).isNotNull()).distinct(), column, name), column, "left")


def column_ranges(*frames: DataFrame) -> DataFrame:
    """``(column, lowest, highest)`` of every numeric column over all the frames."""
    names = list(dict.fromkeys(c for df in frames for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")))
    out = None
    for df in frames:
        mine = [c for c in names if c in df.columns]
        row = df.agg(*(F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in mine))
        row = row.select(F.explode(F.array(*mine)).alias("r")).select("r.*")
        out = row if out is None else out.unionByName(row)
    return out.groupBy("column").agg(F.min("low").alias("lowest"), F.max("high").alias("highest"))


def multi_hot_offsets(sizes: dict[str, int]) -> dict[str, int]:
    """Where each feature's values start in a row of all features' one-hot blocks."""
    out, at = {}, 0
    for name, n in sizes.items():
        out[name], at = at, at + n
    return out


def padded(history_col: Column, length: int) -> Column:
    """A history of fixed length, filled with 0 in front of what there is."""
    last = F.slice(history_col, F.greatest(F.size(history_col) - length + 1, F.lit(1)), length)
    return F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.lit(length) - F.size(last)), last.cast("array<bigint>"))


def sparse_signs(df: DataFrame, key: str, history_col: str) -> DataFrame:
    """``(key, item, sign)`` of each entry: +1, or -1 for items written as -iid."""
    e = df.select(key, F.explode(history_col).alias("v"))
    return e.select(key, F.abs("v").alias("item"), F.signum("v").cast("int").alias("sign"))
