"""Problem 4: splits that keep related records together, by component swap search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truthframe.operators.components import connected_components
from truthframe.session import map_arrow, materialize

#: A university's number after its several spellings: University7, univ-0007, UNIV_7, U7.
NUMBER = r"(?i)(?:university|univ|(?<![A-Za-z0-9])u)[ _-]*0*([0-9]+)"
#: Up to 2 * UNITS components are moved singly. Of more, those at or above a UNITS-th of all rows are, the others in UNITS bundles of whole components.
UNITS = 2048
#: Patterns whose shares are looked after one by one where no catalog names them; rarer ones count together.
LABELS = 256
OTHER = "OTHER"
CHAINS, STEPS = 12, 40_000
NO_CODE = ("", "none", "nan", "null")


def university_numbers(*texts: Column) -> Column:
    """The distinct university numbers named in the texts, without leading zeros; percent-encoded texts are decoded."""
    found = []
    for t in texts:
        plain = F.coalesce(F.try_url_decode(t), t)
        found.append(F.coalesce(F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(1)), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.transform(F.concat(*found), lambda x: x.cast("long"))))


def pattern_codes(pattern: Column) -> Column:
    """The codes named in ``injected_pattern``, upper-cased and sorted; ``["NONE"]`` for null and the spellings of none."""
    bare = F.regexp_replace(F.lower(F.trim(pattern)), r"\(.*|<-.*|@.*", "")
    codes = F.transform(F.split(bare, "[,;+|/ ]+"), lambda x: F.upper(F.trim(x)))
    codes = F.array_sort(F.array_distinct(F.filter(codes, lambda x: ~F.lower(x).isin(*NO_CODE))))
    return F.when(F.coalesce(F.size(codes), F.lit(0)) > 0, codes).otherwise(F.array(F.lit("NONE")))


def related_groups(df: DataFrame, id_col: str, keys: Column, *keep: str) -> DataFrame:
    """``(row_id, group_key, *keep)`` for all rows: rows are tied if they share a key of the array ``keys``, ties carry over, and
    ``group_key`` is the smallest key of all rows tied to the row (null without any key).

    Components are sought among keys, of which only those that stand in one row with another make edges; rows
    join once, by their first key, and a key that very many rows hold is split by adaptive execution. Rows without a
    key are spread over the join under names that no key has.
    """
    rows = df.select(F.col(id_col).alias("row_id"), keys.alias("keys"), *keep)
    ties = (
        rows.filter(F.size("keys") > 1)
        .select(F.explode(F.transform(F.expr("slice(keys, 2, size(keys))"), lambda k: F.struct(F.element_at("keys", 1).alias("src"), k.alias("dst")))).alias("e"))
        .select("e.src", "e.dst")
        .distinct()
    )
    roots = connected_components(ties).select(F.col("node").cast("string").alias("at"), "component")
    key = F.try_element_at("keys", F.lit(1))
    at = F.coalesce(key.cast("string"), F.concat(F.lit("none "), F.pmod(F.xxhash64("row_id"), F.lit(4096)).cast("string")))
    return (
        rows.withColumns({"key": key, "at": at})
        .join(roots, "at", "left")
        .select("row_id", F.coalesce("component", "key").alias("group_key"), *keep)
    )


def deviation(counts: np.ndarray, shares: np.ndarray) -> float:
    """How far counts (splits x labels, label 0 for all rows) are from ``shares``: the squared error of each label's shares, weighted by its part of the rows; all rows weigh as much as the labels together."""
    total = counts.sum(axis=0)
    error = (counts / np.maximum(total, 1) - shares[:, None]) ** 2
    weight = total / max(total[1:].sum(), 1)
    weight[0] = 1
    return float((error.sum(axis=0) * weight).sum())


def anneal(units: np.ndarray, start: np.ndarray, shares: np.ndarray, steps: int, seed: int) -> tuple[float, np.ndarray]:
    """The best assignment that moves and swaps of whole units reach from ``start``; units: unit x label counts."""
    rng = np.random.default_rng(seed)
    now = start.copy()
    counts = np.zeros((len(shares), units.shape[1]))
    np.add.at(counts, now, units)
    energy = deviation(counts, shares)
    best, best_at = energy, now.copy()
    if len(units) < 1 or len(shares) < 2:
        return best, best_at
    heat, cool = max(energy, 1e-6) / 10, 1e-9
    picks = rng.integers(0, len(units), (steps, 2))
    kinds, luck, targets = rng.random(steps), rng.random(steps), rng.integers(0, len(shares), steps)
    for step in range(steps):
        temperature = heat * (cool / heat) ** (step / steps)
        a, b = picks[step]
        if kinds[step] < 0.5:
            old, new = now[a], targets[step]
            if old == new:
                continue
            change = units[a]
        else:
            old, new = now[a], now[b]
            if old == new:
                continue
            change = units[a] - units[b]
        counts[old] -= change
        counts[new] += change
        then = deviation(counts, shares)
        if then <= energy or luck[step] < np.exp((energy - then) / temperature):
            energy = then
            if kinds[step] < 0.5:
                now[a] = new
            else:
                now[a], now[b] = new, old
            if energy < best - 1e-15:
                best, best_at = energy, now.copy()
        else:
            counts[old] += change
            counts[new] -= change
    return best, best_at


def related_splits(
    df: DataFrame,
    targets: DataFrame,
    id_col: str = "row_id",
    name_col: str = "file_name",
    pattern_col: str = "injected_pattern",
    seed: int = 7,
    chains: int = CHAINS,
    steps: int = STEPS,
    most_units: int = UNITS,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """``(row_id, group_key, split_name, codes)``: every row's split; rows tied by universities share one.

    Rows without a university number are groups of their own (``group_key`` null). From a hashed assignment,
    ``chains`` annealing runs in parallel move or exchange whole units to lessen the deviation from
    ``target_share``, over all rows and within each pattern; the best end wins. Units are components: all of them one
    by one up to ``2 * most_units``, else the large ones one by one and the small ones in bundles, so what a run is given
    has at most so many units. Patterns are those of ``catalog`` (its first column, codes; rows of a bounded table),
    without it the ``LABELS`` most frequent; what other codes there are counts as one pattern, "OTHER". A group that
    exceeds a split's share can't be cut; the rest makes up for it as far as possible. Targets that don't sum to 1 are
    scaled. Null patterns count as "NONE"; an empty table gives no rows. The result is the same for the same rows,
    targets and seed.
    """
    spark = df.sparkSession
    goal = sorted((r[0], float(r[1])) for r in targets.select("split_name", "target_share").filter("target_share > 0").collect())  # one row a split
    if not goal:
        raise ValueError("no target shares")
    names = [n for n, _ in goal]
    shares = np.array([s for _, s in goal]) / sum(s for _, s in goal)

    codes = df.withColumn("codes__", pattern_codes(F.col(pattern_col))).withColumn("keys__", university_numbers(F.col(name_col), F.col(pattern_col)))
    rows = materialize(related_groups(codes, id_col, F.col("keys__"), "codes__").withColumnRenamed("codes__", "codes"), "groups")
    own = F.coalesce(F.col("group_key").cast("string"), F.concat(F.lit("row "), F.col("row_id").cast("string")))
    rows = rows.withColumn("own", own)
    sizes = materialize(rows.groupBy("own").count(), "sizes")
    single = sizes
    if sizes.count() > 2 * most_units:
        total = sizes.agg(F.sum("count")).first()[0]
        single = sizes.filter(F.col("count") * most_units >= total)  # at most most_units
    single = spark.createDataFrame([(r[0], most_units + i) for i, r in enumerate(single.select("own").orderBy("own").collect())], "own string, single int")
    bundle = F.pmod(F.xxhash64("own", F.lit(seed)), F.lit(most_units)).cast("int")
    placed = rows.join(F.broadcast(single), "own", "left").withColumn("unit", F.coalesce("single", bundle))
    if catalog is not None:
        known = sorted({r[0].strip().upper() for r in catalog.select(catalog.columns[0]).distinct().collect() if r[0]} | {"NONE"})
    else:
        counted = rows.select(F.explode("codes").alias("code")).groupBy("code").count()
        known = sorted(r[0] for r in counted.orderBy(F.col("count").desc(), "code").limit(LABELS).collect())
    named = F.array_distinct(F.transform("codes", lambda c: F.when(c.isin(known), c).otherwise(OTHER)))
    table = placed.select("unit", F.explode(F.concat(F.array(F.lit("")), named)).alias("label")).groupBy("unit", "label").count().collect()  # units x known patterns

    unit_ids = sorted({r["unit"] for r in table})
    labels = sorted({r["label"] for r in table})  # the empty label, for all rows, is the first
    place, column = {u: i for i, u in enumerate(unit_ids)}, {x: i for i, x in enumerate(labels)}
    units = np.zeros((len(unit_ids), max(1, len(labels))))
    for r in table:
        units[place[r["unit"]], column[r["label"]]] = r["count"]
    hashed = np.searchsorted(np.cumsum(shares), np.random.default_rng(seed).random(len(unit_ids)), "right").clip(0, len(shares) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chain in b.column(0).to_pylist():
                best, at = anneal(units, hashed, shares, steps, seed * 1000 + chain)
                yield pa.RecordBatch.from_arrays([pa.array([best]), pa.array([chain]), pa.array([at.tolist()], pa.list_(pa.int32()))], names=["energy", "chain", "at"])

    if len(unit_ids):
        best = map_arrow(spark.range(0, chains, 1, chains), run, "energy double, chain long, at array<int>").orderBy("energy", "chain").first()["at"]
    else:
        best = []
    chosen = spark.createDataFrame([(u, names[s]) for u, s in zip(unit_ids, best)], "unit int, split_name string")
    return placed.join(F.broadcast(chosen), "unit").select("row_id", "group_key", "split_name", "codes")


def split_report(splits: DataFrame, targets: DataFrame) -> DataFrame:
    """``(code, split_name, rows, share, target_share)`` over all rows (code ``ALL``) and within each pattern."""
    per = splits.select("split_name", F.explode(F.concat(F.array(F.lit("ALL")), "codes")).alias("code")).groupBy("code", "split_name").agg(F.count("*").alias("rows"))
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy("code"))  # patterns x splits, small
    return per.withColumn("share", share).join(targets.select("split_name", "target_share"), "split_name", "left").select("code", "split_name", "rows", "share", "target_share")
