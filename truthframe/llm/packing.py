"""Problem 7: filling containers of fixed capacity with texts, by large-item matching.

How items are packed depends on their sizes alone, so the packing is worked out on the histogram of sizes, which
has at most ``capacity`` entries however many items there are, and yields patterns (sizes in one bin) with the
number of bins of each. Items above a third of the capacity are matched: at most two of them fit a bin, and the
largest takes the largest that still fits. Smaller items, in descending order, go to the bin with the smallest
gap that holds them (best fit), whole groups of equal bins at a time. Then every item takes the place that its
rank among the items of its size gives it; ranks are counted within hashed groups of some ``GROUP`` items, as many as a
size needs, so a size that very many items have is never sorted by one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truthframe.llm.tokens import VOCABULARY, pieces
from truthframe.session import map_arrow, materialize

CAPACITY, GROUP = 1024, 50_000

Pattern = tuple[tuple[int, int], ...]


def _matched(large: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Bins of one or two large items: from the largest down, each with the largest other that fits."""
    left = {s: n for s, n in large.items() if n}
    sizes = sorted(left)
    out: list[tuple[Pattern, int]] = []
    while sizes:
        a = sizes[-1]
        at = bisect_left(sizes, capacity - a + 1) - 1  # the largest that fits beside it
        if at == len(sizes) - 1 and left[a] == 1:  # that is the item itself
            at -= 1
        if at < 0:
            out.append((((a, 1),), left[a]))
            used = {a: left[a]}
        elif sizes[at] == a:
            out.append((((a, 2),), left[a] // 2))
            used = {a: left[a] // 2 * 2}
        else:
            k = min(left[a], left[sizes[at]])
            out.append((((a, 1), (sizes[at], 1)), k))
            used = {a: k, sizes[at]: k}
        for s, n in used.items():
            left[s] -= n
            if not left[s]:
                sizes.remove(s)
    return out


def pack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """``(pattern, bins)``: ((size, times), ...) of one bin, and how many bins look like that."""
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("sizes must lie between 1 and the capacity")
    gaps: dict[int, list[list]] = {}
    order: list[int] = []

    def put(pattern: Pattern, bins: int) -> None:
        gap = capacity - sum(s * n for s, n in pattern)
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        for same in gaps[gap]:
            if same[0] == pattern:
                same[1] += bins
                return
        gaps[gap].append([pattern, bins])

    for pattern, bins in _matched({s: n for s, n in histogram.items() if 3 * s > capacity}, capacity):
        put(pattern, bins)
    for s in sorted((s for s, n in histogram.items() if 3 * s <= capacity and n), reverse=True):
        left = histogram[s]
        while left:
            at = bisect_left(order, s)
            if at == len(order):  # no gap holds it: new bins
                full, rest = divmod(left, capacity // s)
                if full:
                    put(((s, capacity // s),), full)
                if rest:
                    put(((s, rest),), 1)
                break
            gap = order[at]
            pattern, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            times = gap // s  # the bin stays the best fit until it is full
            full = min(bins, left // times)
            if full:
                put((*pattern, (s, times)), full)
                left -= full * times
            if full < bins and left:  # fewer left than one more bin takes
                put((*pattern, (s, left)), 1)
                full, left = full + 1, 0
            if full < bins:
                put(pattern, bins - full)
    return [(p, n) for gap in sorted(gaps) for p, n in gaps[gap]]


def _places(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (size, first rank, first bin, times): which bins the items of a size go to, in order of rank."""
    rows, first, rank = [], 0, {}
    for pattern, bins in patterns:
        for size, times in pattern:
            rows.append((size, rank.get(size, 0), first, times))
            rank[size] = rank.get(size, 0) + bins * times
        first += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def fill_containers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """``(bin_id, doc_id, piece, first_char, n_chars, n_tokens)``: the container of every text, or of each piece of an oversized one.

    A text of more than ``capacity`` tokens is cut into pieces that fill containers, and only its rest is packed
    with others; no other text is cut. Bins are numbered from 0 without gaps and hold at most ``capacity`` tokens.
    Null and empty texts have no tokens and are in no container; a repeated row is packed each time, a null id is
    kept, and other columns are ignored. An empty table gives no rows.
    """
    spark = df.sparkSession
    items = materialize(pieces(df, id_col, text_col, capacity, vocabulary), "pieces")
    sizes = items.groupBy("n_tokens").agg(F.count("*").alias("items")).collect()  # at most a row for each size up to the capacity
    places = _places(pack({int(s): int(n) for s, n in sizes}, capacity))
    salts = spark.createDataFrame([(int(s), -(-int(n) // group)) for s, n in sizes], "n_tokens int, salts long")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")).cast("int")
    items = items.join(F.broadcast(salts), "n_tokens").select("doc_id", "piece", "first_char", "n_chars", "n_tokens", salt.alias("salt"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # over a size's groups
    groups = items.groupBy("n_tokens", "salt").agg(F.count("*").alias("size")).select("n_tokens", "salt", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    keys = (places[:, 0] << 44) + places[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(4).to_numpy().astype(np.int64), b.column(5).to_numpy() - 1
            at = np.searchsorted(keys, (size << 44) + rank, "right") - 1
            bins = places[at, 2] + (rank - places[at, 1]) // places[at, 3]
            yield pa.RecordBatch.from_arrays([pa.array(bins), *(b.column(i) for i in range(5))], names=["bin_id", "doc_id", "piece", "first_char", "n_chars", "n_tokens"])

    nth = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece"))
    ranked = items.withColumn("nth", nth).join(groups, ["n_tokens", "salt"])
    ranked = ranked.select("doc_id", "piece", "first_char", "n_chars", "n_tokens", (F.col("before") + F.col("nth")).alias("rank"))
    return map_arrow(ranked, run, "bin_id long, doc_id long, piece int, first_char int, n_chars int, n_tokens int")


def fill_report(bins: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: bins, items and tokens, the least number of bins that any packing needs, and the share of room used."""
    total = bins.agg(F.max("bin_id").alias("last"), F.count("*").alias("items"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return total.select(
        F.coalesce(F.col("last") + 1, F.lit(0)).alias("bins"),
        "items",
        "tokens",
        F.ceil(F.col("tokens") / capacity).alias("least_bins"),
        (F.col("tokens") / ((F.col("last") + 1) * capacity)).alias("filled"),
    )
