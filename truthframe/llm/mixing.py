"""Problem 8: mixing sources to target weights, by min-cost flow over membership patterns.

The same text can stand in several sources. Distinct texts are therefore grouped by their membership pattern, the
set of targeted sources that hold them, and only the patterns' token sums (at most 2^sources rows) go to the
driver. There tokens flow from patterns to the quotas of their sources. Using a pattern's texts for the r-th
time costs r - 1 a token, a convex cost, so repetition is spread as evenly as the quotas allow; since the cost
depends on the repetition alone, the cheapest flow is found by ordinary maximum flows, admitting one more
repetition at a time. The flow is turned into draws by laying a pattern's texts out in seeded order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truthframe.llm.tokens import VOCABULARY, tokenizer
from truthframe.session import map_arrow, materialize

#: Texts that one task lays out in order; a pattern is hashed into as many parts as it needs.
PART = 50_000


def source_name(c: Column) -> Column:
    """Lower case, with runs of blanks, ``-`` and ``_`` as one ``_``."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


class Flow:
    """Maximum flow by shortest augmenting levels; capacities may be raised between calls."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for node, other, r in ((a, b, room), (b, a, 0)):
            self.arcs[node].append(len(self.to))
            self.to.append(other)
            self.room.append(r)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            level = [-1] * len(self.arcs)
            level[source] = 0
            queue = deque([source])
            while queue:
                a = queue.popleft()
                for e in self.arcs[a]:
                    if self.room[e] > 0 and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if level[sink] < 0:
                return total
            at = [0] * len(self.arcs)
            while pushed := self._push(source, sink, level, at):
                total += pushed

    def _push(self, source: int, sink: int, level: list[int], at: list[int]) -> int:
        path: list[int] = []
        node = source
        while node != sink:
            if at[node] < len(self.arcs[node]):
                e = self.arcs[node][at[node]]
                if self.room[e] > 0 and level[self.to[e]] == level[node] + 1:
                    path.append(e)
                    node = self.to[e]
                else:
                    at[node] += 1
            elif path:
                e = path.pop()
                node = self.to[e ^ 1]
                at[node] += 1
            else:
                return 0
        least = min(self.room[e] for e in path)
        for e in path:
            self.room[e] -= least
            self.room[e ^ 1] += least
        return least


def route(patterns: dict[int, int], quotas: list[int], repeats: list[int]) -> tuple[dict[tuple[int, int], int], int]:
    """The cheapest largest flow, {(pattern, source): tokens}, and its total.

    patterns: {set of sources as bits: tokens}; a source takes a pattern's texts at most ``repeats`` times.
    """
    masks = sorted(patterns)
    n, m = len(masks), len(quotas)
    net = Flow(n + m + 2)
    source, sink = n + m, n + m + 1
    supply = [net.arc(source, i, 0) for i in range(n)]
    use = {(mask, s): net.arc(i, n + s, patterns[mask] * repeats[s]) for i, mask in enumerate(masks) for s in range(m) if mask >> s & 1}
    for s, q in enumerate(quotas):
        net.arc(n + s, sink, q)
    total = 0
    # overlapping sources add up: a text may serve each of them
    for _ in range(sum(repeats)):
        for i, mask in enumerate(masks):
            net.room[supply[i]] += patterns[mask]
        total += net.run(source, sink)
        if total >= sum(quotas):
            break
    return {k: net.room[e ^ 1] for k, e in use.items() if net.room[e ^ 1]}, total


def plan(patterns: dict[int, int], shares: list[float], repeats: list[int], total: int | None = None) -> tuple[dict[tuple[int, int], int], list[float]]:
    """The flow, and the shares wanted of it: those of sources with texts, scaled to 1.

    Without ``total``, as many tokens as all these sources can give in their shares.
    """
    there = [any(mask >> s & 1 and n for mask, n in patterns.items()) and repeats[s] > 0 and shares[s] > 0 for s in range(len(shares))]
    whole = sum(x for x, ok in zip(shares, there) if ok)
    wanted = [x / whole if ok else 0.0 for x, ok in zip(shares, there)]
    if not whole:
        return {}, wanted
    quota = lambda t: [int(w * t) for w in wanted]
    if total is None:
        low, high = 0, sum(patterns.values()) * max(repeats) * len(shares)
        while low < high:
            mid = (low + high + 1) // 2
            if route(patterns, quota(mid), repeats)[1] == sum(quota(mid)):
                low = mid
            else:
                high = mid - 1
        total = low
    return route(patterns, quota(total), repeats)[0], wanted


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(vocabulary)
        for b in batches:
            texts = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([len(enc.encode_ordinary(t)) for t in texts], pa.int32())],
                names=["doc_id", "source", "text_hash", "n_tokens"],
            )

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), source_name(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    return map_arrow(picked.filter("source is not null and length(text) > 0"), run, "doc_id long, source string, text_hash binary, n_tokens int")


class Mixture:
    """Texts drawn so that each source of ``targets`` (source, target_share, max_repeats) has its share of all tokens drawn.

    Source names are compared in one spelling (``source_name``); texts whose source is null or not targeted are not
    drawn, nor are null and empty ones. The very same text is one text however often it stands in the table, with
    the smallest of its ids. A source draws a text at most ``max_repeats`` times. Sources without any text can't
    have a share; those of the others are scaled to 1 and then held to within one text for each pattern. Without ``total_tokens``, as many
    tokens are drawn as the scarcest source allows; with more than that, scarce sources stay behind and the
    report shows by how much. At most 62 sources; a source named twice keeps its first row by name, share and repeats.
    The same rows, targets and seed give the same draws.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_tokens: int | None = None, seed: int = 11, vocabulary: str = VOCABULARY):
        spark = df.sparkSession
        rows = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).filter("source is not null").collect()  # one row a source
        self.targets = [next(r for r in sorted(rows) if r[0] == s) for s in sorted({r[0] for r in rows})]
        if len(self.targets) > 62:
            raise ValueError("more than 62 sources")
        names = [r[0] for r in self.targets]
        bit = spark.createDataFrame([(s, 1 << i) for i, s in enumerate(names)], "source string, bit long")
        sizes = _sizes(df, id_col, text_col, source_col, vocabulary).join(F.broadcast(bit), "source")  # one row a source
        self.units = materialize(
            sizes.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.bit_or("bit").alias("pattern")).withColumn("order", F.xxhash64("text_hash", F.lit(seed))),
            "texts",
        )
        sums = self.units.groupBy("pattern").agg(F.sum("n_tokens"), F.count("*")).collect()  # at most one row a pattern
        held, self.parts = {r[0]: int(r[1]) for r in sums}, {r[0]: -(-int(r[2]) // PART) for r in sums}
        self.held = {p: n for p, n in held.items() if n > 0}
        self.flow, self.wanted = plan(self.held, [max(0.0, r[1] or 0.0) for r in self.targets], [max(0, r[2] or 0) for r in self.targets], total_tokens)

    def draws(self) -> DataFrame:
        """``(doc_id, source, copy, n_tokens)``: every use of a text, the uses of one source numbered from 0.

        A pattern's texts, in seeded order, are laid out on a ring of its tokens; its sources take one stretch after
        the other, going round as often as need be. A stretch no longer than r rings meets a text at most r times.
        """
        spark = self.units.sparkSession
        stretches, at = [], {}
        for (mask, s), tokens in sorted(self.flow.items()):
            a = at.get(mask, 0)
            stretches.append((mask, self.targets[s][0], self.held[mask], a, a + tokens))
            at[mask] = a + tokens
        taken = spark.createDataFrame(stretches, "pattern long, source string, ring long, a long, z long")
        parts = spark.createDataFrame(sorted(self.parts.items()), "pattern long, parts long")
        units = self.units.join(F.broadcast(parts), "pattern").withColumn("bucket", F.pmod(F.shiftright("order", 20), F.col("parts")).cast("int"))  # one row a pattern
        sums = units.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("tokens"))
        before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        sums = sums.select("pattern", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("pattern", "bucket").orderBy("order", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
        placed = units.withColumn("x", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, ["pattern", "bucket"]).withColumn("x", F.col("x") + F.col("base"))
        # rounds e with a <= e * ring + x < z
        first, last = F.expr("(a - x + ring - 1) div ring"), F.expr("(z - x + ring - 1) div ring - 1")
        return (
            placed.join(F.broadcast(taken), "pattern")
            .withColumn("first", F.greatest(F.lit(0), F.when(F.col("a") > F.col("x"), first).otherwise(0)))
            .withColumn("last", F.when(F.col("z") > F.col("x"), last).otherwise(-1))
            .filter("last >= first")
            .select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), (F.col("last") - F.col("first")).cast("int"))).alias("copy"))
            .select("doc_id", "source", "copy", "n_tokens")
        )

    def report(self) -> DataFrame:
        """``(source, target_share, wanted_share, reached_share, max_repeats, tokens, draws, texts, most_repeats)`` for each target."""
        spark = self.units.sparkSession
        goals = spark.createDataFrame([(r[0], r[1], w, r[2]) for r, w in zip(self.targets, self.wanted)], "source string, target_share double, wanted_share double, max_repeats int")
        got = self.draws().groupBy("source").agg(
            F.sum("n_tokens").alias("tokens"), F.count("*").alias("draws"), F.sum(F.when(F.col("copy") == 0, 1).otherwise(0)).alias("texts"), (F.max("copy") + 1).alias("most_repeats")
        )
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        share = F.coalesce(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), F.lit(0.0))  # a row a source
        return goals.join(got, "source", "left").select("source", "target_share", "wanted_share", share.alias("reached_share"), "max_repeats", *map(zero, ("tokens", "draws", "texts", "most_repeats")))
