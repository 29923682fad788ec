"""Problem 9: long passages that stand in more than one document, by chained k-mer seeds.

1. Seeds. Of every ``length`` consecutive characters, the k-mer with the smallest hash is a seed, so two texts
   that share a run of ``length`` characters share a seed within it.
2. Join. A seed is shared if its smallest and largest document differ. Documents meet one partner per seed, that
   smallest document (the smallest itself meets the largest), so a seed in very many documents makes as many
   rows, not their square.
3. Chain. The matches of a document with a partner are chained in order of both texts; a chain's score is its
   seeds less a cost for the gaps, found with a Fenwick tree. Every match is in exactly one chain.
4. Align. Within the passages that chains span, widened by what a run may reach beyond its seed, every window of
   ``length`` characters is hashed and joined across all documents, not only the chain's partner. That gives
   the exact runs, whichever partner the chain had. Passages are the chains and, besides, those exact runs that no
   chain with the same partner holds.

Texts are compared as they stand, by code points and whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truthframe.llm.contents import mix
from truthframe.session import map_arrow, materialize

LENGTH, SEED = 200, 100
#: Cost of a character of gap in either text, against 1 for a character of seed.
GAP = 0.1
#: The filter that tells which seeds are shared has this many bits a seed, and no more bits than MOST_BITS in all; fuller filters let more through, never less.
SEED_BITS, MOST_BITS = 12, 1 << 28
#: Characters worked on at once, unless a single text is longer: few enough for their hashes to stay in a core's cache.
SLAB = 1 << 16
#: Windows handed on at once.
BATCH = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, below n."""
    global _powers
    if len(_powers[0]) < n:
        steps = [np.full(n, x, np.uint64) for x in (_BASE, _BACK)]
        for a in steps:
            a[0] = 1
        _powers = tuple(np.multiply.accumulate(a) for a in steps)
    return _powers[0][:n], _powers[1][:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit rolling hash of every k consecutive code points."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def _sliding(a: np.ndarray, w: int, best) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        a = best(a[:-span], a[span:])
        span *= 2
    return best(a[: len(a) - (w - span)], a[w - span :]) if span < w else a


def seeds(texts: list[str], length: int = LENGTH, k: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the text, position and hash of every seed, all ties of a window's smallest hash included.

    Of one hash at many positions on end, as in repetitive text, every ``(length - k) / 2``-th and the last are
    kept: a window that holds any of them holds one of those too.
    """
    out = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLAB):
            size += len(texts[end])
            end += 1
        slab = [(i, t) for i, t in enumerate(texts[at:end], at) if len(t) >= length]
        at = end
        if not slab:
            continue
        sizes = np.array([len(t) for _, t in slab])
        starts = np.concatenate(([0], np.cumsum(sizes)))
        h = grams(np.concatenate([code_points(t) for _, t in slab]), k)
        low = _sliding(h, length - k + 1, np.minimum)  # of the window that starts there
        doc = np.repeat(np.arange(len(slab)), sizes)
        inside = starts[doc[: len(low)] + 1] - np.arange(len(low)) >= length
        low = np.where(inside, low, np.uint64(0))
        pad = np.zeros(length - k, np.uint64)
        high = _sliding(np.concatenate((pad, low, pad)), length - k + 1, np.maximum)  # the largest such minimum over windows with the k-mer
        pos = np.nonzero(high == h)[0]
        fresh = np.ones(len(pos), bool)
        fresh[1:] = (np.diff(pos) != 1) | (h[pos[1:]] != h[pos[:-1]]) | (doc[pos[1:]] != doc[pos[:-1]])
        since = np.arange(len(pos)) - np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))
        pos = pos[(since % max(1, (length - k) // 2) == 0) | np.append(fresh[1:], True)]
        out.append((np.array([i for i, _ in slab])[doc[pos]], pos - starts[doc[pos]], h[pos]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def chain(x: np.ndarray, y: np.ndarray, k: int = SEED, gap: float = GAP) -> list[tuple[list[int], float]]:
    """Collinear chains of the matches (x, y): places in order, and the chain's score. Every match is in one chain.

    Among matches before one in both texts, the best predecessor maximises its score plus ``gap`` times its
    coordinates; a Fenwick tree over y keeps prefix maxima while x ascends.
    """
    order = np.lexsort((y, x))
    ranks = np.unique(y, return_inverse=True)[1] + 1
    size = int(ranks.max(initial=0))
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    score, before = np.zeros(len(x)), np.full(len(x), -1)
    waiting: deque[int] = deque()

    def enter(i: int) -> None:
        node, value = int(ranks[i]), (score[i] + gap * (x[i] + y[i]), i)
        while node <= size:
            if value > tree[node]:
                tree[node] = value
            node += node & -node

    for i in order:
        while waiting and x[waiting[0]] < x[i]:  # only matches strictly before in x
            enter(waiting.popleft())
        best, node = (-np.inf, -1), int(ranks[i]) - 1
        while node > 0:
            best = max(best, tree[node])
            node -= node & -node
        gain = best[0] - gap * (x[i] + y[i])
        score[i], before[i] = k + max(gain, 0.0), best[1] if gain > 0 else -1
        waiting.append(i)
    used = np.zeros(len(x), bool)
    chains = []
    for i in np.argsort(-score, kind="stable"):
        if used[i]:
            continue
        total, members, j = score[i], [], i
        while j >= 0 and not used[j]:
            used[j] = True
            members.append(int(j))
            j = before[j]
        chains.append((members[::-1], float(total - (score[j] if j >= 0 else 0.0))))
    return chains


def _texts(df: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= length))


def _all_seeds(texts: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, _, h = seeds(b.column(1).to_pylist(), length, k)
            doc = b.column(0).to_numpy()[at]
            once = np.unique(np.stack([h.view(np.int64), doc], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["seed", "doc"])

    return map_arrow(texts, run, "seed long, doc long")


def _filter(shared: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the shared seeds, two bits each; at most bits / 64 words reach the driver, whatever the data."""
    places = F.explode(F.array(F.pmod(F.col("seed"), F.lit(bits)), F.pmod(F.shiftright("seed", 30), F.lit(bits))))
    words = (
        shared.select(places.alias("place"))
        .groupBy(F.shiftright("place", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(words: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for place in (h.view(np.int64) % bits, (h.view(np.int64) >> 30) % bits):
        ok &= (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok


def _seeded(texts: DataFrame, shared: DataFrame, length: int, k: int, bits: int) -> DataFrame:
    """``(doc, text, seeds, places)``: documents with a seed that passes the filter, with those seeds."""
    words = texts.sparkSession.sparkContext.broadcast(_filter(shared, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, h = seeds(b.column(1).to_pylist(), length, k)
            ok = _passes(words.value, bits, h)
            at, pos, h = at[ok], pos[ok], h[ok]
            docs, starts = np.unique(at, return_index=True)  # texts stand in order
            ends = pa.array(np.concatenate((starts, [len(at)])), pa.int32())
            take = pa.array(docs)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(pos.astype(np.int32)))],
                names=["doc", "text", "seeds", "places"],
            )

    return map_arrow(texts, run, "doc long, text string, seeds array<long>, places array<int>")


def _chains(matches: DataFrame, k: int) -> DataFrame:
    """Chains of ``(doc, partner, x, y)``, each pair of documents worked on within one sorted run of rows."""
    names = ["doc", "partner", "x0", "x1", "y0", "y1", "seeds", "score"]

    def of(doc: int, partner: int, xy: np.ndarray) -> list[tuple]:
        out = []
        for members, score in chain(xy[:, 0], xy[:, 1], k):
            x, y = xy[members, 0], xy[members, 1]
            out.append((doc, partner, int(x[0]), int(x[-1]) + k, int(y[0]), int(y[-1]) + k, len(members), score))
        return out

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * 8
        types = [pa.int64(), pa.int64()] + [pa.int32()] * 5 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 4), np.int64)
        for b in batches:
            rows = np.concatenate((rest, np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)))
            breaks = np.nonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))[0] + 1
            whole, rest = np.split(rows, breaks)[:-1], rows[breaks[-1] if len(breaks) else 0 :]
            yield batch([c for g in whole for c in of(int(g[0, 0]), int(g[0, 1]), g[:, 2:])])
        if len(rest):
            yield batch(of(int(rest[0, 0]), int(rest[0, 1]), rest[:, 2:]))

    ordered = matches.select("doc", "partner", "x", "y").repartition("doc", "partner").sortWithinPartitions("doc", "partner", "x", "y")
    return map_arrow(ordered, run, "doc long, partner long, x0 int, x1 int, y0 int, y1 int, seeds int, score double")


def _windows(regions: DataFrame, length: int) -> DataFrame:
    """``(window, doc, place)`` for every window of ``length`` characters within the regions of ``(doc, text, spans)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, docs, places = [], [], []
            for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                h = grams(code_points(text), length)
                change = np.zeros(len(h) + 1, np.int64)
                for s in spans:
                    a, z = max(0, s["a"]), min(len(h), s["z"] - length + 1)
                    if a < z:
                        change[a] += 1
                        change[z] -= 1
                at = np.nonzero(np.cumsum(change[:-1]) > 0)[0]
                hashes.append(h[at]), docs.append(np.full(len(at), doc)), places.append(at.astype(np.int32))
                if sum(map(len, hashes)) > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ([x.view(np.int64) for x in hashes], docs, places)], names=["window", "doc", "place"])
                    hashes, docs, places = [], [], []
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ([x.view(np.int64) for x in hashes], docs, places)], names=["window", "doc", "place"])

    return map_arrow(regions.select("doc", "text", "spans"), run, "window long, doc long, place int")


class SharedSpans:
    """Passages of at least ``length`` characters that documents share.

    Documents with null ids, null texts or fewer than ``length`` characters share nothing. An id that comes twice
    counts as one document, and a run repeated only within it doesn't count. Empty tables give empty results,
    and other columns are ignored, whatever their names.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int | None = None, bits: int | None = None):
        self.length, self.k = length, k or max(1, length // 2)
        texts = _texts(df, id_col, text_col, length)
        held = _all_seeds(texts, length, self.k).groupBy("seed").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        self.shared = materialize(held.filter("low < high"), "seeds")
        if bits is None:
            bits = min(MOST_BITS, 1 << max(16, (SEED_BITS * self.shared.count()).bit_length()))
        self.docs = materialize(_seeded(texts, self.shared, length, self.k, bits), "texts")
        self.chained = self.regions = None

    def matches(self) -> DataFrame:
        """``(doc, partner, x, y)``: where a document and its partner hold the same seed."""
        at = self.docs.select("doc", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("doc", F.col("s.seeds").alias("seed"), F.col("s.places").alias("x"))
        mine = at.join(self.shared, "seed").withColumn("partner", F.when(F.col("doc") == F.col("low"), F.col("high")).otherwise(F.col("low")))
        ends = F.array(F.col("low"), F.col("high"))
        theirs = (
            at.join(self.shared, "seed").filter(F.array_contains(ends, F.col("doc"))).groupBy("seed", F.col("doc").alias("partner")).agg(F.min("x").alias("y"))
        )
        return mine.join(theirs, ["seed", "partner"]).select("doc", "partner", "x", "y")

    def chains(self) -> DataFrame:
        """``(doc, partner, x0, x1, y0, y1, seeds, score)``: the passages that chains span in either text."""
        if self.chained is None:
            self.chained = materialize(_chains(self.matches(), self.k), "chains")
        return self.chained

    def _passing(self) -> DataFrame:
        """``(window, doc, place)`` of the windows within reach of the chains."""
        if self.regions is None:
            reach = self.length - self.k
            spans = self.chains().groupBy("doc").agg(F.collect_list(F.struct((F.col("x0") - reach).alias("a"), (F.col("x1") + reach).alias("z"))).alias("spans"))
            self.regions = materialize(self.docs.select("doc", "text").join(spans, "doc"), "regions")  # spans of one text, no more than its seeds
        return _windows(self.regions, self.length)

    def _occurrences(self) -> DataFrame:
        windows = self._passing()
        held = windows.groupBy("window").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
        return windows.join(held, "window")

    def exact_runs(self) -> DataFrame:
        """``(doc, partner, x0, x1, y0, y1)``: consecutive windows that a document shares with one holder on one diagonal.

        The holder of a window is the document with the smallest id (for that one, with the largest), at its first place there.
        """
        windows = self._passing()
        # of the smallest and of the largest document, the first place
        ends = [F.min(F.struct("doc", "place")).alias("low"), F.max(F.struct("doc", (-F.col("place")).alias("place"))).alias("high")]
        held = windows.groupBy("window").agg(*ends).filter("low.doc < high.doc").select("window", "low.doc", "low.place", "high.doc", "high.place").toDF("window", "low", "at_low", "high", "at_high")
        first = F.col("doc") == F.col("low")
        partner, y = F.when(first, F.col("high")).otherwise(F.col("low")), F.when(first, -F.col("at_high")).otherwise(F.col("at_low"))
        places = windows.join(held, "window").select("doc", partner.alias("partner"), "place", (F.col("place") - y).alias("diagonal"))
        w = Window.partitionBy("doc", "partner", "diagonal").orderBy("place")  # within one text
        begins = F.when(F.col("place") - F.lag("place").over(w) <= 1, 0).otherwise(1)
        runs = places.withColumn("begins", begins).withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        runs = runs.groupBy("doc", "partner", "diagonal", "run").agg(F.min("place").alias("x0"), (F.max("place") + self.length).alias("x1"))
        return runs.select("doc", "partner", "x0", "x1", (F.col("x0") - F.col("diagonal")).alias("y0"), (F.col("x1") - F.col("diagonal")).alias("y1"))

    def documents(self) -> DataFrame:
        """``(doc_id)`` of the documents with a run that stands in another."""
        return self._occurrences().select(F.col("doc").alias("doc_id")).distinct()

    def characters(self) -> DataFrame:
        """``(doc_id, shared_chars)``: how many characters of a document lie in runs that stand in others."""
        rows = self._occurrences().select("doc", "place").distinct()
        after = F.lead("place").over(Window.partitionBy("doc").orderBy("place"))  # within one text
        return (
            rows.withColumn("new", F.least(F.lit(self.length), F.coalesce(after - F.col("place"), F.lit(self.length))))
            .groupBy(F.col("doc").alias("doc_id"))
            .agg(F.sum("new").alias("shared_chars"))
        )

    def passages(self) -> DataFrame:
        """``(doc_id, partner_id, start, end, partner_start, partner_end, matched, longest, score)``: chains aligned character by character, and exact runs.

        ``matched`` counts the equal characters of the alignment and ``longest`` its longest exact run. The ends are
        extended as far as the texts agree; within, only what lies between anchors is compared by character
        (``common_runs``). A partner's text joins each of its chains; a partner that very many share is split by
        adaptive execution. A chain has one partner per seed, which may share less than ``length``; so each exact run comes out too, with its
        holder (``exact_runs``) and its length as ``score``, unless a chain's passage with that holder contains it.
        """
        fuzzy = materialize(self._aligned(self.chains().select("doc", "partner", "x0", "x1", "y0", "y1", "score")), "passages")
        size = F.col("x1") - F.col("x0")
        runs = self.exact_runs().select("doc", "partner", "x0", "x1", "y0", "y1", size.alias("matched"), size.alias("longest"), size.cast("double").alias("score")).toDF(*fuzzy.columns).alias("r")
        within = "r.doc_id = c.doc_id and r.partner_id = c.partner_id and c.start <= r.start and r.end <= c.end and c.partner_start <= r.partner_start and r.partner_end <= c.partner_end"
        return fuzzy.unionByName(runs.join(fuzzy.alias("c"), F.expr(within), "left_anti"))

    def _aligned(self, spans: DataFrame) -> DataFrame:
        theirs = self.docs.select(F.col("doc").alias("partner"), F.col("text").alias("other"))
        both = spans.join(self.docs.select("doc", "text"), "doc").join(theirs, "partner")
        names = ["doc_id", "partner_id", "start", "end", "partner_start", "partner_end", "matched", "longest", "score"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    rows.append((r["doc"], r["partner"], *align(r["text"], r["other"], r["x0"], r["x1"], r["y0"], r["y1"]), r["score"]))
                cols = list(zip(*rows)) or [[]] * 9
                types = [pa.int64(), pa.int64()] + [pa.int32()] * 6 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        return map_arrow(
            both.select("doc", "partner", "x0", "x1", "y0", "y1", "score", "text", "other"), run, "doc_id long, partner_id long, start int, end int, partner_start int, partner_end int, matched int, longest int, score double"
        )


#: Lengths of the anchors of an alignment, long ones first, and the product of two gaps' lengths up to which all their characters are compared.
ANCHORS, COMPARED = (32, 8), 250_000


def anchors(one: np.ndarray, two: np.ndarray, k: int) -> np.ndarray:
    """Places (x, y) at which both texts hold the same k characters, found once in either, ascending in both: as many as possible."""
    (h1, first, n1), (h2, second, n2) = (np.unique(grams(c, k), return_index=True, return_counts=True) for c in (one, two))
    _, a, b = np.intersect1d(h1[n1 == 1], h2[n2 == 1], assume_unique=True, return_indices=True)
    x, y = first[n1 == 1][a], second[n2 == 1][b]
    order = np.argsort(x)
    x, y = x[order], y[order]
    # the longest ascending run of y: for each length the least end, and what came before
    ends: list[int] = []
    at: list[int] = []
    before = np.full(len(y), -1)
    for i, v in enumerate(y.tolist()):
        j = bisect_left(ends, v)
        before[i] = at[j - 1] if j else -1
        ends[j : j + 1], at[j : j + 1] = [v], [i]
    keep, i = [], at[-1] if at else -1
    while i >= 0:
        keep.append(i)
        i = before[i]
    return np.stack([x[keep[::-1]], y[keep[::-1]]], axis=1) if keep else np.zeros((0, 2), np.int64)


def common_runs(a: str, b: str, lengths: tuple[int, ...] = ANCHORS) -> list[int]:
    """Lengths of the equal runs of an alignment of two texts.

    Between anchors, which are widened to where the texts part, what is left is aligned by shorter anchors and in the end
    by all its characters, unless both gaps are so long that they would have had anchors had they been alike.
    """
    if not a or not b:
        return []
    if not lengths or len(a) * len(b) <= COMPARED:
        if len(a) * len(b) > COMPARED:
            return []
        return [m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    k, out, x0, y0 = lengths[0], [], 0, 0
    one, two = code_points(a), code_points(b)
    for x, y in anchors(one, two, k).tolist():
        if x < x0 or y < y0:  # within the run before
            continue
        back = min(x - x0, y - y0)
        parted = np.nonzero(one[x - back : x][::-1] != two[y - back : y][::-1])[0]
        back = int(parted[0]) if len(parted) else back
        reach = min(len(one) - x, len(two) - y)
        parted = np.nonzero(one[x : x + reach] != two[y : y + reach])[0]
        size = int(parted[0]) if len(parted) else reach
        out += common_runs(a[x0 : x - back], b[y0 : y - back], lengths[1:])
        out.append(back + size)
        x0, y0 = x + size, y + size
    return out + common_runs(a[x0:], b[y0:], lengths[1:])


def align(a: str, b: str, x0: int, x1: int, y0: int, y1: int) -> tuple[int, int, int, int, int, int]:
    """The passage widened to where the texts stop agreeing, its equal characters, and its longest exact run."""
    while x0 and y0 and a[x0 - 1] == b[y0 - 1]:
        x0, y0 = x0 - 1, y0 - 1
    while x1 < len(a) and y1 < len(b) and a[x1] == b[y1]:
        x1, y1 = x1 + 1, y1 + 1
    one, two = a[x0:x1], b[y0:y1]
    runs = [len(one)] if one == two else common_runs(one, two)
    return x0, x1, y0, y1, sum(runs), max(runs, default=0)
