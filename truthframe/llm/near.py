"""Problem 6: near-duplicate records, by an LSH forest.

Each distinct content gets ``TREES`` independent signatures of ``DEPTH`` minhashes. The signatures of a tree are
sorted, so that contents sharing a prefix stand together, the longer the prefix the closer. A region is a run
with a common prefix; its depth adapts to its density: at most ``REGION`` contents are compared with each other,
a larger run is cut one minhash deeper, and of it only neighbours in order, those with the longest common prefixes,
are compared. Contents at similarity s agree in the first d minhashes of a tree with
probability s^d, so a pair at 0.8 is missed by all trees with probability 1e-14 at depth 1, 1e-9 at depth 2 and
6e-7 at depth 3. Deeper regions would miss more. Contents whose region is still too large at depth ``SURE`` are
therefore joined once more and exactly, by their rarest triples.

The sort is a range partitioning, so a dense region is spread over tasks along its deeper minhashes. Candidates
must pass two tests that no pair at the similarity fails (sizes; parities of 64 classes of triples) before their
triples are fetched and compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truthframe.llm.contents import contents, distinct_contents, mix
from truthframe.operators.components import connected_components
from truthframe.session import drop_written, map_arrow, materialize

TREES, DEPTH, REGION, NEIGHBOURS = 20, 5, 24, 4
#: Depth up to which the trees are relied on.
SURE = 3
#: First sizes of the classes of sizes: each size its own up to 64, then 2 % wide.
CLASSES = np.unique(np.concatenate((np.arange(1, 65), np.ceil(64 * 1.02 ** np.arange(1, 875))))).astype(np.int64)
#: A region that grows beyond this number of rows within one task is worked off in parts, which have its first row and their borders in common.
BUFFER = 200_000


def _odd(count: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def parity(tid: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One bit for each of 64 classes of identifiers: whether a set holds an odd number of the class."""
    bits = np.uint64(1) << (mix(tid + np.uint64(77)) >> np.uint64(58))
    return np.bitwise_xor.reduceat(bits, offsets[:-1]) if len(tid) else np.zeros(0, np.uint64)


def signatures(tid: np.ndarray, offsets: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` minhashes of 32 bits for each set, one row per set."""
    out = np.empty((len(offsets) - 1, count), ">u4")
    for i, m in enumerate(_odd(count, seed)):
        h = (tid ^ (m >> np.uint64(7))) * m
        out[:, i] = np.minimum.reduceat((h ^ (h >> np.uint64(29))) * m >> np.uint64(32), offsets[:-1])
    return out


def _forest(records: DataFrame) -> DataFrame:
    """``(sig, cid, n, parity)``, a row for each tree; ``sig`` begins with the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            lists = b.column(2)
            offsets = lists.offsets.to_numpy()
            tid = lists.values.to_numpy().view(np.uint64)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            sig = signatures(tid, offsets, TREES * DEPTH)
            par = pa.array(parity(tid, offsets).view(np.int64))
            width = 1 + 4 * DEPTH
            for t in range(TREES):
                rows = np.empty((len(sig), width), np.uint8)
                rows[:, 0] = t
                rows[:, 1:] = np.ascontiguousarray(sig[:, t * DEPTH : (t + 1) * DEPTH]).view(np.uint8).reshape(len(sig), -1)
                ends = pa.py_buffer(np.arange(len(sig) + 1, dtype=np.int32) * np.int32(width))
                keys = pa.Array.from_buffers(pa.binary(), len(sig), [None, ends, pa.py_buffer(rows.tobytes())])
                yield pa.RecordBatch.from_arrays([keys, b.column(0), b.column(1), par], names=["sig", "cid", "n", "parity"])

    return map_arrow(records.select("cid", "n", "triples"), run, "sig binary, cid long, n int, parity long")


def region_pairs(keys: np.ndarray, region: int = REGION, neighbours: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of candidate pairs in sorted rows of keys (the tree, then its minhashes), and which of them are spokes.

    All pairs of a region that is small enough; of a larger one, which is cut deeper, the rows that stand next to each
    other and part there. Rows that share a whole signature in too great a number are paired with the next
    ``neighbours`` rows, and as spokes with the first of them.
    """
    m, width = keys.shape
    nothing = np.zeros(0, np.int64)
    if m < 2:
        return nothing, nothing, nothing.astype(bool)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    hub = spoke = nothing
    common = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1)  # with the row before
    rows = np.arange(m)
    for depth in range(2, width + 1):
        # runs among the rows still in question; these are whole runs of the depth before
        starts = np.ones(len(rows), bool)
        starts[1:] = (np.diff(rows) != 1) | (common[rows[1:] - 1] < depth)
        run = np.cumsum(starts) - 1
        sizes = np.bincount(run)
        small = sizes[run] <= region
        at, of = rows[small], run[small]
        for k in range(1, int(sizes[sizes <= region].max(initial=1))):
            same = of[k:] == of[:-k]
            left.append(at[:-k][same]), right.append(at[k:][same])
        at, of = rows[~small], run[~small]
        if depth < width:
            parting = at[:-1][(of[1:] == of[:-1]) & (common[at[1:] - 1] == depth)] if len(at) else nothing
            left.append(parting), right.append(parting + 1)
        else:
            for k in range(1, min(neighbours, len(at) - 1) + 1):
                same = of[k:] == of[:-k]
                left.append(at[:-k][same]), right.append(at[k:][same])
            first = rows[np.nonzero(starts)[0]][of]
            hub, spoke = first[first != at], at[first != at]
        rows = at
        if len(rows) < 2:
            break
    count = sum(map(len, left))
    return np.concatenate([*left, hub]), np.concatenate([*right, spoke]), np.arange(count + len(hub)) >= count


def crowded(keys: np.ndarray, region: int = REGION) -> np.ndarray:
    """Places, in sorted rows of keys, of rows in regions of more than ``region`` rows at depth ``SURE``, and of the first and the last region, which may go on elsewhere."""
    if not len(keys):
        return np.zeros(0, np.int64)
    starts = np.ones(len(keys), bool)
    starts[1:] = (keys[1:, : 1 + SURE] != keys[:-1, : 1 + SURE]).any(axis=1)
    run = np.cumsum(starts) - 1
    large = np.bincount(run) > region
    large[[0, -1]] = True
    return np.nonzero(large[run])[0]


def _candidates(forest: DataFrame, p: int, q: int) -> DataFrame:
    """``(a, b, spoke)``: pairs of contents that a tree puts together and that may have the similarity p / q; with a = b, crowded contents."""

    def pairs(keys: np.ndarray, cid: np.ndarray, n: np.ndarray, par: np.ndarray) -> pa.RecordBatch:
        i, j, spoke = region_pairs(keys)
        ni, nj = n[i].astype(np.int64), n[j].astype(np.int64)
        must = -(-p * (ni + nj) // (p + q))  # triples that both must hold
        ok = (must <= np.minimum(ni, nj)) & (np.bitwise_count(par[i] ^ par[j]) <= ni + nj - 2 * must) & (cid[i] != cid[j])
        close = cid[crowded(keys)]
        a, b = np.concatenate((cid[i[ok]], close)), np.concatenate((cid[j[ok]], close))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), np.concatenate((spoke[ok], np.zeros(len(close), bool)))], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(both[:, 2] == 1)], names=["a", "b", "spoke"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        held = 0
        for b in batches:
            if not len(b):
                continue
            sig = b.column(0)
            at = np.frombuffer(sig.buffers()[1], np.int32)[sig.offset : sig.offset + len(sig) + 1]
            raw = np.frombuffer(sig.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(b), -1)
            keys = np.empty((len(b), 1 + DEPTH), np.uint32)
            keys[:, 0] = raw[:, 0]
            keys[:, 1:] = np.ascontiguousarray(raw[:, 1:]).view(">u4")
            kept.append((keys, b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy().view(np.uint64)))
            held += len(b)
            if held < 20_000:
                continue
            cols = [np.concatenate(c) for c in zip(*kept)]
            # work off all but the last region, whose end may be still to come
            breaks = np.nonzero((cols[0][1:, :2] != cols[0][:-1, :2]).any(axis=1))[0] + 1
            end = int(breaks[-1]) if len(breaks) else 0
            goes_on = np.arange(end, held)
            if len(goes_on) > BUFFER:
                # the run of the last whole signature goes on from its first row, its spokes' hub
                others = np.nonzero((cols[0][1:] != cols[0][:-1]).any(axis=1))[0] + 1
                hub = int(others[-1]) if len(others) else 0
                end, goes_on = held, np.unique(np.append(np.arange(held - NEIGHBOURS, held), hub))
            if end:
                yield pairs(*(c[:end] for c in cols))
            kept, held = [tuple(c[goes_on] for c in cols)], len(goes_on)
        if held:
            yield pairs(*(np.concatenate(c) for c in zip(*kept)))

    # equal signatures are spread over tasks by content; their rows are crowded ones
    ordered = forest.repartitionByRange("sig", "cid").sortWithinPartitions("sig", "cid")
    return map_arrow(ordered, run, "a long, b long, spoke boolean").groupBy("a", "b").agg(F.max("spoke").alias("spoke"))


def _postings(records: DataFrame) -> DataFrame:
    """``(cid, n, of, parity, triple)``: a row for each triple of ``(cid, n, of, triples)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            lists = b.column(3)
            offsets = lists.offsets.to_numpy()
            tid = lists.values.to_numpy().view(np.uint64)[offsets[0] : offsets[-1]]
            par = parity(tid, offsets - offsets[0]).view(np.int64)
            row = np.repeat(np.arange(len(b)), np.diff(offsets))
            cols = [b.column(i).to_numpy()[row] for i in range(3)] + [par[row], tid.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["cid", "n", "of", "parity", "triple"])

    return map_arrow(records.select("cid", "n", "of", "triples"), run, "cid long, n int, of long, parity long, triple long")


def _for_partners(places: DataFrame, p: int, q: int) -> DataFrame:
    """``(triple, small, large, own, ...)``: each place once for every class of sizes that a partner may have, if it still can be the first shared one.

    A pair of n and m triples at p / q shares at least ceil(p (n + m) / (p + q)), so the first one that it shares, in any
    common order, has at least as many from there on in both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda size: np.searchsorted(CLASSES, size, "right") - 1
        for b in batches:
            n, at = b.column(1).to_numpy().astype(np.int64), b.column(5).to_numpy().astype(np.int64)
            least = -(-p * n // q)
            low, high = of(least), of(q * n // p)
            many = high - low + 1
            row = np.repeat(np.arange(len(n)), many)
            other = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            must = -(-p * (n[row] + np.maximum(CLASSES[other], least[row])) // (p + q))
            ok = at[row] + must <= n[row]
            row, other = row[ok], other[ok]
            own = of(n)[row]
            sizes = [pa.array(c.astype(np.int32)) for c in (np.minimum(own, other), np.maximum(own, other), own)]
            yield pa.RecordBatch.from_arrays(sizes + [c.take(pa.array(row)) for c in b.columns], names=["small", "large", "own", *b.schema.names])

    return map_arrow(places.select("cid", "n", "of", "parity", "triple", "at"), run, "small int, large int, own int, cid long, n int, of long, parity long, triple long, at int")


def exact_pairs(records: DataFrame, p: int, q: int) -> DataFrame:
    """``(a, b)``: every pair of the contents ``(cid, n, of, triples)`` with different ``of`` that may have the similarity p / q.

    Triples are ordered by how many hold them, the rarest first, and contents meet at a triple that is early enough in
    both for the sizes of the two. What very many hold comes last, so it brings together only those that have little else.
    """
    t = materialize(_postings(records), "triples")
    held = t.groupBy("triple").agg(F.count("*").alias("held"))
    order = Window.partitionBy("cid").orderBy("held", "triple")  # within one content
    places = t.join(held, "triple").withColumn("at", F.row_number().over(order) - 1).filter((F.col("held") > 1) & (F.col("at") * q <= F.col("n") * (q - p)))
    rows = materialize(_for_partners(places, p, q), "places")
    key = ["triple", "small", "large"]
    mixed = rows.groupBy(*key).agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low < high").select(*key)
    rows = materialize(rows.join(mixed, key, "left_semi"), "mixed")
    must = f"(({p} * (x.n + y.n) + {p + q - 1}) div {p + q})"
    meet = " and ".join(f"x.{c} = y.{c}" for c in key)
    fits = f"x.at + {must} <= x.n and y.at + {must} <= y.n and bit_count(x.parity ^ y.parity) <= x.n + y.n - 2 * {must}"
    both = rows.alias("x").join(rows.alias("y"), F.expr(f"{meet} and x.cid < y.cid and x.of <> y.of and (x.small = x.large or x.own <> y.own) and {fits}"))
    return both.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()


def _verified(pairs: DataFrame, records: DataFrame, p: int, q: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose contents have the similarity p / q, by their triples."""
    one = records.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("triples").alias("ta"))
    two = records.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("triples").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "na", "nb", shared.alias("shared"))
    return both.filter(F.col("shared") * q >= (F.col("na") + F.col("nb") - F.col("shared")) * p).select("a", "b")


def near_components(records: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``(node, component)`` of the distinct contents ``(cid, n, triples)`` that are linked, directly or by way of others.

    Where very many contents are alike, the spokes to one of them are compared first. Other candidates within a group
    that these already join can't change it and aren't compared any more. Crowded contents, for which the trees may have
    missed a link, are then joined exactly, but for pairs that are in one group by now.
    """
    t = Fraction(similarity).limit_denominator(1000)
    p, q = t.numerator, t.denominator
    candidates = materialize(_candidates(_forest(records), p, q), "candidates")
    pairs = candidates.filter("a < b")
    links = None
    rest = pairs.select("a", "b")
    if pairs.filter("spoke").head(1):
        links = materialize(_verified(pairs.filter("spoke"), records, p, q), "links")
        joined = materialize(connected_components(links, "a", "b"), "joined")
        of = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        rest = pairs.filter("not spoke").join(of("a"), "a", "left").join(of("b"), "b", "left")
        rest = rest.filter(F.coalesce(F.col("of_a") != F.col("of_b"), F.lit(True)))
    found = _verified(rest, records, p, q)
    found = materialize(found if links is None else found.union(links), "found")
    parts = materialize(connected_components(found, "a", "b"), "parts")
    drop_written(found), drop_written(links)
    crowd = candidates.filter("a = b").select(F.col("a").alias("cid"))
    if not crowd.head(1):
        return parts
    of = parts.select(F.col("node").alias("cid"), F.col("component").alias("of"))
    dense = records.join(crowd, "cid", "left_semi").join(of, "cid", "left").select("cid", "n", F.coalesce("of", "cid").alias("of"), "triples")
    more = materialize(_verified(exact_pairs(dense, p, q), records, p, q), "more")
    if not more.head(1):
        return parts
    return connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "a", "b")


def near_groups(df: DataFrame, id_col: str = "row_id", body_col: str = "body", similarity: float = 0.8, least: int = 5) -> DataFrame:
    """``(first_row_id, row_id, copies)``: one row for each row that has a content.

    ``first_row_id`` is the smallest id of the row's group (contents linked at ``similarity`` or more, directly
    or by way of others) and ``copies`` the number of rows with the very same content. Rows without a content have
    no row, nor have rows without an id; repeated rows come out once, but count as copies.
    """
    rows, records = distinct_contents(materialize(contents(df, id_col, body_col, least), "contents"))
    parts = near_components(records, similarity)
    copies = rows.groupBy("cid").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = copies.join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "least", "copies", F.coalesce("component", "cid").alias("component"))
    first = classes.groupBy("component").agg(F.min("least").alias("first_row_id"))
    return (
        rows.select("id", "cid")
        .distinct()
        .join(classes.join(first, "component").select("cid", "copies", "first_row_id"), "cid")
        .select("first_row_id", F.col("id").alias("row_id"), "copies")
    )
