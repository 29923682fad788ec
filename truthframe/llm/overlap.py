"""Problem 2: the same or nearly the same records across splits, by content-defined chunks.

A normalised record is its triples' identifiers in ascending order. A rolling hash over a window of ``w`` triples
cuts it where the hash ends in ``b`` zero bits, so an edit alters only the chunk it falls into and, if it was a
landmark, the next. Two records at a similarity of 0.8 may differ in every ninth triple on both sides. Of n triples
0.2 n may be gone, each spoiling two chunks, so with chunks of c triples on average only n / c - 0.4 n are sure to be
shared: none beyond c = 2.5, and 0.4 n + 1 of them must be looked up instead of the 0.2 n + 1 that do for c = 1.
Records of every size are therefore cut with w = 1 and b = 0, after each triple, where ceil(0.8 n) of n chunks are
surely shared. A chunk's digest is then its triple's identifier and its length 1.

Not all shared chunks are joined: of a record with k chunks, of which s must be shared, only the k - s + 1 that
the other side holds most rarely are looked up (any s shared ones must include one of them). Chunks that very
many records hold are so looked up only by records that have nothing rarer.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truthframe.llm.contents import contents, distinct_contents
from truthframe.session import materialize


def _chunks(records: DataFrame) -> DataFrame:
    """``(cid, n, digest)``: the chunks of ``(cid, n, triples)``, each of length 1."""
    return records.select("cid", "n", F.explode("triples").alias("digest"))


def class_pairs(ours: DataFrame, theirs: DataFrame, p: int, q: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs ``(cid, other, n, other_n, shared)`` of distinct contents at the similarity p / q, and the rows of either side with their ``cid``.

    ``cid`` is of ``theirs``, whose chunks are looked up, ``other`` of ``ours``; ``shared`` sums up the lengths of the chunks that both hold.
    """
    theirs, a = distinct_contents(theirs)
    ours, b = distinct_contents(ours)
    postings = _chunks(b).select("digest", F.col("cid").alias("other"), F.col("n").alias("other_n"))
    held = postings.groupBy("digest").agg(F.count("*").alias("held"))
    must = F.expr(f"({p} * n + {q - 1}) div {q}")  # of n chunks
    rank = F.row_number().over(Window.partitionBy("cid").orderBy(F.coalesce("held", F.lit(0)), "digest"))
    looked_up = (
        _chunks(a)
        .join(held, "digest", "left")
        .withColumn("rank", rank)
        .filter((F.col("rank") <= F.col("n") - must + 1) & F.col("held").isNotNull())
        .select("digest", "cid", "n")
    )
    fits = (F.col("other_n") * q >= F.col("n") * p) & (F.col("n") * q >= F.col("other_n") * p)
    pairs = looked_up.join(postings, "digest").filter(fits).select("cid", "other").distinct()
    both = (
        pairs.join(a, "cid")
        .join(b.select(F.col("cid").alias("other"), F.col("n").alias("other_n"), F.col("triples").alias("other_triples")), "other")
        .withColumn("shared", F.size(F.array_intersect("triples", "other_triples")))  # chunks of length 1, so their number is the sum of lengths
        .filter(F.col("shared") * q >= (F.col("n") + F.col("other_n") - F.col("shared")) * p)
        .select("cid", "other", "n", "other_n", "shared")
    )
    return both, ours, theirs


def _fractions() -> list:
    """Similarity, and the shared length as a fraction of the other side's record and of ours."""
    n, other_n, shared = F.col("n"), F.col("other_n"), F.col("shared")
    return [(shared / (n + other_n - shared)).alias("similarity"), (shared / n).alias("overlap"), (shared / other_n).alias("train_overlap")]


def _sides(train: DataFrame, other: DataFrame, id_col: str, body_col: str, least: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = Fraction(similarity).limit_denominator(1000)
    found = [materialize(contents(df, id_col, body_col, least), name) for df, name in ((train, "train"), (other, "other"))]
    return class_pairs(*found, t.numerator, t.denominator)


def overlap_classes(
    train: DataFrame, other: DataFrame, split_col: str = "split_name", id_col: str = "row_id", body_col: str = "body", similarity: float = 0.8, least: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes and their members, without a row for each pair of copies.

    A class is the rows of one side with the very same content, named by its smallest id. Pairs are
    ``(train_class, class, train_copies, copies, shared, similarity, overlap, train_overlap)``, members ``(class, row_id, split_name)``
    of the other side. Each class with any overlap has a row in each; nulls and empty tables are as in ``cross_overlaps``.
    """
    both, ours, theirs = _sides(train, other, id_col, body_col, least, similarity)
    of = lambda rows, key, name, copies: rows.groupBy(F.col("cid").alias(key)).agg(F.min("id").alias(name), F.countDistinct("id").alias(copies))
    mine, others = of(ours, "other", "train_class", "train_copies"), of(theirs, "cid", "class", "copies")
    pairs = materialize(both.join(mine, "other").join(others, "cid"), "classes")
    splits = other.select(F.col(id_col).cast("long").alias("id"), F.col(split_col).alias("split_name"))
    met = pairs.select("class", "cid").distinct()
    members = theirs.select("id", "cid").join(met, "cid").join(splits, "id").select("class", F.col("id").alias("row_id"), "split_name").distinct()
    return pairs.select("train_class", "class", "train_copies", "copies", "shared", *_fractions()), members


def cross_overlaps(
    train: DataFrame, other: DataFrame, split_col: str = "split_name", id_col: str = "row_id", body_col: str = "body", similarity: float = 0.8, least: int = 5
) -> DataFrame:
    """``(train_row_id, row_id, split_name, shared, similarity, overlap, train_overlap)`` for each pair at ``similarity`` or more.

    ``other`` holds the rows of all evaluation splits and names the split in ``split_col``. ``shared`` is the
    length of what both records hold in triples, ``overlap`` and ``train_overlap`` its share of either record.
    Equal contents are compared once and expanded at the end. A null split name is kept as it is. Rows without
    a content are in no pair, empty tables give no pairs, and repeated rows no repeated pairs.
    """
    both, ours, theirs = _sides(train, other, id_col, body_col, least, similarity)
    splits = other.select(F.col(id_col).cast("long").alias("id"), F.col(split_col).alias("split_name")).distinct()
    return (
        both.join(theirs.select(F.col("id").alias("row_id"), "cid"), "cid")
        .join(ours.select(F.col("id").alias("train_row_id"), F.col("cid").alias("other")), "other")
        .join(splits.withColumnRenamed("id", "row_id"), "row_id")
        .select("train_row_id", "row_id", "split_name", "shared", *_fractions())
        .distinct()
    )
