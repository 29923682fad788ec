"""The registered queries over the training-data tables; ``sql`` has the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truthframe.llm.formatting import formatting_groups, formatting_members
from truthframe.llm.mixing import Mixture
from truthframe.llm.near import near_groups
from truthframe.llm.overlap import cross_overlaps, overlap_classes
from truthframe.llm.packing import fill_containers, fill_report
from truthframe.llm.related import related_groups, related_splits, split_report, university_numbers
from truthframe.llm.spans import SharedSpans
from truthframe.llm.splitting import TOKEN, split_oversized
from truthframe.llm.sql import ORACLES as ORACLES
from truthframe.llm.terms import marked_terms
from truthframe.session import table


def _train(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_data")


def _evaluation(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, f"{s}_data").withColumn("split_name", F.lit(s)) for s in ("eval", "test")]
    return parts[0].unionByName(parts[1])


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return related_splits(_train(spark, d), table(spark, d, "split_targets"), catalog=table(spark, d, "pattern_catalog").select("pattern_code"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_train(spark, d)).filter("piece = 0").select("row_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_train(spark, d))


def p1_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized body put together again from its pieces, and whether these keep to the limit and the overlap."""
    pieces = split_oversized(_train(spark, d))
    head = F.concat(F.lit(rf"^(?:(?:{TOKEN})[ \t\n\r]*){{"), "overlap_tokens", F.lit("}"))
    new = F.when(F.col("overlap_tokens") > 0, F.regexp_replace("text", head, F.lit(""))).otherwise(F.col("text"))
    own = F.col("n_tokens") - F.col("overlap_tokens")
    fits = (F.col("n_tokens") <= 1024) & (F.col("overlap_tokens") == F.least(F.lit(64), F.col("first_token") + F.col("overlap_tokens")))  # a shorter piece is repeated whole
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", new.alias("new")))), lambda x: x["new"]), "")  # the pieces of one body
    return pieces.groupBy("row_id").agg(F.sum(own).alias("n_tokens"), F.md5(whole).alias("body_md5"), F.bool_and(fits).alias("within"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_overlaps(_train(spark, d), _evaluation(spark, d)).select("train_row_id", "row_id", "split_name")


def p2_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return cross_overlaps(_train(spark, d), _evaluation(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs and evaluation rows per split and university named in the evaluation row's file name (null: none named)."""
    rows = _evaluation(spark, d)
    named = rows.select("row_id", F.explode_outer(university_numbers(F.col("file_name"))).alias("university"))
    pairs = cross_overlaps(_train(spark, d), rows).join(named, "row_id")
    return pairs.groupBy("split_name", "university").agg(F.count("*").alias("pairs"), F.countDistinct("row_id").alias("rows"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs of classes of equal content, by the smallest id of each, with the number of copies."""
    return overlap_classes(_train(spark, d), _evaluation(spark, d))[0]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return marked_terms(_train(spark, d)).filter("mark is not null").select("term", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return marked_terms(_train(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    groups = related_groups(_train(spark, d), "row_id", university_numbers(F.col("file_name"), F.col("injected_pattern")))
    return groups.filter("group_key is not null").distinct()


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d).select("row_id", "group_key", "split_name")


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each group of tied rows, and the number of splits that they are in."""
    groups = _splits(spark, d).filter("group_key is not null").groupBy("group_key")
    return groups.agg(F.count("*").alias("rows"), F.countDistinct("split_name").cast("int").alias("splits"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return split_report(_splits(spark, d), table(spark, d, "split_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting_members(_train(spark, d))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return formatting_groups(_train(spark, d)).select("first_row_id", "copies")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_groups(_train(spark, d)).filter("row_id > first_row_id").select("first_row_id", "row_id")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_groups(_train(spark, d))


def p7_bins(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(table(spark, d, "documents"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(fill_containers(table(spark, d, "documents")))


def p7_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each text put together again from its parts in the containers."""
    docs = table(spark, d, "documents")
    part = F.expr("substring(text, first_char + 1, n_chars)")
    parts = fill_containers(docs).select("doc_id", "piece", "first_char", "n_chars").join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "piece", part.alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "part"))), lambda x: x["part"]), "")  # the pieces of one text
    return parts.groupBy("doc_id").agg(whole.alias("text")).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """One row: whether no container holds too much, none is missing, and there are at most 1 % more than any packing needs."""
    bins = fill_containers(table(spark, d, "documents")).groupBy("bin_id").agg(F.sum("n_tokens").alias("n"))
    least = F.ceil(F.sum("n") / 1024)
    return bins.agg(
        (F.max("n") <= 1024).alias("within"), ((F.min("bin_id") == 0) & (F.max("bin_id") == F.count("*") - 1)).alias("gapless"), (F.count("*") <= least * 1.01 + 1).alias("nearly_full")
    )


def p8_draws(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).draws()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).report()


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source keeps to its repeats and is within half a percentage point of the share that it can have."""
    got = p8_report(spark, d)
    return got.select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("reached_share") - F.col("wanted_share")) < 0.005).alias("near_share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(table(spark, d, "documents")).documents()


def p9_characters(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(table(spark, d, "documents")).characters()


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of at least 200 characters, exact or with small differences, that a document and a partner hold."""
    return SharedSpans(table(spark, d, "documents")).passages().filter("end - start >= 200")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p1_rejoined, p2_found, p2_overlaps, p2_report, p2_classes, p3_found, p3_terms, p4_found, p4_splits, p4_kept, p4_report, p5_found, p5_records, p6_found, p6_groups,
        p7_bins, p7_report, p7_rejoined, p7_limits, p8_draws, p8_report, p8_limits, p9_found, p9_characters, p9_passages,
    )
}
