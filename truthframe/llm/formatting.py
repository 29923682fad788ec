"""Problem 5: records that differ only in formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthframe.llm.contents import contents
from truthframe.session import materialize


def formatting_groups(df: DataFrame, id_col: str = "row_id", body_col: str = "body", least: int = 5) -> DataFrame:
    """One ``(content, first_row_id, copies)`` for each content: the smallest id that has it and how many rows do.

    Entries are dictionary-encoded (``contents.entry_ids``), records rewritten as sorted sets of integer triples,
    and the compact sets grouped by their 128-bit hash. Copies are counted on the map side first, so a content
    held by a third of all rows moves as one small row per task. Rows without a content (null, empty or broken
    body, fewer than ``least`` triples) are in no group; a row that is repeated counts as a copy.
    """
    return (
        contents(df, id_col, body_col, least, keep_triples=False)
        .groupBy("content")
        .agg(F.min("id").alias("first_row_id"), F.count("*").alias("copies"))
    )


def formatting_members(df: DataFrame, id_col: str = "row_id", body_col: str = "body", least: int = 5) -> DataFrame:
    """``(first_row_id, row_id)`` for each further member of a content's group, without repeats."""
    rows = materialize(contents(df, id_col, body_col, least, keep_triples=False).select("id", "content"), "contents")
    first = rows.groupBy("content").agg(F.min("id").alias("first_row_id"), F.max("id").alias("last")).filter("last > first_row_id")
    return rows.join(first.drop("last"), "content").filter("id > first_row_id").select("first_row_id", F.col("id").alias("row_id")).distinct()
