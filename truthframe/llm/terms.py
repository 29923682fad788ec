"""Problem 3: how often each term occurs, and in how many records, by last-seen counters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthframe.session import map_arrow

#: Terms that one task counts before it hands its counters on and starts anew.
HELD = 300_000

_TERM = re.compile("[A-Za-z0-9_]+")


def count_terms(texts, counters: dict[str, list[int]], record: int) -> int:
    """Adds the terms of each text to ``counters``: term -> [occurrences, records, last record]. Returns the last record's number."""
    for text in texts:
        if not text:
            continue
        record += 1
        # runs are found before lower-casing unless all is ASCII: other letters may become ASCII ones
        terms = _TERM.findall(text.lower()) if text.isascii() else [t.lower() for t in _TERM.findall(text)]
        for t in terms:
            c = counters.get(t)
            if c is None:
                counters[t] = [1, 1, record]
            else:
                c[0] += 1
                if c[2] != record:
                    c[1] += 1
                    c[2] = record
    return record


def term_frequencies(df: DataFrame, body_col: str = "body") -> DataFrame:
    """``(term, occurrences, records)`` for every term of ``body_col``, a maximal run of A-Z, a-z, 0-9 and ``_`` in lower case.

    Each task meets its records one after the other and keeps, for a term, its occurrences, its records and the
    last record that had it, so no set of records is held for any term; it hands the counters on when it holds
    ``HELD`` of them. A record lies in one task whole, so partial counters add up. Terms are hash-partitioned only
    after that, a row for each task and term, however frequent the term. Null and empty bodies count for nothing,
    and a row that is repeated counts each time. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, list[int]] = {}
        record = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            terms, counts = list(counters), list(counters.values())
            counters.clear()
            for a in range(0, len(terms), 50_000):
                some = counts[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms[a : a + 50_000], pa.string()), pa.array([c[0] for c in some], pa.int64()), pa.array([c[1] for c in some], pa.int64())],
                    names=["term", "occurrences", "records"],
                )

        for b in batches:
            texts = b.column(0).to_pylist()
            for a in range(0, len(texts), 256):
                record = count_terms(texts[a : a + 256], counters, record)
                if len(counters) > HELD:
                    yield from handed_on()
        yield from handed_on()

    part = map_arrow(df.select(F.col(body_col).alias("body")).filter("body is not null"), run, "term string, occurrences long, records long")
    return part.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, body_col: str = "body", rare: int = 2, common: float = 0.25) -> DataFrame:
    """``term_frequencies`` with ``mark``: ``rare`` in at most ``rare`` records, else ``common`` in at least the share ``common`` of all rows, else null.

    Rows without a body count as rows.
    """
    total = df.agg(F.count("*").alias("total"))
    return (
        term_frequencies(df, body_col)
        .crossJoin(F.broadcast(total))  # a single row
        .withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") >= F.col("total") * common, "common"))
        .drop("total")
    )
