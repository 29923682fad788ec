"""Bodies as sets of triples: canonical values and integer identifiers.

Every distinct entry of an Arrow batch is canonicalised once (dictionary encoding) and gets an integer
identifier, the 64-bit hash of its canonical form, so that identifiers agree between tasks without a shared
dictionary. A triple's identifier is mixed from those of its entries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthframe.functions.bodies import parse_body
from truthframe.session import drop_written, map_arrow, materialize

_NOT_CONTENT = re.compile("[^a-z0-9\x1f]+")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


def canonical(values: list[str]) -> list[str]:
    """Each value lower-cased and stripped of everything but a-z and 0-9."""
    joined = _NOT_CONTENT.sub("", "\x1f".join(values).lower())
    out = joined.split("\x1f") if values else []
    if len(out) != len(values):  # a value holds the separator itself
        out = [re.sub("[^a-z0-9]+", "", v.lower()) for v in values]
    return out


def entry_ids(flat: list[str]) -> np.ndarray:
    """The identifier of each entry; every distinct value is canonicalised and hashed once."""
    coded = pa.array(flat, pa.large_string()).dictionary_encode()
    ids = np.fromiter((xxhash.xxh3_64_intdigest(c) for c in canonical(coded.dictionary.to_pylist())), np.uint64, len(coded.dictionary))
    return ids[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)


def triple_sets(bodies: list[str | None], least: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of those bodies that have a content: their places, the offsets of their triples, and the triples' sorted distinct identifiers."""
    flat: list[str] = []
    lengths = np.zeros(len(bodies), np.int64)
    for i, b in enumerate(bodies):
        entries = parse_body(b)
        if entries and len(entries) >= 3 * least:
            lengths[i] = len(entries) // 3
            flat += entries
    ids = entry_ids(flat).reshape(-1, 3)
    tid = mix(mix(mix(ids[:, 0]) + ids[:, 1]) + ids[:, 2])
    doc = np.repeat(np.arange(len(bodies)), lengths)
    order = np.lexsort((tid, doc))
    tid, doc = tid[order], doc[order]
    new = np.ones(len(tid), bool)
    new[1:] = (tid[1:] != tid[:-1]) | (doc[1:] != doc[:-1])
    tid, doc = tid[new], doc[new]
    count = np.bincount(doc, minlength=len(bodies))
    keep = count >= least
    tid = tid[keep[doc]]
    at = np.nonzero(keep)[0]
    return at, np.concatenate(([0], np.cumsum(count[at]))), tid


def set_hashes(offsets: np.ndarray, tid: np.ndarray) -> list[bytes]:
    """128 bits for each sorted set of identifiers."""
    raw = tid.tobytes()
    return [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(offsets[:-1], offsets[1:])]


def contents(df: DataFrame, id_col: str = "row_id", body_col: str = "body", least: int = 5, keep_triples: bool = True) -> DataFrame:
    """``(id, content, n[, cid, triples])`` of the rows that have a content.

    ``content`` is a 128-bit hash of the set, equal for equal contents; ``n`` the number of distinct triples,
    ``triples`` their sorted identifiers, ``cid`` the first 64 bits of ``content``. Null, empty and broken bodies
    and those of fewer than ``least`` distinct triples have no row, nor have rows without an id. Repeated rows stay repeated; other columns
    of ``df`` are ignored, whatever their names.
    """
    schema = "id long, content binary, n int" + (", cid long, triples array<long>" if keep_triples else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, offsets, tid = triple_sets(b.column(1).to_pylist(), least)
            hashes = set_hashes(offsets, tid)
            cols = [b.column(0).take(pa.array(at)), pa.array(hashes, pa.binary()), pa.array(np.diff(offsets), pa.int32())]
            if keep_triples:
                cid = np.frombuffer(b"".join(h[:8] for h in hashes), np.int64)
                cols += [pa.array(cid), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tid.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "content", "n", "cid", "triples"][: len(cols)])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(body_col).alias("body")).filter("id is not null and body is not null")
    return map_arrow(picked, run, schema)


def distinct_contents(rows: DataFrame, part: str = "cid") -> tuple[DataFrame, DataFrame]:
    """``rows`` of ``contents`` and one ``(cid, n, triples)`` for each content, written out, however many rows have it.

    Copies are merged on the map side first. ``cid`` has 64 of the 128 bits of ``content``, or those that ``part`` takes of it;
    should two contents share them, other 64 bits are taken, so that in what is returned no two do.
    """
    rows = rows.withColumn("cid", F.expr(part))
    for salt in range(1, 9):
        found = materialize(
            rows.groupBy("cid").agg(F.first("n").alias("n"), F.first("triples").alias("triples"), F.min("content").alias("low"), F.max("content").alias("high")), "distinct"
        )
        if not found.filter("low <> high").head(1):
            return rows, found.select("cid", "n", "triples")
        drop_written(found)
        rows = rows.withColumn("cid", F.xxhash64("content", F.lit(salt)))
    raise RuntimeError("contents can't be told apart")
