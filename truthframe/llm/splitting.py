"""Problem 1: oversized bodies cut into overlapping pieces at natural boundaries, by content-defined chunking.

Tokens are maximal runs of A-Z, a-z, 0-9 and ``_``, or single other characters that aren't blank. A rolling hash
over the last ``WINDOW`` tokens marks landmarks. From a piece's start, the first landmark beyond the minimum size
is snapped to the nearest natural boundary within minimum and maximum: the end of a triple, else the end of an
entry, else the landmark itself inside the entry. Without a landmark the last boundary within the maximum is
taken. As landmarks depend on nearby tokens only, an edit moves the cuts around it and later ones fall into step
again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthframe.llm.contents import mix
from truthframe.session import map_arrow

TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r]"
#: Tokens that the rolling hash spans, and the bits of it that are zero at a landmark (one token in 64).
WINDOW, LANDMARK_BITS = 8, 6
INSIDE, ENTRY, TRIPLE = 0, 1, 2

_TOKEN = re.compile(TOKEN)
_OPEN, _CLOSE = frozenset("[({"), frozenset("])}")
_ENDS = {'"': '"', "'": "'", "“": "”"}


def landmarks(tokens: list[str]) -> np.ndarray:
    """Whether each token ends a window whose rolling hash is a landmark."""
    size = len(tokens)
    h = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, size)
    rolled = np.zeros(size, np.uint64)
    for k in range(min(WINDOW, size)):
        rolled[k:] += h[: size - k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
    return (mix(rolled) & np.uint64((1 << LANDMARK_BITS) - 1)) == 0


def boundaries(tokens: list[str]) -> np.ndarray:
    """What a cut after each token would fall on: TRIPLE, ENTRY (between entries of a triple) or INSIDE an entry.

    A triple is what stands in the second level of brackets; if the outermost bracket is missing, the first. Commas
    between triples and entries belong to what they follow. Works on broken bodies as well.
    """
    kind = np.zeros(len(tokens), np.int8)
    quote, depth, before = "", 0, ""
    top = 2
    for t in tokens:  # the level of triples: 1 if the first list holds a quoted value at once
        if t in _OPEN:
            depth += 1
        elif t in _ENDS:
            top = min(max(depth, 1), 2)
            break
    depth = 0
    for i, t in enumerate(tokens):
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        if quote:
            # a quote ends a value only before a separator, so apostrophes inside a value don't count
            if t == quote and before != "\\" and (after == "" or after in ",:" or after in _CLOSE):
                quote = ""
                kind[i] = ENTRY if depth >= top and after not in ",:" and after not in _CLOSE else INSIDE
        elif t in _ENDS:
            quote = _ENDS[t]
        elif t in _OPEN:
            depth += 1
        elif t in _CLOSE:
            depth -= 1
            if depth == top - 1:
                kind[i] = TRIPLE if after != "," else INSIDE
        elif t == ",":
            kind[i] = TRIPLE if depth < top else ENTRY
        before = t
    return kind


def cuts(marks: np.ndarray, kind: np.ndarray, limit: int, overlap: int, least: int) -> list[int]:
    """The ends of the pieces in tokens. The first piece takes up to ``limit`` tokens, each later one ``limit - overlap`` new ones."""
    total, start, ends = len(kind), 0, []
    triples, entries, landmark = (np.nonzero(x)[0] + 1 for x in (kind == TRIPLE, kind >= ENTRY, marks))
    room = limit
    while total - start > room:
        low, high = start + min(least, room), start + room
        at = landmark[np.searchsorted(landmark, low) : np.searchsorted(landmark, high, "right")]
        goal = int(at[0]) if len(at) else high
        end = 0
        for places in (triples, entries):
            near = places[np.searchsorted(places, low) : np.searchsorted(places, high, "right")]
            if not len(near):  # none beyond the minimum: any at all
                near = places[np.searchsorted(places, start, "right") : np.searchsorted(places, high, "right")][-1:]
            if len(near):
                end = int(near[np.argmin(np.abs(near - goal))])
                break
        ends.append(end or goal)
        start, room = ends[-1], limit - overlap
    return ends + [total]


def split_body(body: str, limit: int = 1024, overlap: int = 64, least: int | None = None) -> list[tuple[int, int, int, str, str]]:
    """``(first token, overlap, tokens, cut, text)`` of each piece of an oversized body; no pieces for any other."""
    spans = [m.span() for m in _TOKEN.finditer(body)]
    if len(spans) <= limit:
        return []
    tokens = [body[a:b] for a, b in spans]
    kind = boundaries(tokens)
    ends = cuts(landmarks(tokens), kind, limit, overlap, (limit - overlap) // 2 if least is None else least)
    out, start = [], 0
    for end in ends:
        first = max(0, start - overlap) if start else 0
        last = len(body) if end == len(spans) else spans[end][0]
        cut = "end" if end == len(spans) else ("inside", "entry", "triple")[kind[end - 1]]
        out.append((first, start - first, end - first, cut, body[0 if not first else spans[first][0] : last]))
        start = end
    return out


def split_oversized(df: DataFrame, id_col: str = "row_id", body_col: str = "body", limit: int = 1024, overlap: int = 64, least: int | None = None) -> DataFrame:
    """``(row_id, piece, pieces, first_token, overlap_tokens, n_tokens, cut, text)`` for bodies of more than ``limit`` tokens.

    Pieces are numbered from 0, have at most ``limit`` tokens and, but for the first, begin with the last ``overlap``
    tokens of the piece before. ``cut`` says where a piece ends: ``triple``, ``entry`` (between entries of one
    triple), ``inside`` (an entry alone exceeds the room) or ``end``. Blanks after a piece's last token stay with
    it, so pieces without their overlap join to the whole body. Bodies within the limit, empty and null ones have
    no pieces. Repeated rows are cut each for itself, a null id stays null, and other columns are ignored.

    Nothing is shuffled: sizes are counted in the JVM, and only oversized bodies go to Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    body = F.col("body")
    large = (
        df.select(F.col(id_col).alias("row_id"), F.col(body_col).alias("body"))
        .filter(F.length(body) > limit)  # no more tokens than characters
        .filter(F.regexp_count(body, F.lit(TOKEN)) > limit)
    )
    kind = df.select(F.col(id_col).alias("row_id")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                pieces = split_body(text, limit, overlap, least)
                at += [i] * len(pieces)
                rows += [(k, len(pieces), *p) for k, p in enumerate(pieces)]
            cols = list(zip(*rows)) or [[]] * 7
            ints = [pa.array(cols[k], pa.int32()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), *ints, pa.array(cols[5], pa.string()), pa.array(cols[6], pa.string())],
                names=["row_id", "piece", "pieces", "first_token", "overlap_tokens", "n_tokens", "cut", "text"],
            )

    return map_arrow(large, run, f"row_id {kind}, piece int, pieces int, first_token int, overlap_tokens int, n_tokens int, cut string, text string")
