"""Sizes of texts in tokens of a public byte-level tokenizer, read from its rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthframe.session import map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def tokenizer(path: str = VOCABULARY) -> tiktoken.Encoding:
    """One per Python worker; every node needs the file at ``path``."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens_of(text: str, enc: tiktoken.Encoding) -> list[int]:
    return enc.encode_ordinary(text)


def cut_text(text: str, capacity: int, enc: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    """``(first character, characters, tokens)`` of each piece of at most ``capacity`` tokens; one piece if the text fits, none if it has no token.

    Cuts fall on characters, and a piece's tokens are counted on the piece itself, so that it fits wherever it goes.
    """
    rest = tokens_of(text, enc)
    if len(rest) <= capacity:
        return [(0, len(text), len(rest))] if rest else []
    out, start = [], 0
    while len(rest) > capacity:
        take = capacity
        while True:
            # without the last character if the cut is inside it
            piece = enc.decode_bytes(rest[:take]).decode("utf-8", "ignore")
            size = len(tokens_of(piece, enc)) if piece else 0
            if piece and size <= capacity:
                break
            if not piece:  # a single character of more tokens than the capacity stays whole
                piece = text[start]
                size = len(tokens_of(piece, enc))
                break
            take -= max(1, size - capacity)
        out.append((start, len(piece), size))
        start += len(piece)
        # what follows is seen in windows, so that a very long text is tokenised about once
        rest = tokens_of(text[start:], enc) if len(text) - start <= 16 * capacity else tokens_of(text[start : start + 16 * capacity], enc)
    last = text[start:]
    if last:
        left = tokens_of(last, enc)
        out.append((start, len(last), len(left))) if len(left) <= capacity else out.extend((start + a, n, k) for a, n, k in cut_text(last, capacity, enc))
    return out


def pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, piece, first_char, n_chars, n_tokens)``: each text, cut only where it has more than ``capacity`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(vocabulary)
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                found = cut_text(text, capacity, enc)
                at += [i] * len(found)
                rows += [(k, *p) for k, p in enumerate(found)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int32()) for c in cols)], names=["doc_id", "piece", "first_char", "n_chars", "n_tokens"])

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    return map_arrow(picked, run, "doc_id long, piece int, first_char int, n_chars int, n_tokens int")
