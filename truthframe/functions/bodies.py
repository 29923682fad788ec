"""Bodies as lists of triples, in one of several notations.

A body is a list of ``(subject, predicate, object)``: a list or tuple literal with single or double quotes, JSON
arrays, JSON objects with named fields, or any of these in curly quotes. It counts as broken unless the whole text
reads as such a list; single triples of another length inside a readable list are dropped.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from truthframe.session import ship

#: Names of the three fields in notations that name them.
FIELDS = {"s": 0, "subject": 0, "subj": 0, "p": 1, "predicate": 1, "pred": 1, "o": 2, "object": 2, "obj": 2}

_CURLY = str.maketrans("“”", '""')


def _read(text: str):
    try:
        return json.loads(text, strict=False)
    except ValueError:
        pass
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


def parse_body(body: str | None) -> list[str] | None:
    """The entries of all triples in one flat list; None if the body is null, blank or broken."""
    if body is None:
        return None
    text = body.strip(" \t\r\n")
    if not text or text[0] not in "[(":
        return None
    found = None
    curly = "“" in text
    if not curly and '"' not in text and "\\" not in text and text[0] == "[":
        # only single-quoted strings without escapes: the same list in JSON's quotes
        try:
            found = json.loads(text.replace("'", '"'), strict=False)
        except ValueError:
            found = None
    if found is None:
        found = _read(text)
    if found is None and curly:
        found = _read(text.translate(_CURLY))
    if not isinstance(found, (list, tuple)):
        return None
    out: list[str] = []
    for t in found:
        if isinstance(t, dict):
            named = {FIELDS.get(str(k).strip().lower()): v for k, v in t.items()}
            if len(t) != 3 or named.keys() != {0, 1, 2}:
                continue
            t = (named[0], named[1], named[2])
        elif not isinstance(t, (list, tuple)) or len(t) != 3:
            continue
        out += t
    return [x if isinstance(x, str) else str(x) for x in out]


_TRIPLES = ArrayType(StructType([StructField(c, StringType()) for c in "spo"]))


@F.pandas_udf(_TRIPLES)
def _body_triples(bodies: pd.Series) -> pd.Series:
    out = []
    for b in bodies:
        flat = parse_body(b)
        out.append(None if flat is None else [dict(zip("spo", (x.strip() for x in flat[i : i + 3]))) for i in range(0, len(flat), 3)])
    return pd.Series(out)


def body_triples(body: Column | str) -> Column:
    """``array<struct<s,p,o>>`` with trimmed entries; null for null and broken bodies."""
    ship()
    return _body_triples(body)
