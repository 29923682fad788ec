"""String functions over names, IRIs and class expressions, as Column expressions where those suffice."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from truthframe.session import ship

#: Words of class expressions that are operators (fixed values).
OPERATORS = ("and", "exactly", "inverse", "max", "min", "not", "only", "or", "some")
COUNT_BUCKETS = (1, 2, 3, 5, 10, 20, 50, 100, 200, 500, 1000)
LENGTH_BUCKETS = (64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384)


def squeeze(c: Column) -> Column:
    """Runs of white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def shorten(c: Column, most: int = 96) -> Column:
    """Squeezed, and cut with an ellipsis beyond ``most`` characters."""
    s = squeeze(c)
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.split(c, pattern), lambda x: x != "")


def expression_tokens(c: Column) -> Column:
    """Tokens between white space, parentheses, commas and semicolons; trailing commas don't count."""
    return _parts(F.trim(F.regexp_replace(F.trim(c), r",+$", "")), r"[\s(),;]+")


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of word characters."""
    return _parts(F.lower(c), r"\W+")


def operators_in(c: Column) -> Column:
    """The operators that stand as words in an expression, sorted."""
    lower = F.lower(c)
    return F.filter(F.array(*(F.when(lower.rlike(rf"(?<![A-Za-z0-9_]){op}(?![A-Za-z0-9_])"), op) for op in OPERATORS)), lambda x: x.isNotNull())


def first_restriction(c: Column, words: tuple[str, ...] = ("some", "only", "max", "min", "exactly")) -> Column:
    """The first of the restriction words among the tokens, ``none`` if there is none."""
    found = F.filter(word_tokens(c), lambda x: x.isin(*words))
    return F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise("none")


def bucket_features(prefix: str, value: Column, thresholds=COUNT_BUCKETS) -> Column:
    """``prefix>=b`` for every threshold that the value meets."""
    return F.filter(F.array(*(F.when(value >= b, f"{prefix}>={b}") for b in thresholds)), lambda x: x.isNotNull())


def local_name(iri: Column) -> Column:
    """What follows the last ``#`` or ``/``."""
    return F.regexp_extract(iri, r"([^/#]*)[/#]?$", 1)


def base_iri(iri: Column) -> Column:
    """What precedes the last ``#`` or ``/``, with it; empty if there is neither."""
    return F.regexp_extract(iri, r"^(.*[/#])[^/#]*$", 1)


def camel_words(name: Column) -> Column:
    """Words of a camel-case or underscored name in ASCII, in lower case; a run of capitals is a word of its own."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return _parts(F.lower(spaced), r"[^a-z0-9]+")


def term_tokens(term: Column) -> Column:
    """Tokens of an IRI's local name or of a literal: runs of letters and digits, cut before a capital that follows a small letter; in lower case.

    Capitals in a row stay together with what follows them (``XMLParser`` is one token), and letters of any script count.
    """
    local = F.regexp_extract(term, r"(?s)([^/#]*)$", 1)
    cut = F.regexp_replace(local, r"(\p{Ll}[\p{L}\p{N}&&[^\p{Lu}]]*)(?=\p{Lu})", "$1 ")
    return _parts(F.lower(cut), r"[^\p{L}\p{N}]+")


def plain_name(name: Column) -> Column:
    """Camel case and runs of digits split by blanks, lower-cased, other symbols dropped."""
    s = F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(F.regexp_replace(s, r"([A-Za-z])([0-9])", "$1 $2"), r"([0-9])([A-Za-z])", "$1 $2")
    return squeeze(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " "))


def natural_key(c: Column, width: int = 12) -> Column:
    """A sort key in which runs of digits count as numbers: they are padded with zeros."""
    pieces = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, width, "0")).otherwise(x)), "")


def hash_slot(token: Column, dimensions: int) -> Column:
    """``(index, weight)`` of a token from its sha-256: index from the first 8 bytes, sign from the 9th, magnitude in [1, 2] from the 10th."""
    h = F.sha2(token.cast("binary"), 256)
    number = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("long")
    # the first 64 bits modulo the dimensions, by halves: products stay below 2^63
    index = (number(1, 8) % dimensions * ((1 << 32) % dimensions) + number(9, 8)) % dimensions
    sign = F.when(number(17, 2) % 2 == 1, -1.0).otherwise(1.0)
    return F.struct(index.cast("int").alias("index"), (sign * (1 + number(19, 2).cast("double") / 255)).alias("weight"))


def edit_similarity(a: Column, b: Column) -> Column:
    """exp(-e / (l1 + l2 - e)) of the edit distance e; 1 for two empty strings."""
    e = F.levenshtein(a, b).cast("double")
    rest = F.length(a) + F.length(b) - e
    return F.when(e == 0, 1.0).when(rest <= 0, 0.0).otherwise(F.exp(-e / rest))


def isub_score(one: str, two: str) -> float:
    """Similarity by repeatedly taking out a longest common substring of more than two characters.

    Case, dots, underscores and blanks don't count. Twice the common length over both lengths, less a penalty for what is
    left (a Hamacher product with p = 0.6), plus a bonus for a common prefix, of the names as they are given, of up to four
    characters. Of names without anything left, one alone is like any other (1) and two are unlike (0). If either name has
    one or two characters, the names are compared by edits, as they are given.
    """
    if min(len(one), len(two)) <= 2:
        e = _edits(one, two)
        rest = len(one) + len(two) - e
        return math.exp(-e / rest) if rest else float(not e)
    a, b = (name.lower().translate(_SILENT) for name in (one, two))
    if not a or not b:
        return float(bool(a or b))
    x, y, common = a, b, 0
    while x and y:
        at, other, size = _common_run(x, y)
        if size <= 2:
            break
        x, y, common = x[:at] + x[at + size :], y[:other] + y[other + size :], common + size
    likeness = 2 * common / (len(a) + len(b))
    u, v = 1 - common / len(a), 1 - common / len(b)
    product, plus = u * v, u + v - u * v
    unlike = product / (0.6 + 0.4 * plus) if plus else 0.0
    return likeness - unlike + _agree(one[:4], two[:4]) * 0.1 * (1 - likeness)


_SILENT = str.maketrans("", "", "._ ")


def _agree(a: str, b: str) -> int:
    """How many characters two strings have in common at the start."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def _common_run(a: str, b: str) -> tuple[int, int, int]:
    """Where a longest common run stands in both, and its length; the first in ``a``, then in ``b``.

    For each place in ``a`` the runs in ``b`` are those met from left to right, each beginning behind the one before.
    """
    best = (0, 0, 0)
    for i in range(len(a)):
        if len(a) - i <= best[2]:
            break
        j = b.find(a[i])
        while j >= 0:
            size = _agree(a[i:], b[j:])
            if size > best[2]:
                best = (i, j, size)
            j = b.find(a[i], j + size) if len(b) - j - size > best[2] else -1
    return best


@F.pandas_udf(DoubleType())
def _isub(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict[tuple[str, str], float] = {}
    for a, b in batches:
        out = []
        for pair in zip(a, b):
            if None in pair:
                out.append(None)
                continue
            if pair not in known:
                if len(known) > 200_000:
                    known.clear()
                known[pair] = isub_score(*pair)
            out.append(known[pair])
        yield pd.Series(out, dtype="float64")


def isub(a: Column | str, b: Column | str) -> Column:
    """``isub_score`` of two columns; each distinct pair of a batch is compared once."""
    ship()
    return _isub(a, b)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def dnf_holds(dnf: Column, assignment: Column) -> Column:
    """Whether any group of a DNF ``array<array<int>>`` holds: all its variables are 1, or 0 where negative, in the map ``assignment``."""
    value = lambda v: F.coalesce(F.element_at(assignment, F.abs(v)), F.lit(0))
    return F.exists(dnf, lambda group: F.forall(group, lambda v: F.when(v > 0, value(v) == 1).otherwise(value(v) == 0)))


def parse_dnf(sentence: Column) -> Column:
    """``array<array<int>>`` of a text with ``v`` for or, ``^`` for and, ``~`` for not; variables are numbers from 1."""
    groups = F.split(F.regexp_replace(sentence, r"[\s()]", ""), "v")
    return F.transform(groups, lambda g: F.transform(F.split(g, r"\^"), lambda x: F.regexp_replace(x, "~", "-").cast("int")))
