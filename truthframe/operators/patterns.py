"""Fourteen inconsistency patterns over axioms, found whole or but for one atom.

Axioms are rows ``(onto, kind, a, prop, b, n)``:

    sub         a is a subclass of the named class b
    some, only  a is a subclass of ``prop some b`` / ``prop only b``
    someand     a is a subclass of ``prop some (b and n)``, n being the second class
    max1        a is a subclass of ``prop max 1 Thing``
    eq, dis     a and b are equivalent / disjoint, read in both directions
    subprop     property a is below property b
    inverse     properties a and b are inverses, read in both directions
    domain, range   property prop has the domain / range b
    type        individual a is of class b
    fact        individual a stands in prop to individual b

A pattern is a list of atoms ``(kind, a, prop, b, n)`` over variables. ``detect`` joins them all. ``complete``
leaves one out, joins the rest, and keeps what is missing in the ontology. Both are equi joins within an ontology;
all completions are returned, and ``pick`` takes the smallest for each ontology.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from truthframe.session import local_frame, materialize

SLOTS = ("a", "prop", "b", "n")
Atom = tuple[str, str | None, str | None, str | None, str | None]


def _atom(kind: str, a: str | None = None, prop: str | None = None, b: str | None = None, n: str | None = None) -> Atom:
    return kind, a, prop, b, n


_dis = lambda x, y: _atom("dis", x, None, y)
_sub = lambda x, y: _atom("sub", x, None, y)
_some = lambda x, r, y: _atom("some", x, r, y)
_only = lambda x, r, y: _atom("only", x, r, y)

PATTERNS: dict[str, list[Atom]] = {
    "EID": [_atom("eq", "c1", None, "c2"), _dis("c1", "c2")],
    "AIO": [_some("c1", "r", "c2"), _atom("someand", "c1", "r", "c2", "c3"), _dis("c2", "c3")],
    "OIL": [_only("c1", "r", "c2"), _only("c1", "r", "c3"), _dis("c2", "c3")],
    "OILWI": [_sub("c1", "c2"), _only("c1", "r", "c3"), _only("c2", "r", "c4"), _dis("c3", "c4")],
    "OILWPI": [_atom("subprop", "r1", None, "r2"), _only("c1", "r1", "c2"), _only("c1", "r2", "c3"), _dis("c2", "c3")],
    "UE": [_only("c1", "r", "c2"), _some("c1", "r", "c3"), _dis("c2", "c3")],
    "UEWI1": [_sub("c1", "c2"), _some("c1", "r", "c3"), _only("c2", "r", "c4"), _dis("c3", "c4")],
    "UEWI2": [_sub("c1", "c2"), _some("c2", "r", "c3"), _only("c1", "r", "c4"), _dis("c3", "c4")],
    "UEWPI": [_atom("subprop", "r1", None, "r2"), _some("c1", "r1", "c2"), _only("c1", "r2", "c3"), _dis("c2", "c3")],
    "UEWIP": [_some("c2", "r1", "c1"), _only("c1", "r2", "c3"), _atom("inverse", "r1", None, "r2"), _dis("c2", "c3")],
    "SOSINETO": [_some("c1", "r", "c2"), _some("c1", "r", "c3"), _atom("max1", "c1", "r"), _dis("c2", "c3")],
    "CSC": [_sub("c1", "c3"), _sub("c2", "c1"), _sub("c3", "c2")],
    "OOD": [_atom("domain", None, "p", "c1"), _atom("fact", "i", "p", "j"), _atom("type", "i", None, "c2"), _dis("c1", "c2")],
    "OOR": [_atom("range", None, "p", "c1"), _atom("fact", "i", "p", "j"), _atom("type", "j", None, "c2"), _dis("c1", "c2")],
}
#: The assertion read at its other end: the object for a domain, the subject for a range.
STRICT = {
    "OOD": [_atom("domain", None, "p", "c1"), _atom("fact", "i", "p", "j"), _atom("type", "j", None, "c2"), _dis("c1", "c2")],
    "OOR": [_atom("range", None, "p", "c1"), _atom("fact", "i", "p", "j"), _atom("type", "i", None, "c2"), _dis("c1", "c2")],
}
SYMMETRIC = ("eq", "dis", "inverse")


def both_ways(axioms: DataFrame) -> DataFrame:
    """Symmetric axioms in both directions, every axiom once."""
    rows = axioms.select("onto", "kind", *SLOTS)
    turned = rows.filter(F.col("kind").isin(*SYMMETRIC)).select("onto", "kind", F.col("b").alias("a"), "prop", F.col("a").alias("b"), "n")
    return rows.union(turned).distinct()


def _rows(axioms: DataFrame, atom: Atom) -> DataFrame:
    kind, *slots = atom
    named = [(s, v) for s, v in zip(SLOTS, slots) if v]
    return axioms.filter(F.col("kind") == kind).select("onto", *(F.col(s).alias(v) for s, v in named)).distinct()


def _order(atoms: Sequence[Atom]) -> list[Atom]:
    """Each atom after one it shares a variable with, where there is such an order."""
    left, out, seen = list(atoms), [], set()
    while left:
        best = max(left, key=lambda x: len(seen & set(filter(None, x[1:]))))
        left.remove(best)
        out.append(best)
        seen |= set(filter(None, best[1:]))
    return out


def _joined(axioms: DataFrame, atoms: Sequence[Atom]) -> DataFrame:
    out = None
    for atom in _order(atoms):
        rows = _rows(axioms, atom)
        out = rows if out is None else out.join(rows, [c for c in rows.columns if c in out.columns])
    return out


def _apart(df: DataFrame, atoms: Sequence[Atom]) -> DataFrame:
    """Classes that are said to be disjoint or equivalent are different ones; so are the classes of a chain."""
    for kind, a, _, b, _ in atoms:
        if kind in ("dis", "eq", "sub") and a in df.columns and b in df.columns:
            df = df.filter(F.col(a) != F.col(b))
    return df


def detect(axioms: DataFrame, pattern: str, strict: bool = False) -> DataFrame:
    """``(onto, <variables>)`` for every place where the whole pattern stands."""
    atoms = STRICT.get(pattern, PATTERNS[pattern]) if strict else PATTERNS[pattern]
    return _apart(_joined(both_ways(axioms), atoms), atoms).distinct()


def complete(axioms: DataFrame, pattern: str, strict: bool = False) -> DataFrame:
    """``(onto, pattern, kind, a, prop, b, n)``: axioms, not in the ontology yet, that would complete the pattern there.

    An atom whose variables aren't all given by the others can't be completed. Symmetric axioms come out once, the
    smaller name first.
    """
    atoms = STRICT.get(pattern, PATTERNS[pattern]) if strict else PATTERNS[pattern]
    there = both_ways(axioms)
    out = None
    for i, atom in enumerate(atoms):
        rest = atoms[:i] + atoms[i + 1 :]
        given = {v for x in rest for v in x[1:] if v}
        if any(v not in given for v in atom[1:] if v):
            continue
        kind, *slots = atom
        rows = _apart(_joined(there, rest), atoms)
        new = rows.select("onto", F.lit(kind).alias("kind"), *((F.col(v) if v else F.lit(None).cast("string")).alias(s) for s, v in zip(SLOTS, slots)))
        if kind in SYMMETRIC:
            new = new.select("onto", "kind", F.least("a", "b").alias("a"), "prop", F.greatest("a", "b").alias("b"), "n")
        out = new if out is None else out.union(new)
    if out is None:
        raise ValueError(f"{pattern} can't be completed")
    out = out.distinct().alias("x")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("onto", "kind", *SLOTS)]
    return out.join(there.alias("y"), same, "left_anti").select("onto", F.lit(pattern).alias("pattern"), "kind", *SLOTS)


#: Of which patterns a single axiom can be completed by two, and that axiom's kind with the kind that joins it.
PAIRED: dict[str, list[tuple[str, str]]] = {"EID": [], "AIO": [("some", "someand")], "OIL": [("only", "only")], "UE": [("only", "some"), ("some", "only")]}


def classes_of(axioms: DataFrame) -> DataFrame:
    """``(onto, c)``: the classes that an ontology's axioms name."""
    k = F.col("kind")
    subject = F.when(k.isin("sub", "eq", "dis", "some", "only", "max1", "someand"), F.col("a"))
    filler = F.when(k.isin("sub", "eq", "dis", "some", "only", "someand", "domain", "range", "type"), F.col("b"))
    return axioms.select("onto", F.explode(F.array(subject, filler, F.when(k == "someand", F.col("n")))).alias("c")).filter("c is not null").distinct()


def complete_two(axioms: DataFrame, pattern: str) -> DataFrame:
    """``(onto, pattern, kind, a, prop, b, n, dis_a, dis_b)``: pairs of axioms that complete a pattern of which a single one is there.

    The pair is a restriction (for ``EID`` an equivalence) and a disjointness, with the smallest class of the ontology that the
    axiom there doesn't name. ``EID`` takes the ontology's two smallest classes. Patterns are those of ``PAIRED``.
    """
    none = F.lit(None).cast("string")
    # the three smallest classes: one of them is neither of an axiom's two
    few = classes_of(axioms).groupBy("onto").agg(F.slice(F.array_sort(F.collect_set("c")), 1, 3).alias("few"))
    if pattern == "EID":
        first, second = F.element_at("few", 1), F.element_at("few", 2)
        return few.filter(F.size("few") > 1).select("onto", F.lit("EID").alias("pattern"), F.lit("eq").alias("kind"), first.alias("a"), none.alias("prop"), second.alias("b"), none.alias("n"), first.alias("dis_a"), second.alias("dis_b"))
    out = None
    for there, kind in PAIRED[pattern]:
        rows = axioms.filter(F.col("kind") == there).select("onto", "a", "prop", "b").distinct().join(few, "onto")
        third = F.get(F.filter("few", lambda c: (c != F.col("a")) & (c != F.col("b"))), F.lit(0))
        rows = rows.withColumn("c3", third).filter("c3 is not null")
        filler, second = (F.col("b"), F.col("c3")) if kind == "someand" else (F.col("c3"), none)
        one = rows.select("onto", F.lit(pattern).alias("pattern"), F.lit(kind).alias("kind"), "a", "prop", filler.alias("b"), second.alias("n"), F.least("b", "c3").alias("dis_a"), F.greatest("b", "c3").alias("dis_b"))
        out = one if out is None else out.union(one)
    return out.distinct()


def pick(completions: DataFrame) -> DataFrame:
    """The smallest completion of each ontology and pattern."""
    best = F.min(F.struct("kind", *(F.coalesce(c, F.lit("")).alias(c) for c in SLOTS))).alias("x")
    return completions.groupBy("onto", "pattern").agg(best).select("onto", "pattern", "x.kind", *(F.nullif(F.col(f"x.{c}"), F.lit("")).alias(c) for c in SLOTS))


def inject(axioms: DataFrame, patterns: Sequence[str], passes: int = 3) -> DataFrame:
    """``(onto, pattern, kind, ..., pass)``: the picked completions of up to so many passes, each seeing those before; no axiom twice."""
    now, out = axioms.select("onto", "kind", *SLOTS), None
    for k in range(1, passes + 1):
        step = None
        for p in patterns:
            one = pick(complete(now, p))
            step = one if step is None else step.union(one)
        fresh = materialize(step.withColumn("pass", F.lit(k)), "injected")
        if not fresh.head(1):
            break
        out = fresh if out is None else out.union(fresh)
        now = materialize(now.union(fresh.select("onto", "kind", *SLOTS)).distinct(), "axioms")
    return out if out is not None else axioms.sparkSession.createDataFrame([], "onto string, pattern string, kind string, a string, prop string, b string, n string, pass int")


def seed_axioms(spark: SparkSession, pattern: str, onto: str = "seed") -> DataFrame:
    """Axioms of a pattern but for its last one, over names of their own, so that ``complete`` can finish it: what an ontology without any of them needs first."""
    name = lambda v: v and f"Seed{pattern}{v.capitalize()}"
    rows = [(onto, kind, *map(name, slots)) for kind, *slots in PATTERNS[pattern][:-1]]
    return local_frame(spark, rows, "onto string, kind string, a string, prop string, b string, n string")


def profile(axioms: DataFrame) -> DataFrame:
    """Axioms of each kind in an ontology."""
    kinds = sorted({a[0] for atoms in PATTERNS.values() for a in atoms})
    return axioms.groupBy("onto").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def missing_signals(axioms: DataFrame, pattern: str) -> DataFrame:
    """``(onto, missing)``: the kinds of axiom that the pattern needs and an ontology has none of."""
    kinds = sorted({a[0] for a in PATTERNS[pattern]})
    lacking = F.filter(F.array(*(F.when(F.col(k) == 0, k) for k in kinds)), lambda x: x.isNotNull())
    return profile(axioms).select("onto", lacking.alias("missing"))


def axioms_from_triples(triples: DataFrame, by: str = "onto") -> DataFrame:
    """Axioms read from ``(onto, s, p, o)``; a conjunction in an object gives one axiom for each of its simple parts.

    One pass: every triple gives an array of axioms, which is exploded.
    """
    named, nested = r"^[A-Za-z0-9_:-]+$", r"^(\S+) some \((\S+) and (\S+)\)$"
    none = F.lit(None).cast("string")
    s, p, o = F.col("s"), F.lower("p"), F.col("o")

    def axiom(kind: str, a: Column = none, prop: Column = none, b: Column = none, n: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), prop.alias("prop"), b.alias("b"), n.alias("n"))

    def part(e: Column) -> Column:
        """What one part of a class expression says, null if it is of no known form."""
        word = lambda w, i: F.regexp_extract(e, rf"^(\S+) {w} (\S+)$", i)
        return (
            F.when(e.rlike(named), F.when(p == "subclassof", axiom("sub", s, none, e)))
            .when(e.rlike(nested), axiom("someand", s, F.regexp_extract(e, nested, 1), F.regexp_extract(e, nested, 2), F.regexp_extract(e, nested, 3)))
            .when(e.rlike(r"^\S+ some \S+$"), axiom("some", s, word("some", 1), word("some", 2)))
            .when(e.rlike(r"^\S+ only \S+$"), axiom("only", s, word("only", 1), word("only", 2)))
            .when(e.rlike(r"^\S+ max 1 "), axiom("max1", s, F.regexp_extract(e, r"^(\S+) max 1 ", 1)))
        )

    whole = F.trim(F.regexp_replace(o, r"^\((.*)\)$", "$1"))
    parts = F.when(whole.rlike(nested), F.array(whole)).otherwise(F.split(F.regexp_replace(o, r"[()]", ""), r"\s+and\s+"))
    said = F.transform(parts, part)
    ends = {"disjointwith": "dis", "subpropertyof": "subprop", "inverseof": "inverse", "is": "type", "types": "type"}
    annotation = p.isin("label", "note", "trace", "comment")
    single = F.when(annotation, F.lit(None))
    for word, kind in ends.items():
        single = single.when(p == word, axiom(kind, s, none, o))
    for word in ("domain", "range"):
        single = single.when(p == word, axiom(word, none, s, o))
    single = F.array(single.otherwise(axiom("fact", s, F.col("p"), o)))
    both = F.when((p == "equivalentto") & o.rlike(named), F.array(axiom("eq", s, none, o))).when(p.isin("subclassof", "equivalentto"), said).otherwise(single)
    rows = triples.select(F.col(by).alias("onto"), F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x"))
    return rows.select("onto", "x.*").distinct()
