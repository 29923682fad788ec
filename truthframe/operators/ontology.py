"""Ontologies as triples and axioms: votes, graph projection, modules by locality, partitions, metrics, merging."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from truthframe.functions import text as X
from truthframe.session import drop_written, map_arrow, materialize, ship

#: Spellings of the two labels (fixed values).
INCONSISTENT, CONSISTENT = ("inconsistent", "0", "false", "unsat", "no"), ("consistent", "1", "true", "sat", "yes")


def plain_label(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin(*INCONSISTENT), "inconsistent").when(s.isin(*CONSISTENT), "consistent").otherwise(s)


def module_votes(predictions: DataFrame) -> DataFrame:
    """``(onto, label, modules, inconsistent, share)``: an ontology is inconsistent if any of its modules is.

    The ontology is what precedes ``_Department``, ``_module`` or the first ``_`` in a file's name. Rows without a name or
    a label don't vote.
    """
    onto = F.regexp_extract("file_name", r"^(.*?)(?:_Department|_module|_|$)", 1)
    rows = predictions.select(onto.alias("onto"), plain_label(F.col("consistency")).alias("label")).filter("onto is not null and label is not null")
    bad = F.count_if(F.col("label") == "inconsistent")
    out = rows.groupBy("onto").agg(F.count("*").alias("modules"), bad.alias("inconsistent"))
    share = F.format_string("%.1f%%", 100.0 * F.col("inconsistent") / F.col("modules"))
    return out.select("onto", F.when(F.col("inconsistent") > 0, "inconsistent").otherwise("consistent").alias("label"), "modules", "inconsistent", share.alias("share"))


# graphs from axioms (kinds as in patterns.py)


def project(axioms: DataFrame, only_taxonomy: bool = False, both_ways: bool = False, literals: bool = True) -> DataFrame:
    """``(onto, s, p, o)``: the graph that the axioms span, a rule for each kind.

    Subclasses; equivalences in both directions; types; restrictions along their property; domain by range of a property;
    facts, also by the inverse property turned round, by properties above, and by equivalent ones (kind ``eqprop``);
    individuals that are the same (``same``), as stated; with ``literals`` annotations (``annotation``: a, prop, the text
    as b). ``both_ways`` adds ``superClassOf`` and ``typeOf`` edges.
    """
    k = lambda *names: axioms.filter(F.col("kind").isin(*names))
    edge = lambda df, s, p, o: df.select("onto", s.alias("s"), p.alias("p"), o.alias("o"))
    a, b, prop, n = (F.col(c) for c in ("a", "b", "prop", "n"))
    sub = F.lit("subClassOf")
    parts = [edge(k("sub"), a, sub, b), edge(k("eq"), a, sub, b), edge(k("eq"), b, sub, a), edge(k("type"), a, F.lit("type"), b)]
    if not only_taxonomy:
        restricted = edge(k("some", "only", "someand"), a, prop, b)
        second = edge(k("someand"), a, prop, n)
        domain = k("domain").select("onto", "prop", F.col("b").alias("d"))
        dr = domain.join(k("range").select("onto", "prop", F.col("b").alias("r")), ["onto", "prop"])
        plain = restricted.union(second).union(edge(dr, F.col("d"), prop, F.col("r"))).union(edge(k("fact"), a, prop, b))
        inverse = k("inverse").select("onto", F.col("a").alias("p"), F.col("b").alias("q"))
        inverse = inverse.union(inverse.select("onto", "q", "p")).distinct()
        above = k("subprop").select("onto", F.col("a").alias("p"), F.col("b").alias("q"))
        turned = plain.join(inverse, ["onto", "p"]).select("onto", F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"))
        equal = k("eqprop").select("onto", F.col("a").alias("p"), F.col("b").alias("q"))
        above = above.union(equal).union(equal.select("onto", "q", "p")).distinct()
        lifted = plain.join(above, ["onto", "p"]).select("onto", "s", F.col("q").alias("p"), "o")
        parts += [plain, turned, lifted, edge(k("same"), a, F.lit("sameAs"), b)]
        if literals:
            parts.append(edge(k("annotation"), a, prop, b))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    if both_ways:
        out = out.union(inverse_taxonomy(out))
    return out.distinct()


def inverse_taxonomy(edges: DataFrame) -> DataFrame:
    name = F.when(F.col("p") == "subClassOf", "superClassOf").when(F.col("p") == "type", "typeOf")
    return edges.filter(F.col("p").isin("subClassOf", "type")).select("onto", F.col("o").alias("s"), name.alias("p"), F.col("s").alias("o"))


def propagate_domains(edges: DataFrame, axioms: DataFrame) -> DataFrame:
    """Types that domains and ranges give to the ends of edges."""
    d = axioms.filter("kind = 'domain'").select("onto", F.col("prop").alias("p"), F.col("b").alias("c"))
    r = axioms.filter("kind = 'range'").select("onto", F.col("prop").alias("p"), F.col("b").alias("c"))
    left = edges.join(d, ["onto", "p"]).select("onto", "s", F.lit("type").alias("p"), F.col("c").alias("o"))
    right = edges.join(r, ["onto", "p"]).select("onto", F.col("o").alias("s"), F.lit("type").alias("p"), F.col("c").alias("o"))
    return left.union(right).distinct()


def annotation_index(triples: DataFrame, predicates: Sequence[str] = ("label",)) -> DataFrame:
    """``(s, labels)``: the distinct labels of each subject, sorted."""
    return triples.filter(F.lower("p").isin(*predicates)).groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("labels"))


def documents_of(edges: DataFrame, labels: DataFrame, most: int = 5) -> DataFrame:
    """``(kind, sentence)``: every edge as a sentence of names, and as one of words, for up to ``most`` combinations of both ends' labels."""
    uri = edges.select(F.lit("uri").alias("kind"), F.concat_ws(" ", "s", "p", "o").alias("sentence"))
    own = lambda c: F.array(F.array_join(X.camel_words(F.col(c)), " "))
    both = edges.join(labels.select("s", F.col("labels").alias("ls")), "s", "left").join(labels.select(F.col("s").alias("o"), F.col("labels").alias("lo")), "o", "left")
    ls, lo = F.coalesce("ls", own("s")), F.coalesce("lo", own("o"))
    pairs = F.flatten(F.transform(ls, lambda x: F.transform(lo, lambda y: F.concat_ws(" ", x, F.array_join(X.camel_words(F.col("p")), " "), y))))
    words = both.select(F.lit("literal").alias("kind"), F.explode(F.slice(pairs, 1, most)).alias("sentence"))
    return uri.union(words)


def tbox(triples: DataFrame, kinds: Sequence[str] = ("Class", "ObjectProperty", "DataProperty"), predicates: Sequence[str] = ("SubClassOf", "EquivalentTo", "DisjointWith", "Domain", "Range", "SubPropertyOf")) -> DataFrame:
    """Triples of schema-typed subjects, and schema triples that touch one of those."""
    terms = triples.filter((F.col("p") == "is") & F.col("o").isin(*kinds)).select("onto", F.col("s").alias("t")).distinct()
    about = triples.join(terms.withColumnRenamed("t", "s"), ["onto", "s"], "left_semi")
    touching = triples.filter(F.col("p").isin(*predicates)).join(terms.withColumnRenamed("t", "o"), ["onto", "o"], "left_semi").select(*triples.columns)
    return about.select(*triples.columns).union(touching).distinct()


def local_part(triples: DataFrame, prefixes: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """``(part, s, p, o)``: triples whose subject begins with a part's prefix ``(part, prefix)`` and whose object is of no excluded kind."""
    rows = triples.join(prefixes, F.col("s").startswith(F.col("prefix")))
    for x in excluded:
        rows = rows.filter(~F.col("o").startswith(x))
    return rows.select("part", "s", "p", "o")


def referenced_tbox(schema: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """Schema triples reachable from the seed terms: a triple belongs once its subject does, and brings its object."""
    from truthframe.operators.graphs import closure

    terms = closure(schema.select(F.col("s").alias("src"), F.col("o").alias("dst")), seeds, rounds)
    return schema.join(terms.withColumnRenamed("node", "s"), "s", "left_semi")


# syntactic locality: expressions as nested lists, e.g. ["some", "r", ["class", "A"]]


def _outside(name: str, signature: set) -> bool:
    return name not in signature


def negative(e: list, signature: set, bottom: bool = True) -> bool:
    """Whether an expression is surely empty when names outside the signature are read as bottom (or top)."""
    op = e[0]
    if op == "class":
        return e[1] == "Nothing" or (e[1] != "Thing" and bottom and _outside(e[1], signature))
    if op == "and":
        return any(negative(x, signature, bottom) for x in e[1:])
    if op == "or":
        return all(negative(x, signature, bottom) for x in e[1:])
    if op == "not":
        return positive(e[1], signature, bottom)
    if op == "some":
        return negative(e[2], signature, bottom) or (bottom and _outside(e[1], signature))
    if op == "only":
        return not bottom and negative(e[2], signature, bottom) and _outside(e[1], signature)
    if op == "min":
        return e[1] > 0 and (negative(e[3], signature, bottom) or (bottom and _outside(e[2], signature)))
    if op == "max":
        return not bottom and _outside(e[2], signature) and positive(e[3], signature, bottom)
    if op == "exactly":
        return e[1] > 0 and bottom and _outside(e[2], signature)
    return False  # enumerations and what else there is


def positive(e: list, signature: set, bottom: bool = True) -> bool:
    """Whether an expression surely holds of everything."""
    op = e[0]
    if op == "class":
        return e[1] == "Thing" or (e[1] != "Nothing" and not bottom and _outside(e[1], signature))
    if op == "and":
        return all(positive(x, signature, bottom) for x in e[1:])
    if op == "or":
        return any(positive(x, signature, bottom) for x in e[1:])
    if op == "not":
        return negative(e[1], signature, bottom)
    if op == "some":
        return not bottom and _outside(e[1], signature) and positive(e[2], signature, bottom)
    if op == "only":
        return positive(e[2], signature, bottom) or (bottom and _outside(e[1], signature))
    if op == "min":
        return e[1] <= 0 or (e[1] == 1 and not bottom and _outside(e[2], signature) and positive(e[3], signature, bottom))
    if op == "max":
        # of an empty class or an empty property there are never more than n
        return negative(e[3], signature, bottom) or (bottom and _outside(e[2], signature))
    return False


def is_local(axiom: list, signature: set, bottom: bool = True, ignore_assertions: bool = False) -> bool:
    """Whether an axiom says nothing about the signature. Kinds that aren't known are never local."""
    kind, *x = axiom
    neg, pos = lambda e: negative(e, signature, bottom), lambda e: positive(e, signature, bottom)
    out = lambda p: _outside(p, signature)
    if kind == "sub":
        return neg(x[0]) or pos(x[1])
    if kind == "eq":
        return all((neg(a) and neg(b)) or (pos(a) and pos(b)) for a, b in zip(x, x[1:]))
    if kind == "dis":
        return len(x) <= 1 or sum(not neg(e) for e in x) <= 1
    if kind == "disunion":
        return all((neg(x[0]) and neg(e)) for e in x[1:]) or (pos(x[0]) and any(map(pos, x[1:])) and sum(not neg(e) for e in x[1:]) <= 1)
    if kind == "type":
        return ignore_assertions or pos(x[0])
    if kind == "fact":
        return ignore_assertions or (not bottom and out(x[0]))
    if kind in ("same", "different"):
        return ignore_assertions
    if kind == "subprop":
        return out(x[0]) if bottom else out(x[1])
    if kind == "chain":
        return any(map(out, x[:-1])) if bottom else out(x[-1])
    if kind == "inverse":
        return out(x[0]) and out(x[1])
    if kind in ("transitive", "symmetric", "reflexive", "asymmetric", "irreflexive"):
        return out(x[0])
    if kind in ("functional", "inversefunctional"):
        return bottom and out(x[0])
    if kind == "eqprop":
        return all(map(out, x))
    if kind in ("domain", "range"):
        return pos(x[1]) or (bottom and out(x[0]))
    if kind == "datarange":
        return bottom and out(x[0])
    if kind == "declaration":
        return out(x[0])
    if kind == "annotation":
        return out(x[0])
    return False


def terms_of(axiom: list) -> list[str]:
    """Names of an axiom's classes and properties."""
    found: set[str] = set()

    def visit(e) -> None:
        if isinstance(e, str):
            found.add(e)
        elif isinstance(e, list):
            for x in e[1:]:
                visit(x)

    for x in axiom[1:]:
        visit(x)
    return sorted(found - {"Thing", "Nothing"})


@F.pandas_udf(ArrayType(StringType()))
def _axiom_terms(axioms: pd.Series) -> pd.Series:
    return axioms.map(lambda a: terms_of(json.loads(a)))


def axiom_terms(axioms: Column | str) -> Column:
    ship()
    return _axiom_terms(axioms)


def render(e: list) -> str:
    """A class expression in Manchester syntax, without brackets."""
    op, *x = e
    if op in ("and", "or"):
        return f" {op} ".join(map(render, x))
    if op in ("some", "only"):
        return f"{x[0]} {op} {render(x[1])}"
    if op in ("min", "max", "exactly"):
        return f"{x[1]} {op} {x[0]} {render(x[2])}"
    if op == "oneof":
        return "OneOf: " + ", ".join(map(str, x))
    return f"not {render(x[0])}" if op == "not" else str(x[0])


def render_axiom(axiom: list) -> str | None:
    """An axiom of a class or an individual as a line of Manchester syntax; null for other kinds, and for what is below everything or nothing."""
    kind, *x = axiom
    if kind in ("sub", "eq"):
        right = render(x[1])
        return None if right in ("Thing", "Nothing") else f"{render(x[0])} {'SubClassOf' if kind == 'sub' else 'EquivalentTo'} {right}"
    if kind == "type":
        return f"{x[1]} Type {render(x[0])}"
    return f"{x[1]} {x[0]} {x[2]}" if kind == "fact" and len(x) == 3 else None


@F.pandas_udf(StringType())
def _manchester(axioms: pd.Series) -> pd.Series:
    return axioms.map(lambda a: None if a is None else render_axiom(json.loads(a)))


def manchester(axiom: Column | str) -> Column:
    """``render_axiom`` of axioms as JSON lists."""
    ship()
    return _manchester(axiom)


def _local_udf(bottom: bool, ignore_assertions: bool):
    @F.pandas_udf(BooleanType())
    def local(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for axioms, known in batches:
            yield pd.Series([is_local(json.loads(a), set() if k is None else set(k), bottom, ignore_assertions) for a, k in zip(axioms, known)], dtype="bool")

    return local


def extract_module(axioms: DataFrame, seeds: DataFrame, bottom: bool = True, ignore_assertions: bool = False) -> DataFrame:
    """``(onto, axiom)``: for each ontology the axioms that aren't local to the growing signature, from the seeds ``(onto, term)``.

    An axiom's locality depends only on which of its own terms the signature has. Per round these are joined to the
    axioms not taken yet, the test runs on them, and the terms of what is taken join the signature.
    """
    local = _local_udf(bottom, ignore_assertions)
    rest = materialize(axioms.select("onto", "axiom").distinct().withColumn("terms", axiom_terms("axiom")).withColumn("id", F.xxhash64("onto", "axiom")), "axioms")
    signature = materialize(seeds.select("onto", "term").distinct(), "signature")
    module = None
    while True:
        used = rest.select("onto", "id", F.explode("terms").alias("term")).join(signature, ["onto", "term"]).groupBy("onto", "id").agg(F.collect_set("term").alias("known"))  # terms of one axiom
        judged = materialize(rest.join(used, ["onto", "id"], "left").withColumn("local", local("axiom", "known")).select("onto", "axiom", "terms", "id", "local"), "judged")
        taken = judged.filter("not local").select("onto", "axiom", "terms")
        if not taken.head(1):
            break
        module = taken.select("onto", "axiom") if module is None else module.union(taken.select("onto", "axiom"))
        drop_written(rest)
        rest = judged.filter("local").select("onto", "axiom", "terms", "id")
        signature = materialize(signature.union(taken.select("onto", F.explode("terms").alias("term"))).distinct(), "signature")
    return module if module is not None else axioms.select("onto", "axiom").limit(0)


# partitioning by cluster heads; (onto, child, parent) taxonomies


def concept_ranks(subclass: DataFrame, relations: DataFrame, equivalent: DataFrame) -> DataFrame:
    """``(onto, concept, rank)``: 0.3 subclasses + 0.3 superclasses + 0.3 properties + 0.1 equivalents, over the number of concepts.

    ``subclass`` is (onto, child, parent), ``relations`` (onto, s, p, o), ``equivalent`` (onto, a, b).
    """
    count = lambda df, c, weight: df.select("onto", F.col(c).alias("concept"), F.lit(weight).alias("w"))
    votes = count(subclass, "parent", 0.3).union(count(subclass, "child", 0.3)).union(count(relations, "s", 0.3)).union(count(relations, "o", 0.3)).union(count(equivalent, "a", 0.1)).union(count(equivalent, "b", 0.1))
    scored = votes.groupBy("onto", "concept").agg(F.sum("w").alias("v"))
    sizes = scored.groupBy("onto").agg(F.count("*").alias("n"))
    return scored.join(sizes, "onto").select("onto", "concept", (F.col("v") / F.col("n")).alias("rank"))


def cluster_count(ranks: DataFrame) -> DataFrame:
    """``(onto, k)``: 1 up to 40 concepts, else the rounded logarithm of their number times two."""
    n = ranks.groupBy("onto").agg(F.count("*").alias("n"))
    return n.select("onto", F.when(F.col("n") <= 40, 1).otherwise(F.round(F.log10(F.col("n")) * 2)).cast("int").alias("k"))


def cluster_heads(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """``(onto, head)``: the k best-ranked concepts, none of which is a neighbour ``(onto, src, dst)`` of a better one."""
    w = Window.partitionBy("onto").orderBy(F.col("rank").desc(), "concept")
    placed = ranks.withColumn("nth", F.row_number().over(w))
    better = edges.join(placed.select("onto", F.col("concept").alias("src"), F.col("nth").alias("n1")), ["onto", "src"]).join(placed.select("onto", F.col("concept").alias("dst"), F.col("nth").alias("n2")), ["onto", "dst"])
    beaten = better.select("onto", F.when(F.col("n1") < F.col("n2"), F.col("dst")).otherwise(F.col("src")).alias("concept")).distinct()
    free = placed.join(beaten, ["onto", "concept"], "left_anti").withColumn("nth", F.row_number().over(w))
    return free.join(cluster_count(ranks), "onto").filter(F.col("nth") <= F.col("k")).select("onto", F.col("concept").alias("head"))


def assign_clusters(concepts: DataFrame, heads: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """``(onto, concept, head)``: neighbours of a head go to it; others to the head with the highest membership.

    Membership is 0.4 of the shared neighbours, 0.2 of a direct edge and 0.4 of the names' likeness; ``strict`` takes the
    shared neighbours for none.
    """
    near = edges.select("onto", F.col("src").alias("c"), F.col("dst").alias("m")).union(edges.select("onto", "dst", "src")).distinct()
    pairs = concepts.join(heads, "onto")  # heads are a few per ontology
    of_c = near.select("onto", F.col("c").alias("concept"), "m").join(near.select("onto", F.col("c").alias("head"), "m").join(heads, ["onto", "head"], "left_semi"), ["onto", "m"])
    shared = of_c.groupBy("onto", "concept", "head").agg(F.count("*").alias("shared"))
    degree = near.groupBy("onto", F.col("c").alias("concept")).agg(F.count("*").alias("degree"))
    direct = near.select("onto", F.col("c").alias("concept"), F.col("m").alias("head"), F.lit(1.0).alias("direct"))
    both = pairs.join(shared, ["onto", "concept", "head"], "left").join(degree, ["onto", "concept"], "left").join(direct, ["onto", "concept", "head"], "left")
    struct = F.lit(0.0) if strict else F.coalesce(F.col("shared") / F.col("degree"), F.lit(0.0))
    member = 0.4 * struct + 0.2 * F.coalesce("direct", F.lit(0.0)) + 0.4 * X.edit_similarity(F.lower("concept"), F.lower("head"))
    member = F.when(F.col("concept") == F.col("head"), 2.0).when(F.col("direct").isNotNull(), 1 + member).otherwise(member)
    best = F.max(F.struct(F.round(member, 9).alias("m"), "head")).alias("best")
    return both.groupBy("onto", "concept").agg(best).select("onto", "concept", "best.head")


def module_quality(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """``(onto, head, size, share, homogeneity, heterogeneity)``: edges within a module over its possible ones, and the share of its edges that leave it."""
    m = assigned.select("onto", F.col("concept").alias("src"), F.col("head").alias("h1"))
    e = edges.join(m, ["onto", "src"]).join(m.toDF("onto", "dst", "h2"), ["onto", "dst"])
    inside = e.filter("h1 = h2").groupBy("onto", F.col("h1").alias("head")).agg(F.count("*").alias("inside"))
    leaving = e.filter("h1 != h2").select("onto", F.explode(F.array("h1", "h2")).alias("head")).groupBy("onto", "head").agg(F.count("*").alias("leaving"))
    sizes = assigned.groupBy("onto", "head").agg(F.count("*").alias("size"))
    total = assigned.groupBy("onto").agg(F.count("*").alias("total"))
    out = sizes.join(total, "onto").join(inside, ["onto", "head"], "left").join(leaving, ["onto", "head"], "left").fillna(0, ["inside", "leaving"])
    possible = F.col("size") * (F.col("size") - 1)
    all_edges = F.col("inside") + F.col("leaving")
    return out.select(
        "onto", "head", "size", (F.col("size") / F.col("total")).alias("share"), F.when(possible > 0, F.col("inside") / possible).otherwise(0.0).alias("homogeneity"), F.when(all_edges > 0, F.col("leaving") / all_edges).otherwise(0.0).alias("heterogeneity")
    )


#: Pairs of blocks that one task takes to finish the merging of ``agglomerate`` by itself.
COUPLED = 2_000_000


def _lot(a, b, modulo: Callable = np.mod):
    """A number that decides between equally good pairs, of arrays or columns: without a lot, one block after the other would win them all."""
    p = 2147483647
    return modulo(modulo(a, p) * 48271 + modulo(b, p) * 69621, p)


def _merged(b1: np.ndarray, b2: np.ndarray, links: np.ndarray, size: np.ndarray, largest: int, names: np.ndarray) -> np.ndarray:
    """The block that each block ends in, after all rounds over the pairs b1 != b2, both ways round; blocks are numbered in the order of their names."""
    every = into = np.arange(len(size))
    order = np.lexsort((b2, b1))
    b1, b2, links = b1[order], b2[order], links[order]
    while True:
        fits = size[b1] + size[b2] <= largest  # blocks only grow, so what doesn't fit never will
        b1, b2, links = b1[fits], b2[fits], links[fits]
        if not len(b1):
            return into
        # of each block's pairs, which stand together, the best coupled; of several, by the names of both
        starts = np.nonzero(np.append(True, b1[1:] != b1[:-1]))[0]
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(b1))))
        chosen = np.ones(len(b1), bool)
        low, high = np.minimum(b1, b2), np.maximum(b1, b2)
        for worth in (np.round(links / np.log(size[b1] * size[b2] + 1.0), 12), _lot(names[low], names[high]), -high, -low):
            worth = np.where(chosen, worth, -np.inf)
            chosen &= worth == np.maximum.reduceat(worth, starts)[run]
        best = np.full(len(size), -1)
        best[b1[chosen]] = b2[chosen]
        met = every[(best >= 0) & (best < every)]
        met = met[best[best[met]] == met]
        step = every.copy()
        step[met] = best[met]
        np.add.at(size, step[met], size[met])
        into = step[into]
        b1, b2 = step[b1], step[b2]
        apart = b1 != b2
        keys, at = np.unique(b1[apart] * len(size) + b2[apart], return_inverse=True)
        links = np.bincount(at, links[apart], len(keys))
        b1, b2 = keys // len(size), keys % len(size)


def _finish_merging(largest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        rows = pa.Table.from_batches(found)
        b1, b2, links, s1, s2 = (rows.column(c).to_numpy() for c in ("b1", "b2", "links", "s1", "s2"))
        names, at = np.unique(np.concatenate((b1, b2)), return_inverse=True)
        size = np.zeros(len(names), np.int64)
        size[at] = np.concatenate((s1, s2))
        into = _merged(at[: len(b1)], at[len(b1) :], links.astype(float), size, largest, names)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[into])], names=["block", "into"])

    return run


def agglomerate(edges: DataFrame, largest: int) -> DataFrame:
    """``(node, block)``: blocks grown by merging, in each round, every block with the one it is best coupled to where the wish is mutual, until none can grow.

    Coupling is the number of edges between two blocks over the logarithm of the product of their sizes; no block
    grows beyond ``largest``. Nodes are whole numbers, and a block has the name of its smallest. Mutual best pairs are
    independent, so a round is one pass of joins over the pairs of blocks that may still merge; once there are no more than
    ``COUPLED``, one task does the remaining rounds.
    """
    from truthframe.operators.graphs import undirected

    e = undirected(edges).filter("src != dst")
    pairs = materialize(e.groupBy(F.col("src").cast("long").alias("b1"), F.col("dst").cast("long").alias("b2")).agg(F.count("*").alias("links")), "pairs")
    blocks = materialize(pairs.select(F.col("b1").alias("node"), F.col("b1").alias("block")).distinct(), "blocks")
    while True:
        sizes = blocks.groupBy("block").agg(F.count("*").alias("size"))
        fitting = pairs.join(sizes.toDF("b1", "s1"), "b1").join(sizes.toDF("b2", "s2"), "b2").filter(F.col("s1") + F.col("s2") <= largest)
        scored = materialize(fitting.select("b1", "b2", "links", "s1", "s2"), "scored")
        left = scored.count()
        if left <= COUPLED:
            step = materialize(map_arrow(scored.repartition(1), _finish_merging(largest), "block long, into long"), "steps") if left else None
        else:
            good = F.round(F.col("links") / F.log(F.col("s1") * F.col("s2") + 1.0), 12)
            best = scored.withColumn("good", good).groupBy("b1").agg(F.max(F.struct("good", _lot(F.least("b1", "b2"), F.greatest("b1", "b2"), lambda x, p: F.pmod(x, F.lit(p))).alias("lot"), (-F.greatest("b1", "b2")).alias("t"), (-F.least("b1", "b2")).alias("v"), "b2")).alias("x")).select("b1", F.col("x.b2").alias("b2"))
            step = materialize(best.join(best.toDF("b2", "back"), "b2").filter("back = b1 and b1 > b2").select(F.col("b1").alias("block"), F.col("b2").alias("into")), "steps")
        drop_written(pairs)
        if step is None:
            return blocks
        of = lambda df, c: df.join(step.toDF(c, "into__"), c, "left").withColumn(c, F.coalesce("into__", c)).drop("into__")
        then = materialize(of(blocks, "block").select("node", "block"), "blocks")
        drop_written(blocks)
        blocks = then
        if left <= COUPLED:
            return blocks
        merged = of(of(scored, "b1"), "b2").filter("b1 != b2")
        pairs = materialize(merged.groupBy("b1", "b2").agg(F.sum("links").alias("links")), "pairs")
        drop_written(scored)


def attach_orphans(nodes: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a block join the one most of their neighbours are in."""
    free = nodes.join(blocks.select("node"), "node", "left_anti")
    near = free.withColumnRenamed("node", "src").join(edges.select("src", "dst"), "src").join(blocks.toDF("dst", "block"), "dst").groupBy("src", "block").agg(F.count("*").alias("n"))
    best = near.groupBy(F.col("src").alias("node")).agg(F.max(F.struct("n", (-F.col("block")).alias("t"), "block")).alias("x")).select("node", "x.block")
    return blocks.select("node", "block").union(best)


def overlaps(members: DataFrame, least: int = 1) -> DataFrame:
    """``(m1, m2, shared, jaccard)`` of modules ``(module, class)`` that share at least so many classes; a class in very many modules pairs them all."""
    m = members.select("module", "class").distinct()
    sizes = m.groupBy("module").agg(F.count("*").alias("n"))
    pairs = m.toDF("m1", "class").join(m.toDF("m2", "class"), "class").filter("m1 < m2").groupBy("m1", "m2").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    both = pairs.join(sizes.toDF("m1", "n1"), "m1").join(sizes.toDF("m2", "n2"), "m2")
    return both.select("m1", "m2", "shared", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("jaccard"))


# metrics and merging


def statistics(axioms: DataFrame) -> DataFrame:
    """Classes, properties, individuals and axioms of each kind in an ontology."""
    k = F.col("kind")
    names = lambda cond, c: F.when(cond, F.col(c))
    cls = axioms.select("onto", F.explode(F.array(names(k.isin("sub", "eq", "dis", "some", "only", "max1", "someand"), "a"), names(k.isin("sub", "eq", "dis", "some", "only", "someand", "domain", "range", "type"), "b"))).alias("x")).filter("x is not null")
    props = axioms.select("onto", F.explode(F.array(F.col("prop"), names(k.isin("subprop", "inverse"), "a"), names(k.isin("subprop", "inverse"), "b"))).alias("x")).filter("x is not null")
    ind = axioms.select("onto", F.explode(F.array(names(k.isin("type", "fact"), "a"), names(k == "fact", "b"))).alias("x")).filter("x is not null")
    out = axioms.groupBy("onto").agg(F.count_if(k == "sub").alias("subclasses"), F.count_if(k == "eq").alias("equivalents"), F.count_if(k == "dis").alias("disjoints"), F.count_if(k == "type").alias("types"), F.count_if(k == "fact").alias("facts"))
    for df, name in ((cls, "classes"), (props, "properties"), (ind, "individuals")):
        out = out.join(df.distinct().groupBy("onto").agg(F.count("*").alias(name)), "onto", "left").fillna(0, [name])
    return out


def richness(stats: DataFrame) -> DataFrame:
    """``(onto, relationship, inheritance, population, design)``, rounded to 2 digits; design weighs them 0.3, 0.3 and 0.4."""
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rel = div(F.col("properties"), F.col("subclasses") + F.col("properties"))
    inh = div(F.col("subclasses"), F.col("classes"))
    pop = div(F.col("individuals"), F.col("classes"))
    r = lambda c, n: F.round(c, 2).alias(n)
    return stats.select("onto", r(rel, "relationship"), r(inh, "inheritance"), r(pop, "population"), r(0.3 * rel + 0.3 * inh + 0.4 * pop, "design"))


def knowledge_richness(stats: DataFrame, described: DataFrame) -> DataFrame:
    """``(onto, readability, knowledge)``: comments and labels of classes and annotation properties, ``(onto, annotations)``, over the number of classes,
    and its mean with the population and a third term that is always 0; both bounded by 1 and rounded to 2 digits."""
    most = lambda c: F.least(F.lit(1.0), c)
    rows = stats.join(described, "onto", "left").filter("classes > 0")
    readability = most(F.coalesce("annotations", F.lit(0)) / F.col("classes"))
    population = most(F.col("individuals") / F.col("classes"))
    return rows.select("onto", F.round(readability, 2).alias("readability"), F.round((population + readability) / 3, 2).alias("knowledge"))


def class_richness(subclass: DataFrame, classes: DataFrame) -> DataFrame:
    """``(onto, connected, adjacency, richness)`` of ``(onto, child, parent)`` and ``(onto, c)``: the share of classes that have a superclass, the mean over
    classes of their squared neighbourhood (subclasses, superclasses and these' superclasses) over their number, and the mean of both; bounded by 1, rounded to 2 digits."""
    e = subclass.select("onto", "child", "parent").filter("child != parent").distinct()
    up = e.groupBy("onto", F.col("child").alias("c")).agg(F.count("*").alias("ups"))
    down = e.groupBy("onto", F.col("parent").alias("c")).agg(F.count("*").alias("downs"))
    far = e.join(up.select("onto", F.col("c").alias("parent"), "ups"), ["onto", "parent"]).groupBy("onto", F.col("child").alias("c")).agg(F.sum("ups").alias("fars"))
    rows = classes.select("onto", "c").distinct().join(up, ["onto", "c"], "left").join(down, ["onto", "c"], "left").join(far, ["onto", "c"], "left").fillna(0, ["ups", "downs", "fars"])
    near = F.col("ups") + F.col("downs") + F.col("fars")
    out = rows.groupBy("onto").agg(F.count("*").alias("n"), F.count_if(F.col("ups") > 0).alias("below"), F.sum(near * near).alias("near"))
    connected, adjacency = F.col("below") / F.col("n"), F.least(F.lit(1.0), F.col("near") / (F.col("n") * F.col("n")))
    return out.select("onto", F.round(connected, 2).alias("connected"), F.round(adjacency, 2).alias("adjacency"), F.round((connected + adjacency) / 2, 2).alias("richness"))


def connectivity(stats_edges: DataFrame) -> DataFrame:
    """``(onto, class, degree)``: relations of each class, from projected edges without the taxonomy."""
    e = stats_edges.filter(~F.col("p").isin("subClassOf", "superClassOf", "type", "typeOf"))
    return e.select("onto", F.explode(F.array("s", "o")).alias("class")).groupBy("onto", "class").agg(F.count("*").alias("degree"))


def match_names(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """``(a, b, likeness)``: a one-to-one matching of names, best first, among the pairs of likeness ``least`` or more.

    Greedy by mutual best: in each round every name that is its best partner's best is matched, and taken away, until
    no pair is left. Names of three and more letters that have no three consecutive ones in common are at -0.6 or below,
    so others meet at what they share; names of one or two letters, or of none but silent ones, meet all.
    """
    a = left.select(F.col(left.columns[0]).alias("a")).distinct()
    b = right.select(F.col(right.columns[0]).alias("b")).distinct()
    if least <= -0.6:
        pairs = a.crossJoin(b)
    else:
        bare = lambda c: F.regexp_replace(F.lower(c), "[._ ]", "")
        few = lambda c: (F.length(c) <= 2) | (bare(c) == "")
        grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(bare(c)) - 2), lambda i: F.substring(bare(c), i, F.lit(3))))
        long = lambda df, c: df.filter(~few(c) & (F.length(bare(c)) > 2)).withColumn("k", F.explode(grams(c)))
        short = a.filter(few("a")).crossJoin(b).union(a.crossJoin(b.filter(few("b"))))
        pairs = long(a, "a").join(long(b, "b"), "k").select("a", "b").union(short).distinct()
    scored = materialize(pairs.withColumn("likeness", F.round(X.isub("a", "b"), 9)).filter(F.col("likeness") >= least), "pairs")
    out = None
    while True:
        best_a = scored.groupBy("a").agg(F.max(F.struct("likeness", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
        best_b = scored.groupBy("b").agg(F.max(F.struct("likeness", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
        pick = materialize(scored.join(best_a, ["a", "b"], "left_semi").join(best_b, ["a", "b"], "left_semi"), "matched")
        if not pick.head(1):
            break
        out = pick if out is None else out.union(pick)
        scored = materialize(scored.join(pick.select("a"), "a", "left_anti").join(pick.select("b"), "b", "left_anti").select("a", "b", "likeness"), "pairs")
    return out if out is not None else scored.select("a", "b", "likeness")


def merge_by_mapping(axioms: DataFrame, mapping: DataFrame, how: str = "rename") -> DataFrame:
    """Axioms of two ontologies as one: mapped names ``(b, a)`` renamed, or tied by a subclass (``sub``) or equivalence (``eq``) axiom."""
    rows = axioms.select("kind", "a", "prop", "b", "n")
    m = mapping.select(F.col("b").alias("from"), F.col("a").alias("to"))
    if how != "rename":
        none = F.lit(None).cast("string")
        return rows.union(m.select(F.lit(how), "from", none, "to", none)).distinct()
    for c in ("a", "prop", "b", "n"):
        rows = rows.join(m.toDF(c, "to__"), c, "left").withColumn(c, F.coalesce("to__", c)).drop("to__")
    return rows.select("kind", "a", "prop", "b", "n").distinct()


def merge_quality(inputs: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: the share of the inputs' class names that the merged ontology has, and the share of its names that say the same as another after normalisation."""
    names = lambda df: df.select(F.explode(F.array("a", "b")).alias("x")).filter("x is not null").distinct()
    ours, theirs = names(merged), names(inputs)
    found = theirs.join(ours.withColumn("in__", F.lit(1)), "x", "left").agg((F.count("in__") / F.count("*")).alias("coverage"))
    same = ours.groupBy(X.plain_name(F.col("x")).alias("k")).agg(F.count("*").alias("n")).agg((F.sum(F.col("n") - 1) / F.sum("n")).alias("redundancy"))
    return found.crossJoin(same)


def path_redundancy(inputs: DataFrame, merged: DataFrame, mapped: int) -> DataFrame:
    """One row: subclass axioms of the inputs less the ``mapped`` names, over those of the merged ontology (null if it has none)."""
    steps = lambda df, name: df.filter("kind = 'sub'").agg(F.count("*").alias(name))
    both = steps(inputs, "before").crossJoin(steps(merged, "after"))
    return both.select("before", "after", F.when(F.col("after") > 0, (F.col("before") - mapped) / F.col("after")).alias("redundancy"))


def consistency_by_patterns(axioms: DataFrame) -> DataFrame:
    """``(onto, patterns)`` of ontologies in which an inconsistency pattern stands whole."""
    from truthframe.operators.patterns import PATTERNS, detect

    out = None
    for p in PATTERNS:
        one = detect(axioms, p).select("onto", F.lit(p).alias("pattern")).distinct()
        out = one if out is None else out.union(one)
    return out.groupBy("onto").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
