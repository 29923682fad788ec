"""Inconsistency patterns, projection and ontology metrics over axioms derived from parts and suppliers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from truthframe.operators import ontology as O
from truthframe.operators import patterns as P
from truthframe.plans.registry import query
from truthframe.session import materialize, table

# every part is an axiom of one of 20 ontologies, over eight classes, three properties and nine individuals
KINDS = ("sub", "sub", "some", "only", "some", "only", "max1", "eq", "dis", "dis", "subprop", "inverse", "domain", "range", "type", "fact", "someand", "someand", "some")

_AXIOMS = f"""(WITH p AS (SELECT p_partkey AS k, {list(KINDS)}[p_partkey % {len(KINDS)} + 1] AS kind, p_partkey * 7 // 5 % 20 AS o, (p_partkey * 13 // 17 + p_size) % 8 AS x, (p_partkey * 31 // 19) % 8 AS y, p_size % 3 AS r, (p_partkey * 11 // 23) % 8 AS z FROM part)
SELECT DISTINCT 'O' || o AS onto, kind,
  CASE WHEN kind IN ('subprop', 'inverse') THEN 'R' || r WHEN kind IN ('domain', 'range') THEN NULL WHEN kind IN ('type', 'fact') THEN 'I' || x ELSE 'C' || x END AS a,
  CASE WHEN kind IN ('some', 'only', 'max1', 'domain', 'range', 'fact', 'someand') THEN 'R' || r END AS prop,
  CASE WHEN kind = 'max1' THEN NULL WHEN kind IN ('subprop', 'inverse') THEN 'R' || (r + 1) % 3 WHEN kind = 'fact' THEN 'I' || y ELSE 'C' || y END AS b,
  CASE WHEN kind = 'someand' THEN 'C' || z END AS n FROM p)"""


def _axioms(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*(F.lit(x) for x in KINDS)), (k % len(KINDS) + 1).cast("int"))
    whole = lambda c: F.floor(c).cast("long")
    p = table(spark, d, "part").select(kind.alias("kind"), (whole(k * 7 / 5) % 20).alias("o"), ((whole(k * 13 / 17) + size) % 8).alias("x"), (whole(k * 31 / 19) % 8).alias("y"), (size % 3).alias("r"), (whole(k * 11 / 23) % 8).alias("z"))
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    kd, c = F.col("kind"), F.col
    a = F.when(kd.isin("subprop", "inverse"), name("R", c("r"))).when(kd.isin("domain", "range"), None).when(kd.isin("type", "fact"), name("I", c("x"))).otherwise(name("C", c("x")))
    prop = F.when(kd.isin("some", "only", "max1", "domain", "range", "fact", "someand"), name("R", c("r")))
    b = F.when(kd == "max1", None).when(kd.isin("subprop", "inverse"), name("R", (c("r") + 1) % 3)).when(kd == "fact", name("I", c("y"))).otherwise(name("C", c("y")))
    return p.select(name("O", c("o")).alias("onto"), "kind", a.alias("a"), prop.alias("prop"), b.alias("b"), F.when(kd == "someand", name("C", c("z"))).alias("n")).distinct()


_BOTH = f"ax AS (SELECT onto, kind, a, prop, b, n FROM {_AXIOMS} UNION SELECT onto, kind, b, prop, a, n FROM {_AXIOMS} WHERE kind IN ('eq', 'dis', 'inverse'))"


# where the columns of a kind's axioms go, for SQL written as kind(names)
_COLUMNS = {"sub": "a b", "eq": "a b", "dis": "a b", "some": "a prop b", "only": "a prop b", "someand": "a prop b n", "max1": "a prop", "subprop": "a b", "inverse": "a b", "domain": "prop b", "range": "prop b", "type": "a b", "fact": "a prop b"}


def _join(text):
    """FROM clause of a text such as ``only(c1, r, c2), dis(c2, c3)``: axioms of each kind, joined on equal names."""
    parts = []
    for kind, names in re.findall(r"(\w+)\(([^)]*)\)", text):
        columns = ", ".join(f"{c} AS {n.strip()}" for c, n in zip(_COLUMNS[kind].split(), names.split(","), strict=True))
        parts.append(f"(SELECT DISTINCT onto, {columns} FROM ax WHERE kind = '{kind}')")
    return " NATURAL JOIN ".join(parts)


# each pattern whole: its axioms, and what must differ
_WHOLE = {
    "EID": ("eq(c1, c2), dis(c1, c2)", "c1 <> c2"),
    "AIO": ("some(c1, r, c2), someand(c1, r, c2, c3), dis(c2, c3)", "c2 <> c3"),
    "OIL": ("only(c1, r, c2), only(c1, r, c3), dis(c2, c3)", "c2 <> c3"),
    "OILWI": ("sub(c1, c2), only(c1, r, c3), only(c2, r, c4), dis(c3, c4)", "c1 <> c2 AND c3 <> c4"),
    "OILWPI": ("subprop(r1, r2), only(c1, r1, c2), only(c1, r2, c3), dis(c2, c3)", "c2 <> c3"),
    "UE": ("only(c1, r, c2), some(c1, r, c3), dis(c2, c3)", "c2 <> c3"),
    "UEWI1": ("sub(c1, c2), some(c1, r, c3), only(c2, r, c4), dis(c3, c4)", "c1 <> c2 AND c3 <> c4"),
    "UEWI2": ("sub(c1, c2), some(c2, r, c3), only(c1, r, c4), dis(c3, c4)", "c1 <> c2 AND c3 <> c4"),
    "UEWPI": ("subprop(r1, r2), some(c1, r1, c2), only(c1, r2, c3), dis(c2, c3)", "c2 <> c3"),
    "UEWIP": ("some(c2, r1, c1), inverse(r1, r2), only(c1, r2, c3), dis(c2, c3)", "c2 <> c3"),
    "SOSINETO": ("some(c1, r, c2), some(c1, r, c3), max1(c1, r), dis(c2, c3)", "c2 <> c3"),
    "CSC": ("sub(c1, c3), sub(c3, c2), sub(c2, c1)", "c1 <> c2 AND c2 <> c3 AND c1 <> c3"),
    "OOD": ("domain(p, c1), fact(i, p, j), type(i, c2), dis(c1, c2)", "c1 <> c2"),
    "OOR": ("range(p, c1), fact(i, p, j), type(j, c2), dis(c1, c2)", "c1 <> c2"),
}

# each pattern but for one axiom: that axiom (kind, a, prop, b, n), what is there, and what must differ
_BUT_ONE = {
    "EID": [("eq c1 - c2 -", "dis(c1, c2)", "c1 <> c2"), ("dis c1 - c2 -", "eq(c1, c2)", "c1 <> c2")],
    "AIO": [("some c1 r c2 -", "someand(c1, r, c2, c3), dis(c2, c3)", "c2 <> c3"), ("someand c1 r c2 c3", "some(c1, r, c2), dis(c2, c3)", "c2 <> c3"), ("dis c2 - c3 -", "some(c1, r, c2), someand(c1, r, c2, c3)", "c2 <> c3")],
    "OIL": [("only c1 r c2 -", "only(c1, r, c3), dis(c2, c3)", "c2 <> c3"), ("dis c2 - c3 -", "only(c1, r, c2), only(c1, r, c3)", "c2 <> c3")],
    "OILWI": [
        ("sub c1 - c2 -", "only(c1, r, c3), dis(c3, c4), only(c2, r, c4)", "c1 <> c2 AND c3 <> c4"), ("only c1 r c3 -", "sub(c1, c2), only(c2, r, c4), dis(c3, c4)", "c1 <> c2 AND c3 <> c4"),
        ("only c2 r c4 -", "sub(c1, c2), only(c1, r, c3), dis(c3, c4)", "c1 <> c2 AND c3 <> c4"), ("dis c3 - c4 -", "sub(c1, c2), only(c1, r, c3), only(c2, r, c4)", "c1 <> c2 AND c3 <> c4"),
    ],
    "OILWPI": [
        ("subprop r1 - r2 -", "only(c1, r1, c2), dis(c2, c3), only(c1, r2, c3)", "c2 <> c3"), ("only c1 r1 c2 -", "subprop(r1, r2), only(c1, r2, c3), dis(c2, c3)", "c2 <> c3"),
        ("only c1 r2 c3 -", "subprop(r1, r2), only(c1, r1, c2), dis(c2, c3)", "c2 <> c3"), ("dis c2 - c3 -", "subprop(r1, r2), only(c1, r1, c2), only(c1, r2, c3)", "c2 <> c3"),
    ],
    "UE": [("only c1 r c2 -", "some(c1, r, c3), dis(c2, c3)", "c2 <> c3"), ("some c1 r c3 -", "only(c1, r, c2), dis(c2, c3)", "c2 <> c3"), ("dis c2 - c3 -", "only(c1, r, c2), some(c1, r, c3)", "c2 <> c3")],
    "UEWI1": [
        ("sub c1 - c2 -", "some(c1, r, c3), dis(c3, c4), only(c2, r, c4)", "c1 <> c2 AND c3 <> c4"), ("some c1 r c3 -", "sub(c1, c2), only(c2, r, c4), dis(c3, c4)", "c1 <> c2 AND c3 <> c4"),
        ("only c2 r c4 -", "sub(c1, c2), some(c1, r, c3), dis(c3, c4)", "c1 <> c2 AND c3 <> c4"), ("dis c3 - c4 -", "sub(c1, c2), some(c1, r, c3), only(c2, r, c4)", "c1 <> c2 AND c3 <> c4"),
    ],
    "UEWI2": [
        ("sub c1 - c2 -", "only(c1, r, c4), dis(c3, c4), some(c2, r, c3)", "c1 <> c2 AND c3 <> c4"), ("some c2 r c3 -", "sub(c1, c2), only(c1, r, c4), dis(c3, c4)", "c1 <> c2 AND c3 <> c4"),
        ("only c1 r c4 -", "sub(c1, c2), some(c2, r, c3), dis(c3, c4)", "c1 <> c2 AND c3 <> c4"), ("dis c3 - c4 -", "sub(c1, c2), some(c2, r, c3), only(c1, r, c4)", "c1 <> c2 AND c3 <> c4"),
    ],
    "UEWPI": [
        ("subprop r1 - r2 -", "some(c1, r1, c2), dis(c2, c3), only(c1, r2, c3)", "c2 <> c3"), ("some c1 r1 c2 -", "subprop(r1, r2), only(c1, r2, c3), dis(c2, c3)", "c2 <> c3"),
        ("only c1 r2 c3 -", "subprop(r1, r2), some(c1, r1, c2), dis(c2, c3)", "c2 <> c3"), ("dis c2 - c3 -", "subprop(r1, r2), some(c1, r1, c2), only(c1, r2, c3)", "c2 <> c3"),
    ],
    "UEWIP": [
        ("some c2 r1 c1 -", "inverse(r1, r2), only(c1, r2, c3), dis(c2, c3)", "c2 <> c3"), ("only c1 r2 c3 -", "some(c2, r1, c1), inverse(r1, r2), dis(c2, c3)", "c2 <> c3"),
        ("inverse r1 - r2 -", "some(c2, r1, c1), dis(c2, c3), only(c1, r2, c3)", "c2 <> c3"), ("dis c2 - c3 -", "some(c2, r1, c1), inverse(r1, r2), only(c1, r2, c3)", "c2 <> c3"),
    ],
    "SOSINETO": [
        ("some c1 r c2 -", "some(c1, r, c3), max1(c1, r), dis(c2, c3)", "c2 <> c3"), ("max1 c1 r - -", "some(c1, r, c2), some(c1, r, c3), dis(c2, c3)", "c2 <> c3"),
        ("dis c2 - c3 -", "some(c1, r, c2), some(c1, r, c3), max1(c1, r)", "c2 <> c3"),
    ],
    "CSC": [("sub c1 - c3 -", "sub(c3, c2), sub(c2, c1)", "c1 <> c2 AND c2 <> c3 AND c1 <> c3")],
    "OOD": [("domain - p c1 -", "fact(i, p, j), type(i, c2), dis(c1, c2)", "c1 <> c2"), ("type i - c2 -", "domain(p, c1), fact(i, p, j), dis(c1, c2)", "c1 <> c2"), ("dis c1 - c2 -", "domain(p, c1), fact(i, p, j), type(i, c2)", "c1 <> c2")],
    "OOR": [("range - p c1 -", "fact(i, p, j), type(j, c2), dis(c1, c2)", "c1 <> c2"), ("type j - c2 -", "range(p, c1), fact(i, p, j), dis(c1, c2)", "c1 <> c2"), ("dis c1 - c2 -", "range(p, c1), fact(i, p, j), type(j, c2)", "c1 <> c2")],
}

# both ends of an assertion the other way round
_WHOLE_STRICT = {
    "OOD": ("domain(p, c1), fact(i, p, j), type(j, c2), dis(c1, c2)", "c1 <> c2"),
    "OOR": ("range(p, c1), fact(i, p, j), type(i, c2), dis(c1, c2)", "c1 <> c2"),
}

# one axiom of a pattern alone, and the restriction that completes it together with a disjointness of c2 and any third class c3
_ALONE = {"AIO": [("some(c1, r, c2)", "'someand', c1, r, c2, c3")], "OIL": [("only(c1, r, c2)", "'only', c1, r, c3, NULL")], "UE": [("only(c1, r, c2)", "'some', c1, r, c3, NULL"), ("some(c1, r, c2)", "'only', c1, r, c3, NULL")]}
_CLASSES = "cls AS (SELECT DISTINCT onto, c FROM (SELECT onto, a AS c FROM ax WHERE kind IN ('sub', 'eq', 'dis', 'some', 'only', 'max1', 'someand') UNION SELECT onto, b FROM ax WHERE kind IN ('sub', 'eq', 'dis', 'some', 'only', 'someand', 'domain', 'range', 'type') UNION SELECT onto, n FROM ax WHERE kind = 'someand'))"


def _whole_sql(source, differ):
    return f"WITH {_BOTH} SELECT DISTINCT * FROM {_join(source)} WHERE {differ}"


def _but_one_sql(name):
    parts = []
    for axiom, source, differ in _BUT_ONE[name]:
        kind, a, prop, b, n = ("NULL::VARCHAR" if x == "-" else x for x in axiom.split())
        if kind in ("eq", "dis", "inverse"):
            a, b = f"least({a}, {b})", f"greatest({a}, {b})"
        parts.append(f"SELECT onto, '{kind}' AS kind, {a} AS a, {prop} AS prop, {b} AS b, {n} AS n FROM {_join(source)} WHERE {differ}")
    return f"WITH {_BOTH} SELECT onto, '{name}' AS pattern, kind, a, prop, b, n FROM ({' UNION '.join(parts)} EXCEPT SELECT * FROM ax)"


def _but_two_sql(name):
    if name == "EID":
        return f"""WITH {_BOTH}, {_CLASSES}, two AS (SELECT onto, list_sort(list(c))[1:2] AS c FROM cls GROUP BY onto HAVING count(*) > 1)
SELECT onto, 'EID' AS pattern, 'eq' AS kind, c[1] AS a, NULL::VARCHAR AS prop, c[2] AS b, NULL::VARCHAR AS n, c[1] AS dis_a, c[2] AS dis_b FROM two"""
    parts = [f"SELECT onto, {new}, least(c2, c3), greatest(c2, c3) FROM (SELECT t.onto, c1, r, c2, min(c) AS c3 FROM {_join(alone)} t JOIN cls ON cls.onto = t.onto AND c <> c1 AND c <> c2 GROUP BY ALL)" for alone, new in _ALONE[name]]
    return f"WITH {_BOTH}, {_CLASSES} SELECT x0 AS onto, '{name}' AS pattern, x1 AS kind, x2 AS a, x3 AS prop, x4 AS b, x5 AS n, x6 AS dis_a, x7 AS dis_b FROM ({' UNION '.join(parts)}) AS t(x0, x1, x2, x3, x4, x5, x6, x7)"


def _register(name):
    query(_whole_sql(*_WHOLE[name]), f"pattern_{name.lower()}")(lambda spark, d: P.detect(_axioms(spark, d), name))
    query(_but_one_sql(name), f"complete_{name.lower()}")(lambda spark, d: P.complete(_axioms(spark, d), name))
    if name in _WHOLE_STRICT:
        query(_whole_sql(*_WHOLE_STRICT[name]), f"pattern_{name.lower()}_strict")(lambda spark, d: P.detect(_axioms(spark, d), name, strict=True))
    if name in P.PAIRED:
        query(_but_two_sql(name), f"complete_two_{name.lower()}")(lambda spark, d: P.complete_two(_axioms(spark, d), name))


for _name in _WHOLE:
    _register(_name)


@query(f"SELECT onto, {', '.join(f'''count(*) FILTER (kind = '{k}') AS {k}''' for k in sorted(set(KINDS)))} FROM {_AXIOMS} GROUP BY onto")
def axiom_profile(spark, d):
    return P.profile(_axioms(spark, d))


@query()
def pattern_injection(spark, d):
    return P.inject(_axioms(spark, d), ["EID", "UE", "CSC"], 2)


@query(f"""
WITH ax AS (SELECT * FROM {_AXIOMS}), q AS (
  SELECT onto, a AS s, prop AS p, b AS o FROM ax WHERE kind IN ('some', 'only', 'someand', 'fact') UNION SELECT onto, a, prop, n FROM ax WHERE kind = 'someand'
  UNION SELECT d.onto, d.b, d.prop, r.b FROM ax d JOIN ax r ON d.kind = 'domain' AND r.kind = 'range' AND d.onto = r.onto AND d.prop = r.prop),
i AS (SELECT onto, a, b FROM ax WHERE kind = 'inverse' UNION SELECT onto, b, a FROM ax WHERE kind = 'inverse')
SELECT onto, a AS s, 'subClassOf' AS p, b AS o FROM ax WHERE kind IN ('sub', 'eq') UNION SELECT onto, b, 'subClassOf', a FROM ax WHERE kind = 'eq' UNION SELECT onto, a, 'type', b FROM ax WHERE kind = 'type'
UNION SELECT * FROM q UNION SELECT q.onto, q.o, i.b, q.s FROM q JOIN i ON q.onto = i.onto AND q.p = i.a
UNION SELECT q.onto, q.s, u.b, q.o FROM q JOIN ax u ON u.kind = 'subprop' AND q.onto = u.onto AND q.p = u.a
""")
def graph_projection(spark, d):
    return O.project(_axioms(spark, d))


@query(f"""
WITH ax AS (SELECT * FROM {_AXIOMS}), c AS (SELECT onto, a AS x FROM ax WHERE kind IN ('sub', 'eq', 'dis', 'some', 'only', 'max1', 'someand') UNION SELECT onto, b FROM ax WHERE kind IN ('sub', 'eq', 'dis', 'some', 'only', 'someand', 'domain', 'range', 'type')),
p AS (SELECT onto, prop AS x FROM ax WHERE prop IS NOT NULL UNION SELECT onto, a FROM ax WHERE kind IN ('subprop', 'inverse') UNION SELECT onto, b FROM ax WHERE kind IN ('subprop', 'inverse')),
i AS (SELECT onto, a AS x FROM ax WHERE kind IN ('type', 'fact') UNION SELECT onto, b FROM ax WHERE kind = 'fact'),
s AS (SELECT onto, count(*) FILTER (kind = 'sub') AS subs, (SELECT count(*) FROM c WHERE c.onto = ax.onto) AS cls, (SELECT count(*) FROM p WHERE p.onto = ax.onto) AS props, (SELECT count(*) FROM i WHERE i.onto = ax.onto) AS ind FROM ax GROUP BY onto)
SELECT onto, round(props / (subs + props), 2) AS relationship, round(subs / cls, 2) AS inheritance, round(ind / cls, 2) AS population, round(0.3 * props / (subs + props) + 0.3 * subs / cls + 0.4 * ind / cls, 2) AS design FROM s
""")
def richness(spark, d):
    return O.richness(O.statistics(_axioms(spark, d)))


@query("""
WITH m AS (SELECT DISTINCT p_brand AS module, p_type AS class FROM part), n AS (SELECT module, count(*) AS n FROM m GROUP BY module)
SELECT m1, m2, shared, round(shared / (a.n + b.n - shared), 9) AS jaccard FROM (
  SELECT x.module AS m1, y.module AS m2, count(*) AS shared FROM m x JOIN m y ON x.class = y.class AND x.module < y.module GROUP BY ALL HAVING count(*) >= 5)
JOIN n a ON a.module = m1 JOIN n b ON b.module = m2
""")
def module_overlap(spark, d):
    m = table(spark, d, "part").select(F.col("p_brand").alias("module"), F.col("p_type").alias("class"))
    return O.overlaps(m, 5).withColumn("jaccard", F.round("jaccard", 9))


def _nested(spark, d):
    """The derived axioms as nested lists in JSON."""
    ax = _axioms(spark, d)
    cls = lambda c: F.concat(F.lit('["class","'), c, F.lit('"]'))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    k = F.col("kind")
    restricted = lambda word: F.concat(F.lit('["sub",'), cls(F.col("a")), F.lit(f',["{word}",'), q(F.col("prop")), F.lit(","), cls(F.col("b")), F.lit("]]"))
    text = (
        F.when(k == "some", restricted("some"))
        .when(k == "only", restricted("only"))
        .when(k.isin("sub", "eq", "dis"), F.concat(F.lit('["'), k, F.lit('",'), cls(F.col("a")), F.lit(","), cls(F.col("b")), F.lit("]")))
        .when(k.isin("subprop", "inverse"), F.concat(F.lit('["'), k, F.lit('",'), q(F.col("a")), F.lit(","), q(F.col("b")), F.lit("]")))
        .when(k.isin("domain", "range"), F.concat(F.lit('["'), k, F.lit('",'), q(F.col("prop")), F.lit(","), cls(F.col("b")), F.lit("]")))
    )
    return ax.select("onto", text.alias("axiom")).filter("axiom is not null")


@query()
def locality_module(spark, d):
    """Modules of the derived ontologies for the seed class C1."""
    rows = _nested(spark, d)
    return O.extract_module(rows, rows.select("onto", F.lit("C1").alias("term")))


@query()
def partition_by_heads(spark, d):
    ax = materialize(_axioms(spark, d), "axioms")
    edges = materialize(O.project(ax, only_taxonomy=True).filter("p = 'subClassOf' and s != o").select("onto", F.col("s").alias("src"), F.col("o").alias("dst")).distinct(), "edges")
    sub = ax.filter("kind = 'sub'").select("onto", F.col("a").alias("child"), F.col("b").alias("parent"))
    rel = O.project(ax).filter("p != 'subClassOf' and p != 'type'")
    ranks = materialize(O.concept_ranks(sub, rel, ax.filter("kind = 'eq'").select("onto", "a", "b")), "ranks")
    heads = materialize(O.cluster_heads(ranks, edges), "heads")
    assigned = materialize(O.assign_clusters(ranks.select("onto", "concept"), heads, edges), "assigned")
    return O.module_quality(assigned, edges)


@query()
def agglomeration(spark, d):
    """Blocks of customers and suppliers of one nation's trade, at most 50 in each."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    l = table(spark, d, "lineitem").select("l_orderkey", (-F.col("l_suppkey")).alias("dst"))
    return O.agglomerate(o.join(l, "l_orderkey").select("src", "dst"), 50)


@query()
def name_matching(spark, d):
    n = table(spark, d, "nation").select("n_name")
    return O.match_names(n, n.select(F.concat(F.initcap(F.lower("n_name")), F.lit("Land")).alias("other")), 0.5)
