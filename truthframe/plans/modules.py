"""Ontology modules: schema parts, locality, partitions, merging and what patterns say of consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from truthframe.operators import ontology as O
from truthframe.operators import patterns as P
from truthframe.plans.ontology import _AXIOMS, _BOTH, _CLASSES, _WHOLE, _axioms, _join, _nested
from truthframe.plans.registry import query
from truthframe.session import materialize, table

_AX = f"ax AS (SELECT * FROM {_AXIOMS})"


@query(f"""
WITH {_AX}, e AS (SELECT onto, a AS s, prop AS p, b AS o FROM ax WHERE kind IN ('some', 'only', 'fact'))
SELECT e.onto, s, 'type' AS p, b AS o FROM e JOIN ax ON ax.onto = e.onto AND kind = 'domain' AND prop = p UNION SELECT e.onto, o, 'type', b FROM e JOIN ax ON ax.onto = e.onto AND kind = 'range' AND prop = p
""")
def domain_types(spark, d):
    ax = _axioms(spark, d)
    e = ax.filter("kind in ('some', 'only', 'fact')").select("onto", F.col("a").alias("s"), F.col("prop").alias("p"), F.col("b").alias("o"))
    return O.propagate_domains(e, ax)


@query(f"""
WITH {_AX}, t AS (SELECT onto, a AS s, 'subClassOf' AS p, b AS o FROM ax WHERE kind IN ('sub', 'eq') UNION SELECT onto, b, 'subClassOf', a FROM ax WHERE kind = 'eq' UNION SELECT onto, a, 'type', b FROM ax WHERE kind = 'type')
SELECT * FROM t UNION SELECT onto, o, CASE p WHEN 'type' THEN 'typeOf' ELSE 'superClassOf' END, s FROM t
""")
def taxonomy_both_ways(spark, d):
    return O.project(_axioms(spark, d), only_taxonomy=True, both_ways=True)


def _land_triples(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    lies = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.initcap(F.lower("n_name")).alias("s"), F.lit("liesIn").alias("p"), F.initcap(F.lower("r_name")).alias("o"))
    label = n.select(F.initcap(F.lower("n_name")).alias("s"), F.lit("label").alias("p"), F.explode(F.array(F.lower("n_name"), F.concat(F.lit("land "), F.col("n_nationkey").cast("string")))).alias("o"))
    return lies, label


_LANDS = "(SELECT upper(n_name[1]) || lower(n_name[2:]) AS s, 'land ' || n_nationkey AS second, lower(n_name) AS first, upper(r_name[1]) || lower(r_name[2:]) AS o FROM nation JOIN region ON n_regionkey = r_regionkey WHERE NOT contains(n_name, ' '))"


@query(f"SELECT s, array_to_string(list_sort([first, second]), '|') AS labels FROM {_LANDS}")
def annotation_index(spark, d):
    labels = O.annotation_index(_land_triples(spark, d)[1].filter("not contains(s, ' ')"))
    return labels.select("s", F.array_join("labels", "|").alias("labels"))


@query(f"""
SELECT 'uri' AS kind, s || ' liesIn ' || o AS sentence FROM {_LANDS} WHERE o <> 'Middle east'
UNION ALL SELECT 'literal', unnest([first, second]) || ' lies in ' || lower(o) FROM {_LANDS} WHERE o <> 'Middle east'
""")
def sentences(spark, d):
    """Edges as sentences of names, and of words: each label of the subject with the words of the others."""
    lies, label = _land_triples(spark, d)
    lies = lies.filter("not contains(s, ' ') and not contains(o, ' ')")
    return O.documents_of(lies, O.annotation_index(label))


# a schema out of parts: brands are classes, types are properties, sizes say what a triple states

_SCHEMA = """(SELECT 'O' || p_partkey % 3 AS onto, p_brand AS s, ['SubClassOf', 'Domain', 'is', 'likes'][p_size % 4 + 1] AS p,
  CASE WHEN p_size % 4 = 2 THEN ['Class', 'Thing'][p_partkey % 2 + 1] ELSE split_part(p_type, ' ', 1) || p_partkey % 25 END AS o FROM part UNION ALL
  SELECT 'O' || p_partkey % 3, split_part(p_type, ' ', 1) || p_partkey % 25, ['SubClassOf', 'likes'][p_size % 2 + 1], p_brand FROM part)"""


def _schema(spark, d):
    p, k, size = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    onto = F.concat(F.lit("O"), (k % 3).cast("string")).alias("onto")
    other = F.concat(F.split("p_type", " ")[0], (k % 25).cast("string"))
    first = p.select(onto, F.col("p_brand").alias("s"), pick(("SubClassOf", "Domain", "is", "likes"), size % 4).alias("p"), F.when(size % 4 == 2, pick(("Class", "Thing"), k % 2)).otherwise(other).alias("o"))
    return first.union(p.select(onto, other, pick(("SubClassOf", "likes"), size % 2), "p_brand"))


@query(f"""
WITH t AS (SELECT * FROM {_SCHEMA}), c AS (SELECT DISTINCT onto, s AS x FROM t WHERE p = 'is' AND o = 'Class')
SELECT DISTINCT t.* FROM t JOIN c ON c.onto = t.onto AND c.x = t.s UNION SELECT DISTINCT t.* FROM t JOIN c ON c.onto = t.onto AND c.x = t.o WHERE p IN ('SubClassOf', 'Domain')
""")
def tbox(spark, d):
    return O.tbox(_schema(spark, d))


@query(f"SELECT v AS part, s, p, o FROM {_SCHEMA} JOIN (SELECT unnest(['Brand#1', 'Brand#23']) AS v) ON starts_with(s, v) WHERE NOT starts_with(o, 'Thing')")
def local_parts(spark, d):
    prefixes = table(spark, d, "region").filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "Brand#1").otherwise("Brand#23").alias("part"))
    return O.local_part(_schema(spark, d), prefixes.withColumn("prefix", F.col("part")), ["Thing"])


@query(f"""
WITH RECURSIVE t AS (SELECT DISTINCT s, p, o FROM {_SCHEMA} WHERE onto = 'O1' AND p = 'SubClassOf' AND s < o), r(x) AS (SELECT 'Brand#11' UNION SELECT o FROM r JOIN t ON s = x)
SELECT s, p, o FROM t WHERE s IN (SELECT x FROM r)
""")
def referenced_schema(spark, d):
    """What a term's superclasses, and theirs, say."""
    t = _schema(spark, d).filter("onto = 'O1' and p = 'SubClassOf' and s < o").select("s", "p", "o").distinct()
    return O.referenced_tbox(t, table(spark, d, "region").filter("r_regionkey = 0").select(F.lit("Brand#11").alias("t")))


@query("""
WITH b AS (SELECT n_nationkey AS node, n_regionkey AS block FROM nation WHERE n_nationkey % 5 <> 0), e AS (SELECT n_nationkey AS src, (n_nationkey * k + 1) % 25 AS dst FROM nation, (SELECT unnest([2, 3, 4, 7, 11]) AS k)),
v AS (SELECT src, block, count(*) AS n FROM e JOIN b ON b.node = e.dst WHERE src % 5 = 0 GROUP BY ALL)
SELECT node, block FROM b UNION ALL SELECT src, block FROM v QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, block) = 1
""")
def orphans_attached(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("block"))
    k = F.explode(F.array(*(F.lit(x) for x in (2, 3, 4, 7, 11)))).alias("k")
    e = n.select(F.col("node").alias("src"), k).select("src", ((F.col("src") * F.col("k") + 1) % 25).alias("dst"))
    return O.attach_orphans(n.select("node"), n.filter("node % 5 != 0"), e)


@query(f"SELECT onto, class, count(*) AS degree FROM (SELECT onto, unnest([a, b]) AS class FROM {_AXIOMS} WHERE kind IN ('some', 'only', 'fact')) GROUP BY ALL")
def class_connectivity(spark, d):
    e = _axioms(spark, d).filter("kind in ('some', 'only', 'fact', 'sub')").select("onto", F.col("a").alias("s"), F.when(F.col("kind") == "sub", "subClassOf").otherwise(F.col("prop")).alias("p"), F.col("b").alias("o"))
    return O.connectivity(e)


@query("WITH " + _BOTH + ", found AS (" + " UNION ".join(f"SELECT onto, '{name}' AS pattern FROM {_join(source)} WHERE {differ}" for name, (source, differ) in _WHOLE.items()) + ") SELECT onto, array_to_string(list_sort(list(pattern)), ',') AS patterns FROM found GROUP BY onto")
def consistency_by_patterns(spark, d):
    """Ontologies that some pattern makes inconsistent, and which."""
    return O.consistency_by_patterns(_axioms(spark, d)).select("onto", F.array_join("patterns", ",").alias("patterns"))


def _renamed(c):
    return f"CASE WHEN {c} IN ('C1', 'C3', 'R0') THEN {c} || 'New' ELSE {c} END"


@query(f"SELECT DISTINCT kind, {', '.join(f'{_renamed(c)} AS {c}' for c in ('a', 'prop', 'b', 'n'))} FROM {_AXIOMS}")
def merged_by_names(spark, d):
    return O.merge_by_mapping(_axioms(spark, d), _mapping(spark, d))


def _mapping(spark, d):
    old = F.explode(F.array(F.lit("C1"), F.lit("C3"), F.lit("R0"))).alias("b")
    return table(spark, d, "region").filter("r_regionkey = 0").select(old).select(F.concat("b", F.lit("New")).alias("a"), "b")


@query(f"SELECT DISTINCT kind, a, prop, b, n FROM {_AXIOMS} UNION SELECT 'eq', x, NULL, x || 'New', NULL FROM (SELECT unnest(['C1', 'C3', 'R0']) AS x)")
def merged_by_bridges(spark, d):
    return O.merge_by_mapping(_axioms(spark, d), _mapping(spark, d), "eq")


@query(f"""
WITH i AS (SELECT DISTINCT x FROM (SELECT unnest([a, b]) AS x FROM {_AXIOMS}) WHERE x IS NOT NULL), m AS (SELECT DISTINCT {_renamed('x')} AS x FROM i),
k AS (SELECT trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(x, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS k, count(*) AS n FROM m GROUP BY 1)
SELECT round((SELECT count(*) FROM i SEMI JOIN m USING (x)) / (SELECT count(*) FROM i), 6) AS coverage, round((SELECT sum(n - 1) / sum(n) FROM k), 6) AS redundancy
""")
def merge_quality(spark, d):
    ax = _axioms(spark, d)
    return O.merge_quality(ax, O.merge_by_mapping(ax, _mapping(spark, d))).select(F.round("coverage", 6).alias("coverage"), F.round("redundancy", 6).alias("redundancy"))


# modules by locality from the class C1: a round adds the terms of every axiom that isn't local to the signature so far


@query(f"""
WITH RECURSIVE {_AX}, x AS (SELECT onto, kind, a, b, prop,
    CASE WHEN kind IN ('some', 'only') THEN [a, prop, b] WHEN kind IN ('domain', 'range') THEN [prop, b] ELSE [a, b] END AS terms,
    CASE WHEN kind IN ('sub', 'some', 'subprop') THEN [[a]] WHEN kind = 'only' THEN [[a, prop]] WHEN kind = 'eq' AND a = b THEN [[a]] WHEN kind = 'eq' THEN [[a], [b]] WHEN kind = 'dis' THEN [[a, b]] WHEN kind = 'inverse' THEN [[a], [b]] ELSE [[prop]] END AS needs
  FROM ax WHERE kind IN ('some', 'only', 'sub', 'eq', 'dis', 'subprop', 'inverse', 'domain', 'range')),
r(onto, sig, step) AS (SELECT DISTINCT onto, ['C1'], 0 FROM x UNION ALL
  SELECT r.onto, list_sort(list_distinct(list_concat(any_value(r.sig), flatten(list(x.terms))))), step + 1 FROM r JOIN x ON x.onto = r.onto WHERE step < 30 AND len(list_filter(x.needs, lambda n: list_has_all(r.sig, n))) > 0 GROUP BY r.onto, step),
s AS (SELECT onto, arg_max(sig, step) AS sig FROM r GROUP BY onto)
SELECT x.onto, count(DISTINCT (kind, a, prop, b)) AS axioms FROM x JOIN s ON s.onto = x.onto WHERE len(list_filter(needs, lambda n: list_has_all(sig, n))) > 0 GROUP BY x.onto
""")
def locality_sizes(spark, d):
    """How many axioms the module of each derived ontology has."""
    from truthframe.plans.ontology import locality_module

    return locality_module(spark, d).groupBy("onto").agg(F.count("*").alias("axioms"))


# partitions


@query(f"""
WITH {_AX}, v AS (SELECT onto, a AS c, 0.3 AS w FROM ax WHERE kind = 'sub' UNION ALL SELECT onto, b, 0.3 FROM ax WHERE kind = 'sub' UNION ALL SELECT onto, a, 0.3 FROM ax WHERE kind IN ('some', 'only') UNION ALL SELECT onto, b, 0.3 FROM ax WHERE kind IN ('some', 'only')
  UNION ALL SELECT onto, a, 0.1 FROM ax WHERE kind = 'eq' UNION ALL SELECT onto, b, 0.1 FROM ax WHERE kind = 'eq')
SELECT onto, c AS concept, round(sum(w) / count(*) OVER (PARTITION BY onto), 9) AS rank FROM v GROUP BY onto, c
""")
def concept_ranks(spark, d):
    return _ranks(spark, d).withColumn("rank", F.round("rank", 9))


def _ranks(spark, d):
    ax = _axioms(spark, d)
    k = lambda *names: ax.filter(F.col("kind").isin(*names))
    rel = k("some", "only").select("onto", F.col("a").alias("s"), F.col("prop").alias("p"), F.col("b").alias("o"))
    return O.concept_ranks(k("sub").select("onto", F.col("a").alias("child"), F.col("b").alias("parent")), rel, k("eq").select("onto", "a", "b"))


@query("""
WITH m AS (SELECT n_nationkey AS x, n_regionkey AS h FROM nation), e AS (SELECT n_nationkey AS a, (n_nationkey * k + 1) % 25 AS b FROM nation, (SELECT unnest([2, 6, 11]) AS k)),
j AS (SELECT p.h AS h1, q.h AS h2 FROM e JOIN m p ON p.x = a JOIN m q ON q.x = b), s AS (SELECT h, count(*) AS size FROM m GROUP BY h)
SELECT h AS head, size, size / 25 AS share, round(i / (size * (size - 1)), 9) AS homogeneity, round(l / (i + l), 9) AS heterogeneity
FROM (SELECT h, size, (SELECT count(*) FROM j WHERE h1 = h AND h2 = h) AS i, (SELECT count(*) FROM j WHERE h1 <> h2 AND (h1 = h OR h2 = h)) AS l FROM s)
""")
def module_quality(spark, d):
    """Regions as modules of a graph of nations."""
    n = table(spark, d, "nation")
    k = F.explode(F.array(*(F.lit(x) for x in (2, 6, 11)))).alias("k")
    e = n.select(F.lit("o").alias("onto"), F.col("n_nationkey").alias("src"), k).select("onto", "src", ((F.col("src") * F.col("k") + 1) % 25).alias("dst"))
    out = O.module_quality(n.select(F.lit("o").alias("onto"), F.col("n_nationkey").alias("concept"), F.col("n_regionkey").alias("head")), e)
    return out.select("head", "size", "share", F.round("homogeneity", 9).alias("homogeneity"), F.round("heterogeneity", 9).alias("heterogeneity"))


@query(f"WITH {_BOTH}, {_CLASSES} SELECT onto, c FROM cls")
def classes_named(spark, d):
    return P.classes_of(_axioms(spark, d))


@query("SELECT unnest(['CSC', 'EID', 'OOD', 'UE']) AS pattern")
def seeds_completed(spark, d):
    """Patterns whose seed holds the pattern after one completion, and not before."""
    rows = None
    for p in ("CSC", "EID", "OOD", "UE"):
        seed = materialize(P.seed_axioms(spark, p), "seed")
        done = materialize(seed.unionByName(P.pick(P.complete(seed, p)).select(*seed.columns)), "done")
        one = P.detect(done, p).select("onto").distinct().join(P.detect(seed, p).select("onto"), "onto", "left_anti").select(F.lit(p).alias("pattern"))
        rows = one if rows is None else rows.union(one)
    return rows


_MORE = "(SELECT * FROM ax UNION ALL SELECT onto, 'same', a, NULL, b, NULL FROM ax WHERE kind = 'fact' AND a < b UNION ALL SELECT onto, 'eqprop', a, NULL, b, NULL FROM ax WHERE kind = 'inverse' UNION ALL SELECT onto, 'annotation', a, 'label', 'the ' || b, NULL FROM ax WHERE kind = 'type')"


def _more(spark, d):
    ax = _axioms(spark, d)
    none = F.lit(None).cast("string")
    row = lambda rows, kind, prop, b: rows.select("onto", F.lit(kind).alias("kind"), "a", prop.alias("prop"), b.alias("b"), none.alias("n"))
    same, label = row(ax.filter("kind = 'fact' and a < b"), "same", none, F.col("b")), row(ax.filter("kind = 'type'"), "annotation", F.lit("label"), F.concat(F.lit("the "), "b"))
    return ax.union(same).union(row(ax.filter("kind = 'inverse'"), "eqprop", none, F.col("b"))).union(label)


@query(f"""
WITH {_AX}, m AS {_MORE}, q AS (
  SELECT onto, a AS s, prop AS p, b AS o FROM m WHERE kind IN ('some', 'only', 'someand', 'fact') UNION SELECT onto, a, prop, n FROM m WHERE kind = 'someand'
  UNION SELECT d.onto, d.b, d.prop, r.b FROM m d JOIN m r ON d.kind = 'domain' AND r.kind = 'range' AND d.onto = r.onto AND d.prop = r.prop),
i AS (SELECT onto, a, b FROM m WHERE kind = 'inverse' UNION SELECT onto, b, a FROM m WHERE kind = 'inverse'),
u AS (SELECT onto, a, b FROM m WHERE kind IN ('subprop', 'eqprop') UNION SELECT onto, b, a FROM m WHERE kind = 'eqprop')
SELECT onto, a AS s, 'subClassOf' AS p, b AS o FROM m WHERE kind IN ('sub', 'eq') UNION SELECT onto, b, 'subClassOf', a FROM m WHERE kind = 'eq' UNION SELECT onto, a, 'type', b FROM m WHERE kind = 'type'
UNION SELECT * FROM q UNION SELECT q.onto, q.o, i.b, q.s FROM q JOIN i ON q.onto = i.onto AND q.p = i.a UNION SELECT q.onto, q.s, u.b, q.o FROM q JOIN u ON q.onto = u.onto AND q.p = u.a
UNION SELECT onto, a, 'sameAs', b FROM m WHERE kind = 'same' UNION SELECT onto, a, prop, b FROM m WHERE kind = 'annotation'
""")
def projection_with_literals(spark, d):
    """Also individuals that are the same, equivalent properties and annotations."""
    return O.project(_more(spark, d))


@query(f"""
SELECT onto, CASE kind WHEN 'some' THEN a || ' SubClassOf ' || prop || ' some ' || b WHEN 'only' THEN a || ' SubClassOf ' || prop || ' only ' || b WHEN 'sub' THEN a || ' SubClassOf ' || b ELSE a || ' EquivalentTo ' || b END AS line
FROM {_AXIOMS} WHERE kind IN ('some', 'only', 'sub', 'eq')
""")
def manchester_lines(spark, d):
    return _nested(spark, d).select("onto", O.manchester("axiom").alias("line")).filter("line is not null")


@query(f"""
WITH {_BOTH}, {_CLASSES}, x AS (SELECT * FROM {_AXIOMS}), e AS (SELECT DISTINCT onto, a, b FROM x WHERE kind = 'sub' AND a <> b),
up AS (SELECT onto, a AS c, count(*) AS ups FROM e GROUP BY ALL), down AS (SELECT onto, b AS c, count(*) AS downs FROM e GROUP BY ALL), far AS (SELECT e.onto, e.a AS c, sum(ups) AS fars FROM e JOIN up ON up.onto = e.onto AND up.c = e.b GROUP BY ALL),
r AS (SELECT cls.onto, coalesce(ups, 0) AS ups, coalesce(ups, 0) + coalesce(downs, 0) + coalesce(fars, 0) AS near FROM cls LEFT JOIN up USING (onto, c) LEFT JOIN down USING (onto, c) LEFT JOIN far USING (onto, c)),
s AS (SELECT onto, count(*) FILTER (ups > 0) / count(*) AS k, least(1.0, sum(near * near) / (count(*) * count(*))) AS n FROM r GROUP BY onto)
SELECT onto, round(k, 2) AS connected, round(n, 2) AS adjacency, round((k + n) / 2, 2) AS richness FROM s
""")
def class_richness(spark, d):
    ax = _axioms(spark, d)
    return O.class_richness(ax.filter("kind = 'sub'").select("onto", F.col("a").alias("child"), F.col("b").alias("parent")), P.classes_of(ax))


@query(f"""
WITH ax AS (SELECT * FROM {_AXIOMS}), c AS (SELECT onto, a AS x FROM ax WHERE kind IN ('sub', 'eq', 'dis', 'some', 'only', 'max1', 'someand') UNION SELECT onto, b FROM ax WHERE kind IN ('sub', 'eq', 'dis', 'some', 'only', 'someand', 'domain', 'range', 'type')),
i AS (SELECT onto, a AS x FROM ax WHERE kind IN ('type', 'fact') UNION SELECT onto, b FROM ax WHERE kind = 'fact'),
s AS (SELECT onto, count(*) FILTER (kind = 'type') AS t, (SELECT count(*) FROM c WHERE c.onto = ax.onto) AS n, (SELECT count(*) FROM i WHERE i.onto = ax.onto) AS ind FROM ax GROUP BY onto)
SELECT onto, round(least(1.0, t / n), 2) AS readability, round((least(1.0, ind / n) + least(1.0, t / n)) / 3, 2) AS knowledge FROM s
""")
def knowledge_richness(spark, d):
    ax = _axioms(spark, d)
    return O.knowledge_richness(O.statistics(ax), ax.filter("kind = 'type'").groupBy("onto").agg(F.count("*").alias("annotations")))


@query(f"SELECT b AS before, a AS after, round((b - 3) / a, 6) AS redundancy FROM (SELECT count(*) FILTER (kind = 'sub') AS b, (SELECT count(*) FROM (SELECT DISTINCT kind, {_renamed('a')}, {_renamed('b')} FROM {_AXIOMS} WHERE kind = 'sub')) AS a FROM {_AXIOMS})")
def path_redundancy(spark, d):
    ax = _axioms(spark, d)
    return O.path_redundancy(ax, O.merge_by_mapping(ax, _mapping(spark, d)), 3).withColumn("redundancy", F.round("redundancy", 6))
