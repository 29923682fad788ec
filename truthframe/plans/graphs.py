"""Graph operators over edges between regions, nations, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from truthframe.operators import graphs as G
from truthframe.operators.components import connected_components as components
from truthframe.operators.formula import And, Implies, Predicate, Theory, variables
from truthframe.operators.relalg import compose as compose_relations
from truthframe.plans.registry import query
from truthframe.session import table

# nations point at three others each
_EDGES = "(SELECT DISTINCT n_nationkey AS src, (n_nationkey * k + k * k) % 25 AS dst FROM nation, (SELECT unnest([2, 3, 7]) AS k))"


def _edges(spark, d):
    k = F.explode(F.array(*(F.lit(x) for x in (2, 3, 7)))).alias("k")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), k)
    return n.select("src", ((F.col("src") * F.col("k") + F.col("k") * F.col("k")) % 25).alias("dst")).distinct()


def _nodes(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))


_REACH = f"""
WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), r(src, dst, dist) AS (
  SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT r.src, e.dst, r.dist + 1 FROM r JOIN e ON r.dst = e.src WHERE r.dist < 25),
m AS (SELECT src, dst, min(dist) AS dist FROM r GROUP BY ALL)
"""


@query(f"SELECT n_nationkey AS node, count(e.src) AS degree FROM nation LEFT JOIN {_EDGES} e ON e.src = n_nationkey GROUP BY n_nationkey")
def out_degree(spark, d):
    return G.out_degree(_edges(spark, d), _nodes(spark, d))


@query(_REACH + "SELECT a.n_nationkey AS src, b.n_nationkey AS dst, coalesce(dist, 26) AS dist FROM nation a CROSS JOIN nation b LEFT JOIN m ON m.src = a.n_nationkey AND m.dst = b.n_nationkey")
def shortest_paths(spark, d):
    return G.distances(_edges(spark, d), _nodes(spark, d), pairs=True)


@query(_REACH + "SELECT src, dst FROM m WHERE dist <= 2 AND src <> dst")
def k_connectivity(spark, d):
    return G.k_connected(_edges(spark, d), _nodes(spark, d), 2, exclude_self=True)


@query(_REACH + "SELECT DISTINCT dst AS node FROM m WHERE src IN (1, 5)")
def module_closure(spark, d):
    return G.closure(_edges(spark, d), _nodes(spark, d).filter("node in (1, 5)"))


@query(_REACH + ", core AS (SELECT DISTINCT e.src FROM e JOIN m ON m.src = e.dst AND m.dst = e.src) SELECT count(*) > 0 AS has_cycle FROM core")
def has_cycle(spark, d):
    return G.on_cycle(_edges(spark, d)).agg((F.count("*") > 0).alias("has_cycle"))


@query(f"SELECT DISTINCT a.dst AS node FROM {_EDGES} a JOIN {_EDGES} b ON a.dst = b.src")
def chain_of_two(spark, d):
    return G.chain_of_two(_edges(spark, d))


@query(f"SELECT src, dst FROM {_EDGES} EXCEPT SELECT a.src, b.dst FROM {_EDGES} a JOIN {_EDGES} b ON a.dst = b.src WHERE a.src <> a.dst AND b.src <> b.dst")
def transitive_reduction(spark, d):
    return G.transitive_reduction_step(_edges(spark, d))


@query(_REACH + ", h AS (SELECT dst FROM m WHERE src = 1 AND dist <= 2) SELECT src, dst FROM e WHERE src IN (SELECT dst FROM h) AND dst IN (SELECT dst FROM h)")
def k_hop_subgraph(spark, d):
    return G.k_hop(_edges(spark, d), _nodes(spark, d).filter("node = 1"), 2)[1]


@query(f"SELECT n_nationkey AS node, n_regionkey AS color FROM nation UNION SELECT e.src, n_regionkey FROM {_EDGES} e JOIN nation ON e.dst = n_nationkey")
def adjacent_colors(spark, d):
    colors = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("color"))
    return G.adjacent_colors(_edges(spark, d), colors)


@query("SELECT DISTINCT c_nationkey AS a, p_brand AS b FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey")
def compose(spark, d):
    """From nations by way of customers, orders and lines to brands, each step made distinct before the next."""
    rel = lambda t, a, b: table(spark, d, t).select(F.col(a).alias("a"), F.col(b).alias("b"))
    bought = compose_relations(compose_relations(rel("customer", "c_nationkey", "c_custkey"), rel("orders", "o_custkey", "o_orderkey")), rel("lineitem", "l_orderkey", "l_partkey"))
    return compose_relations(bought, rel("part", "p_partkey", "p_brand"))


@query("""
WITH RECURSIVE t AS (SELECT DISTINCT s_suppkey AS a, s_suppkey - s_suppkey % 10 AS b FROM supplier), u AS (SELECT a, b FROM t WHERE a <> b UNION SELECT b, a FROM t WHERE a <> b),
r(node, root) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT node, min(root) AS component FROM r GROUP BY node
""")
def connected_components(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") - F.col("s_suppkey") % 10).alias("dst"))
    return components(s)


# customers as a family tree: customer c is a child of c // 3, by turns a son or a daughter
_FAMILY = """
WITH p AS (SELECT c_custkey AS c, c_custkey // 3 * 2 AS f, c_custkey // 3 * 2 + 1 AS m, c_custkey % 2 = 0 AS male FROM customer WHERE c_custkey >= 3),
fam AS (SELECT 'father' AS rel, c AS a, f AS b FROM p UNION SELECT 'mother', c, m FROM p UNION SELECT CASE WHEN male THEN 'son' ELSE 'daughter' END, f, c FROM p UNION SELECT CASE WHEN male THEN 'son' ELSE 'daughter' END, m, c FROM p),
par AS (SELECT a, b FROM fam WHERE rel IN ('father', 'mother')), gp AS (SELECT DISTINCT x.a, y.b FROM par x JOIN par y ON x.b = y.a)
"""


def _family(spark, d):
    c = F.col("c_custkey")
    base = (F.floor(c / 3) * 2).cast("long")
    p = table(spark, d, "customer").filter("c_custkey >= 3").select(c.alias("c"), base.alias("f"), (base + 1).alias("m"), F.when(c % 2 == 0, "son").otherwise("daughter").alias("kid"))
    rows = F.explode(
        F.array(
            F.struct(F.lit("father").alias("rel"), F.col("c").alias("a"), F.col("f").alias("b")),
            F.struct(F.lit("mother").alias("rel"), F.col("c").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("kid").alias("rel"), F.col("f").alias("a"), F.col("c").alias("b")),
            F.struct(F.col("kid").alias("rel"), F.col("m").alias("a"), F.col("c").alias("b")),
        )
    )
    return p.select(rows.alias("r")).select("r.*")


def _people(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("person"))


@query(_FAMILY + "SELECT c_custkey AS person FROM customer WHERE c_custkey IN (SELECT a FROM fam WHERE rel = 'father')")
def has_father(spark, d):
    return G.has_relative(_family(spark, d), _people(spark, d), "father")


@query(_FAMILY + "SELECT c_custkey AS person FROM customer WHERE c_custkey IN (SELECT x.a FROM fam x JOIN fam y ON x.rel = 'father' AND y.rel = 'daughter' AND x.b = y.a WHERE y.b <> x.a)")
def has_sister(spark, d):
    return G.has_sister(_family(spark, d), _people(spark, d))


@query(_FAMILY + "SELECT a, b FROM gp")
def grandparents(spark, d):
    return G.grandparents(_family(spark, d))


@query(_FAMILY + "SELECT gp.a, s.b FROM gp JOIN fam s ON s.rel = 'son' AND s.a = gp.b EXCEPT SELECT a, b FROM fam WHERE rel = 'father'")
def uncles(spark, d):
    return G.uncles(_family(spark, d))


@query(_FAMILY + "SELECT DISTINCT x.a, s.b FROM par x JOIN fam g ON g.rel = 'mother' AND x.b = g.a JOIN fam h ON h.rel = 'mother' AND g.b = h.a JOIN fam s ON s.rel = 'son' AND s.a = h.b")
def maternal_great_uncles(spark, d):
    return G.maternal_great_uncles(_family(spark, d))


_SPO = "(SELECT n_name AS s, 'in' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, 'of', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _triples(spark, d):
    n, r, s = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    inn = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("s"), F.lit("in").alias("p"), F.col("r_name").alias("o"))
    return inn.union(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", F.lit("of"), "n_name"))


def _walks(spark, d):
    return G.random_walks(_triples(spark, d), table(spark, d, "supplier").select("s_name"), 3)


def _joined(df):
    return df.select("root", F.array_join("walk", ">").alias("walk"))


_WALKS = f"(SELECT a.s AS root, a.s || '>of>' || a.o || '>in>' || b.o AS walk, a.o AS n, b.o AS r FROM {_SPO} a JOIN {_SPO} b ON a.o = b.s)"


@query(f"SELECT root, walk FROM {_WALKS}")
def walks(spark, d):
    return _joined(_walks(spark, d))


@query(f"SELECT root, root || '>' || unnest(['of', n, 'in', r]) AS walk FROM {_WALKS}")
def walks_walklets(spark, d):
    return _joined(G.walklets(_walks(spark, d)))


@query(f"SELECT root, root || '>1>2>3>4' AS walk FROM {_WALKS}")
def walks_anonymous(spark, d):
    return _joined(G.anonymous(_walks(spark, d)))


@query(f"SELECT root, walk FROM {_WALKS} UNION SELECT root, root || '>of>*>in>' || r FROM {_WALKS}")
def walks_wildcards(spark, d):
    return _joined(G.wildcards(_walks(spark, d), [2]))


@query(f"SELECT root, root || '>of|' || n || '>' || n || '|in>in|' || r AS walk FROM {_WALKS}")
def walks_ngrams(spark, d):
    return _joined(G.ngrams(_walks(spark, d), 2))


@query(f"""
WITH w AS (SELECT * FROM {_WALKS}), n AS (SELECT n, count(*) AS c FROM w GROUP BY n)
SELECT root, root || '>of' || CASE WHEN c < 0.05 * (SELECT count(*) FROM w) THEN '' ELSE '>' || n END || '>in>' || r AS walk FROM w JOIN n USING (n)
""")
def walks_halk(spark, d):
    return _joined(G.halk(_walks(spark, d), 0.05))


@query()
def walks_community(spark, d):
    return _joined(G.community_walks(_triples(spark, d), table(spark, d, "supplier").select("s_name"), 3))


@query(f"""
WITH e AS (SELECT DISTINCT * FROM {_EDGES}), l0 AS (SELECT n_nationkey AS node, n_nationkey::VARCHAR AS label FROM nation),
h1 AS (SELECT e.dst AS node, string_agg(DISTINCT label, '-' ORDER BY label) AS got FROM e JOIN l0 ON e.src = l0.node GROUP BY e.dst),
l1 AS (SELECT node, md5(label || '-' || coalesce(got, '')) AS label FROM l0 LEFT JOIN h1 USING (node)),
h2 AS (SELECT e.dst AS node, string_agg(DISTINCT label, '-' ORDER BY label) AS got FROM e JOIN l1 ON e.src = l1.node GROUP BY e.dst)
SELECT node, md5(label || '-' || coalesce(got, '')) AS label FROM l1 LEFT JOIN h2 USING (node)
""")
def wl_labels(spark, d):
    return G.wl_labels(_edges(spark, d), _nodes(spark, d), 2)


@query("SELECT count(*) - 1 AS swaps FROM region")
def optimal_swaps(spark, d):
    """Regions turned round by one place: a single cycle."""
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("place"), ((F.col("r_regionkey") + 1) % 5).alias("v"))
    return G.optimal_swaps(r, "place", "v")


@query("""
WITH RECURSIVE b AS (SELECT n_regionkey AS world, n_nationkey + 1 AS block, CASE WHEN n_nationkey >= 10 THEN n_nationkey - 9 ELSE 0 END AS under FROM nation),
o AS (SELECT row_number() OVER () AS i, * FROM b), g AS (SELECT o.block, o.under FROM o),
r(block, depth, path) AS (SELECT block, 1, block::VARCHAR FROM g WHERE under = 0 UNION ALL SELECT g.block, depth + 1, path || '>' || g.block FROM r JOIN g ON g.under = r.block)
SELECT block, depth, path FROM r
""")
def block_depths(spark, d):
    n = F.col("n_nationkey")
    on = table(spark, d, "nation").select(F.lit(1).alias("world"), (n + 1).alias("block"), F.when(n >= 10, n - 9).otherwise(0).alias("under"))
    return G.block_depths(on).select("block", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(_REACH + "SELECT src, dst FROM m WHERE dist = 2")
def pairs_at_distance(spark, d):
    return G.pairs_at_distance(_edges(spark, d), _nodes(spark, d), 2)


@query(_REACH + "SELECT dst AS node, dist AS hop, 'concept' || row_number() OVER (ORDER BY dist, dst) - 1 AS name FROM m WHERE src = 3 AND dist <= 2")
def mask_neighbours(spark, d):
    return G.mask_neighbours(_edges(spark, d), _nodes(spark, d).filter("node = 3"), 2)


@query(f"""
SELECT n_nationkey AS node, n_regionkey AS label, coalesce(array_to_string(list_sort(list(DISTINCT e.dst) FILTER (e.dst <> n_nationkey)), ','), '') AS context
FROM nation LEFT JOIN {_EDGES} e ON e.src = n_nationkey GROUP BY ALL
""")
def prediction_samples(spark, d):
    labels = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("label"))
    out = G.prediction_samples(_edges(spark, d), labels)
    return out.withColumn("context", F.array_join(F.transform("context", lambda x: x.cast("string")), ","))


@query("""
WITH RECURSIVE e AS (SELECT r_regionkey AS x, r_regionkey // 2 AS y FROM region), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x::VARCHAR AS x, y::VARCHAR AS y FROM r
""")
def rule_fixpoint(spark, d):
    """What two rules prove: an edge is a path, and a path followed by an edge is a path."""
    x, y, z = variables("x", "y", "z")
    edge, path = Predicate("edge", 2), Predicate("path", 2)
    theory = Theory(spark, natural=True)
    theory.add(Implies(edge(x, y), path(x, y)), Implies(And(path(x, y), edge(y, z)), path(x, z)), world="AXIOM")
    k = F.col("r_regionkey")
    theory.add_data({edge: table(spark, d, "region").select(k.cast("string").alias("g0"), F.floor(k / 2).cast("string").alias("g1"), F.lit(1.0).alias("l"), F.lit(1.0).alias("u"))})
    theory.infer(max_steps=30)
    return theory.relation(path).true_groundings().toDF("x", "y")


@query(f"SELECT src, dst FROM {_EDGES} UNION SELECT dst, src FROM {_EDGES}")
def undirected(spark, d):
    return G.undirected(_edges(spark, d))


@query("SELECT a.n_regionkey, a.n_nationkey AS x, b.n_nationkey AS y, a.n_nationkey < b.n_nationkey AS position_lt, a.n_nationkey = b.n_nationkey AS position_eq, a.n_nationkey > b.n_nationkey AS position_gt, a.n_nationkey * 7 % 25 < b.n_nationkey * 7 % 25 AS value_lt, a.n_nationkey * 7 % 25 = b.n_nationkey * 7 % 25 AS value_eq, a.n_nationkey * 7 % 25 > b.n_nationkey * 7 % 25 AS value_gt FROM nation a JOIN nation b USING (n_regionkey)")
def sort_state(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", (F.col("n_nationkey") * 7 % 25).alias("v"))
    return G.sort_state(n, "n_nationkey", "v", ["n_regionkey"])


_BLOCKS = "(SELECT 1 AS world, n_nationkey + 1 AS block, CASE WHEN n_nationkey >= 10 THEN n_nationkey - 9 ELSE 0 END AS under FROM nation)"


def _blocks(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.lit(1).alias("world"), (n + 1).alias("block"), F.when(n >= 10, n - 9).otherwise(0).alias("under"))


@query(f"SELECT world, block FROM {_BLOCKS} WHERE block NOT IN (SELECT under FROM {_BLOCKS})")
def blocks_clear(spark, d):
    return G.clear_blocks(_blocks(spark, d))


@query(f"SELECT world, block, CASE block WHEN 25 THEN 24 WHEN 20 THEN 0 ELSE under END AS under FROM {_BLOCKS}")
def blocks_moved(spark, d):
    """A clear block goes onto another and one to the ground; one that carries another stays, and none goes onto one that does."""
    moves = table(spark, d, "region").select(F.lit(1).alias("world"), F.element_at(F.array(*map(F.lit, (25, 20, 1, 22, 23))), F.col("r_regionkey") + 1).alias("block"), F.element_at(F.array(*map(F.lit, (24, 0, 24, 3, 23))), F.col("r_regionkey") + 1).alias("target"))
    return G.move_block(_blocks(spark, d), moves)


@query("SELECT 1 AS world, false AS reached UNION ALL SELECT 2, true")
def blocks_goal(spark, d):
    on = _blocks(spark, d)
    both = on.union(on.withColumn("world", F.lit(2)))
    return G.goal_reached(both, both.withColumn("under", F.when(F.col("world") == 1, 0).otherwise(F.col("under"))))


@query("SELECT 'husband' AS rel, 400 AS n UNION ALL SELECT 'wife', 400 UNION ALL SELECT 'father', 600 UNION ALL SELECT 'mother', 600 UNION ALL SELECT 'child', 1200")
def family_generated(spark, d):
    """Eight hundred people in four generations: everyone but the first has two parents, each of whom has them as a child."""
    rel = F.when(F.col("rel").isin("son", "daughter"), "child").otherwise(F.col("rel"))
    return G.random_family(spark, 800).groupBy(rel.alias("rel")).agg(F.count("*").cast("int").alias("n"))
