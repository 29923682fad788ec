"""Relations, theories and fuzzy formulas over suppliers, nations and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from truthframe.functions import bounds as B
from truthframe.functions import fuzzy
from truthframe.operators import fuzzy_logic as L
from truthframe.operators import relalg
from truthframe.operators import relation as R
from truthframe.operators.formula import And, Const, Exists, Forall, Implies, Predicate, Theory, variables
from truthframe.plans.logic import _BOUNDS, _bounds_rows, _c
from truthframe.plans.registry import query
from truthframe.session import table

# relations: bounds of suppliers, some of them stated several times

_ROWS = "(SELECT s_suppkey AS k, (s_suppkey % 5) / 8.0 AS l, 0.5 + (s_suppkey % 3) / 4.0 AS u FROM supplier)"


def _relation(spark, d, world="OPEN"):
    k = F.col("s_suppkey")
    return R.Relation(table(spark, d, "supplier").select(k.alias("k"), (k % 5 / 8).alias("l"), (F.lit(0.5) + k % 3 / 4).alias("u")), ["k"], world)


@query(f"SELECT k, l::DOUBLE AS l, u::DOUBLE AS u FROM {_ROWS}")
def relation_reset(spark, d):
    """After proofs for all, what was asserted at first."""
    rel = _relation(spark, d)
    return rel.tighten(rel.df.select("k", F.lit(0.4).alias("l"), F.lit(0.6).alias("u"))).reset().df


@query("SELECT s_suppkey AS k, 0.0::DOUBLE AS l, 1.0::DOUBLE AS u FROM supplier")
def relation_flush(spark, d):
    return _relation(spark, d).flush().df


@query(f"SELECT c_custkey AS k, coalesce(l, 0.0)::DOUBLE AS l, coalesce(u, 0.0)::DOUBLE AS u FROM customer LEFT JOIN {_ROWS} ON k = c_custkey")
def relation_closed_world(spark, d):
    """What isn't stated is false in a closed world."""
    return _relation(spark, d).in_world("CLOSED").get(table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query(f"SELECT k // 3 AS k, max(l)::DOUBLE AS l, min(u)::DOUBLE AS u FROM {_ROWS} GROUP BY 1")
def merged_proofs(spark, d):
    return R.merge(_relation(spark, d).df.withColumn("k", F.floor(F.col("k") / 3)), ["k"])


@query(f"""
SELECT k, l::DOUBLE AS l, u::DOUBLE AS u, (k % 4 / 4.0)::DOUBLE AS label_l, 1.0::DOUBLE AS label_u FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0) JOIN {_ROWS} USING (k)
""")
def relation_labels(spark, d):
    labels = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 4 / 4).alias("label_l"), F.lit(1.0).alias("label_u"))
    return _relation(spark, d).with_labels(labels)


def _calls(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    own = s.select(F.col("s_suppkey").alias("x"), F.col("s_nationkey").alias("y"), (F.col("s_suppkey") % 4 / 4).alias("l"), F.lit(1.0).alias("u"))
    far = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("y"), F.lit(0.25).alias("l"), (F.col("n_regionkey") / 8 + 0.25).alias("u"))
    return own, far


@query("SELECT s_suppkey AS x, s_nationkey AS y FROM supplier")
def natural_groundings(spark, d):
    """Suppliers' pairs meet their nations; pairs whose nation isn't there stay, for they are complete."""
    return R.groundings_of(_calls(spark, d), natural=True)


@query("SELECT s_suppkey AS x, s_nationkey AS y, (s_suppkey % 4 / 4.0)::DOUBLE AS l0, 1.0::DOUBLE AS u0, CASE WHEN s_nationkey % 2 = 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS l1, CASE WHEN s_nationkey % 2 = 0 THEN n_regionkey / 8.0 + 0.25 ELSE 0.0 END::DOUBLE AS u1 FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def gathered_bounds(spark, d):
    """Bounds of both operands beside the groundings; the second's world is closed."""
    calls = _calls(spark, d)
    return R.gather(R.groundings_of(calls, natural=True), calls, ["OPEN", "CLOSED"])


@query("SELECT s_nationkey AS y FROM supplier UNION SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def union_of_groundings(spark, d):
    own, far = _calls(spark, d)
    return R.groundings_of([own.drop("x"), far])


@query("SELECT s_nationkey AS y FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def common_groundings(spark, d):
    own, far = _calls(spark, d)
    return R.common_groundings([own.drop("x"), far])


_GROUPED = "(SELECT c_nationkey, 1 - c_custkey % 97 / 90000.0 AS l, 1 - c_custkey % 89 / 900000.0 AS u FROM customer)"


def _grouped(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select("c_nationkey", (1 - c % 97 / 90000).alias("l"), (1 - c % 89 / 900000).alias("u"))


@query(f"SELECT c_nationkey, round(greatest(0, 1 - sum(1 - l)), 6) AS l, round(greatest(0, 1 - sum(1 - u)), 6) AS u FROM {_GROUPED} GROUP BY c_nationkey")
def forall_grounded(spark, d):
    return R.forall_up_grounded(_grouped(spark, d), ["c_nationkey"]).select("c_nationkey", F.round("l", 6).alias("l"), F.round("u", 6).alias("u"))


@query(f"SELECT c_nationkey, round(least(1, sum(1 - l)), 6) AS l, round(least(1, sum(1 - u)), 6) AS u FROM {_GROUPED} GROUP BY c_nationkey")
def exists_grounded(spark, d):
    rows = _grouped(spark, d).select("c_nationkey", (1 - F.col("l")).alias("l"), (1 - F.col("u")).alias("u"))
    return R.exists_up_grounded(rows, ["c_nationkey"]).select("c_nationkey", F.round("l", 6).alias("l"), F.round("u", 6).alias("u"))


@query(f"""
SELECT s_suppkey,
  round(1 - CASE WHEN 1 - wl < 1 THEN {_c("1 - wl + qu")} ELSE 1.0 END, 6) AS p_l, round(1 - CASE WHEN 1 - wu > 0 THEN {_c("1 - wu + ql")} ELSE 0.0 END, 6) AS p_u,
  round(1 - CASE WHEN 1 - wl < 1 THEN {_c("1 - wl + pu")} ELSE 1.0 END, 6) AS q_l, round(1 - CASE WHEN 1 - wu > 0 THEN {_c("1 - wu + pl")} ELSE 0.0 END, 6) AS q_u
FROM (SELECT *, (s_suppkey % 5) / 8.0 AS wl, 0.5 + (s_suppkey % 3) / 4.0 AS wu FROM {_BOUNDS})
""")
def bounds_or_down(spark, d):
    rows = _bounds_rows(spark, d).withColumns({"wl": (F.col("s_suppkey") % 5) / 8, "wu": F.lit(0.5) + (F.col("s_suppkey") % 3) / 4})
    p, q = B.or_down((F.col("wl"), F.col("wu")), [(F.col("pl"), F.col("pu")), (F.col("ql"), F.col("qu"))])
    return rows.select("s_suppkey", *(F.round(c, 6).alias(n) for c, n in zip((*p, *q), ("p_l", "p_u", "q_l", "q_u"))))


@query(f"SELECT s_suppkey, round({_c('0.25 + 0.5 * pl - 0.75 * ql')}, 6) AS l, round({_c('0.25 + 0.5 * pu - 0.75 * qu')}, 6) AS u FROM {_BOUNDS}")
def bounds_or_plain(spark, d):
    l, u = B.or_up_plain([(F.col("pl"), F.col("pu")), (F.col("ql"), F.col("qu"))], [0.5, -0.75], 0.75)
    return _bounds_rows(spark, d).select("s_suppkey", F.round(l, 6).alias("l"), F.round(u, 6).alias("u"))


@query("""
WITH s AS (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS s)
SELECT a.s AS a, b.s AS b, c.s AS c, greatest(a.s + b.s + c.s - 2, 0.0)::DOUBLE AS all_three, least(a.s + b.s + c.s, 1.0)::DOUBLE AS any_of FROM s a, s b, s c
""")
def truth_tables(spark, d):
    x = [(F.col(n), F.col(n)) for n in "abc"]
    return B.truth_table(spark, "abc", (0.0, 0.5, 1.0)).select("a", "b", "c", B.and_up(x)[0].alias("all_three"), B.or_up(x)[0].alias("any_of"))


# theories

_STATE = "CASE WHEN l >= 1 AND u >= 1 THEN 'T' WHEN u <= 0 THEN 'F' WHEN l <= 0 AND u >= 1 THEN 'U' WHEN l > 0.5 THEN '~T' WHEN u < 0.5 THEN '~F' ELSE '~U' END"


@query(f"SELECT s_suppkey::VARCHAR AS g0, round(l, 6) AS l, 1.0::DOUBLE AS u, {_STATE} AS state FROM (SELECT s_suppkey, pl AS l, 1.0 AS u FROM {_BOUNDS})")
def theory_modus_ponens(spark, d):
    """A rule that holds hands its premise's lower bound to its conclusion."""
    x = variables("x")[0]
    p, q = Predicate("p"), Predicate("q")
    theory = Theory(spark, natural=True)
    theory.add(Implies(p(x), q(x)), world="AXIOM")
    theory.add_data({p: _bounds_rows(spark, d).select(F.col("s_suppkey").cast("string").alias("g0"), F.col("pl").alias("l"), F.col("pu").alias("u"))})
    theory.infer()
    return theory.relation(q).states().select("g0", F.round("l", 6).alias("l"), "u", "state")


def _located(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("n_name").alias("g0"), F.col("r_name").alias("g1"), F.lit(1.0).alias("l"), F.lit(1.0).alias("u"))


@query("SELECT n_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def theory_binding(spark, d):
    """A constant in a premise binds a place of its predicate."""
    x = variables("x")[0]
    located, asian = Predicate("located", 2), Predicate("asian")
    theory = Theory(spark, natural=True)
    theory.add(Implies(located(x, Const("ASIA")), asian(x)), world="AXIOM")
    theory.add_data({located: _located(spark, d)})
    theory.infer()
    return theory.relation(asian).true_groundings().toDF("x")


@query("SELECT n_name AS x, 'T' AS state FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def theory_constant_proved(spark, d):
    """Downward, a proof goes back to the place where the constant stands."""
    x = variables("x")[0]
    located, asian = Predicate("located", 2), Predicate("asian")
    theory = Theory(spark, natural=True)
    theory.add(Implies(asian(x), located(x, Const("ASIA"))), world="AXIOM")
    theory.add_data({asian: _located(spark, d).filter("g1 = 'ASIA'").select("g0", "l", "u")})
    theory.infer()
    return theory.relation(located).states().filter("g1 = 'ASIA'").select(F.col("g0").alias("x"), "state")


@query("""
SELECT r_name AS y, round(greatest(0, 1 - sum(1 - (1 - n_nationkey / 900.0))), 6) AS all_l, round(greatest(0, 1 - sum(1 - (1 - n_nationkey / 1800.0))), 6) AS all_u, round(least(1, sum(1 - n_nationkey / 900.0)), 6) AS some_l
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")
def theory_quantified(spark, d):
    """For all nations of a region, all of them known, and for some."""
    x, y = variables("x", "y")
    located = Predicate("located", 2)
    every, some = Forall(x, located(x, y), fully_grounded=True), Exists(x, located(x, y))
    theory = Theory(spark, every, some)
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    theory.add_data({located: n.select(F.col("n_name").alias("g0"), F.col("r_name").alias("g1"), (1 - F.col("n_nationkey") / 900).alias("l"), (1 - F.col("n_nationkey") / 1800).alias("u"))})
    theory.infer("up")
    a, s = theory.relation(every).df.toDF("y", "l", "u"), theory.relation(some).df.toDF("y", "s", "t")
    return a.join(s, "y").select("y", F.round("l", 6).alias("all_l"), F.round("u", 6).alias("all_u"), F.round("s", 6).alias("some_l"))


@query("SELECT n_name AS x FROM nation WHERE n_nationkey % 3 = 0")
def theory_contradictions(spark, d):
    """A premise that is true and a conclusion that isn't contradict a rule that holds."""
    x = variables("x")[0]
    p, q = Predicate("p"), Predicate("q")
    theory = Theory(spark, natural=True)
    rule = Implies(p(x), q(x))
    theory.add(rule, world="AXIOM")
    n = table(spark, d, "nation")
    fact = lambda rows, v: rows.select(F.col("n_name").alias("g0"), F.lit(v).alias("l"), F.lit(v).alias("u"))
    theory.add_data({p: fact(n, 1.0), q: fact(n.filter("n_nationkey % 3 = 0"), 0.0)})
    theory.infer(max_steps=3)
    return theory.relation(rule).contradictions().toDF("x", "l", "u").select("x")


@query("SELECT n_name AS x FROM nation WHERE n_nationkey < 10")
def theory_restricted(spark, d):
    """A rule evaluated only for the nations asked for."""
    x = variables("x")[0]
    p, q = Predicate("p"), Predicate("q")
    theory = Theory(spark, natural=True)
    theory.add(Implies(p(x), q(x)), world="AXIOM")
    n = table(spark, d, "nation")
    theory.add_data({p: n.select(F.col("n_name").alias("g0"), F.lit(1.0).alias("l"), F.lit(1.0).alias("u"))})
    theory.infer(groundings=n.filter("n_nationkey < 10").select(F.col("n_name").alias("x")))
    return theory.relation(q).true_groundings().toDF("x")


@query("""
SELECT a.n_name AS x, b.n_name AS z FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN region ON r_regionkey = a.n_regionkey WHERE r_name <> 'ASIA'
""")
def theory_join(spark, d):
    """Two premises that share a variable: nations of one region are neighbours, where the region isn't Asia."""
    x, y, z = variables("x", "y", "z")
    located, other, near = Predicate("located", 2), Predicate("other"), Predicate("near", 2)
    theory = Theory(spark, natural=True)
    theory.add(Implies(And(located(x, y), located(z, y), other(y)), near(x, z)), world="AXIOM")
    r = table(spark, d, "region").select(F.col("r_name").alias("g0"), F.when(F.col("r_name") == "ASIA", 0.0).otherwise(1.0).alias("l"))
    theory.add_data({located: _located(spark, d), other: r.withColumn("u", F.col("l"))})
    theory.infer("up")
    theory.infer("down")
    return theory.relation(near).true_groundings().toDF("x", "z")


# fuzzy formulas


def _fuzzy(spark, d):
    n = L.variable(table(spark, d, "nation").withColumn("v", F.col("n_nationkey") / 25), "x", "n_nationkey", "v")
    r = L.variable(table(spark, d, "region").withColumn("v", F.col("r_regionkey") / 5), "y", "r_regionkey", "v")
    return L.predicate(lambda a: a[0])(n), L.predicate(lambda a: a[0])(r)


@query("SELECT n_nationkey AS x, r_regionkey AS y, round(greatest(n_nationkey / 25.0 + r_regionkey / 5.0 - 1, 0.0), 6) AS value FROM nation, region")
def fuzzy_connective(spark, d):
    """Formulas of different variables joined by a connective: every combination."""
    both = L.connective(fuzzy.and_luk)(*_fuzzy(spark, d))
    return both.reorder(["y", "x"]).df.withColumn("value", F.round("value", 6))


@query("SELECT r_regionkey AS y, round(greatest(7 / 25.0 + r_regionkey / 5.0 - 1, 0.0), 6) AS value FROM region WHERE r_regionkey IN (1, 4)")
def fuzzy_take(spark, d):
    both = L.connective(fuzzy.and_luk)(*_fuzzy(spark, d))
    return both.take("x", 7).take("y", [1, 4]).df.withColumn("value", F.round("value", 6))


@query("SELECT a.k AS x, b.k AS y FROM (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a JOIN (SELECT n_name AS k, row_number() OVER (ORDER BY n_name) AS i FROM nation) b USING (i)")
def fuzzy_diagonal(spark, d):
    n = table(spark, d, "nation")
    return L.diagonal(L.variable(n, "x", "n_nationkey", "n_regionkey"), L.variable(n, "y", "n_name", "n_regionkey")).select("x", "y")


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]) + len(embedding) * label, 4) AS total FROM embeddings")
def fuzzy_add(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")
    moved = fuzzy.add(F.col("e"), F.transform("e", lambda x: F.col("label").cast("double")))
    return e.select("vec_id", F.round(F.aggregate(moved, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("""
WITH h AS (SELECT l_orderkey, l_linenumber, 0.5 * l_discount - 0.25 * l_tax + 0.01 AS a, -l_discount + 0.5 * l_tax AS b FROM lineitem),
e AS (SELECT l_orderkey, l_linenumber, CASE WHEN a > 0 THEN a ELSE exp(a) - 1 END AS a, CASE WHEN b > 0 THEN b ELSE exp(b) - 1 END AS b FROM h)
SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(3 * a - 2 * b + 0.1))), 6) AS truth FROM e
""")
def fuzzy_network(spark, d):
    """A predicate given as a network of two layers."""
    layers = [([[0.5, -0.25], [-1.0, 0.5]], [0.01, 0.0]), ([[3.0, -2.0]], [0.1])]
    (truth,) = fuzzy.mlp([F.col("l_discount"), F.col("l_tax")], layers)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(truth, 6).alias("truth"))


@query("""
SELECT round(1 - sqrt(avg(pow(1 - v * 0.9999, 2))), 6) AS value FROM (SELECT avg(n_nationkey / 25.0) AS v FROM nation UNION ALL SELECT avg(r_regionkey / 5.0) FROM region)
""")
def fuzzy_satisfaction(spark, d):
    """How far two closed formulas hold together."""
    mean = L.quantifier(fuzzy.agg_mean, "forall")
    p, q = _fuzzy(spark, d)
    return fuzzy.sat_agg(fuzzy.agg_pmean_error, [mean(["x"], p).df, mean(["y"], q).df]).withColumn("value", F.round("value", 6))


_TENSORS = """
n AS (SELECT n_regionkey AS graph, n_nationkey AS x1, n_nationkey % 7 / 7.0 AS v FROM nation),
w AS (SELECT a.graph, a.x1, max(CASE WHEN a.x1 <> b.x1 THEN abs(a.v - b.v) ELSE 0.0 END) AS s, min(CASE WHEN a.x1 <> b.x1 THEN abs(a.v - b.v) ELSE 1.0 END) AS e FROM n a JOIN n b USING (graph) GROUP BY ALL),
o AS (SELECT graph, x1, 1 / (1 + exp(-(0.5 * v - s + 2 * e + 0.1))) AS o FROM n JOIN w USING (graph, x1))
"""


def _tensors(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("graph"), F.col("n_nationkey").alias("x1"), (F.col("n_nationkey") % 7 / 7).alias("v"))
    two = relalg.meshgrid(n, "x1", ["v"], "diff", ["graph"]).select("graph", F.col("x").alias("x1"), F.col("y").alias("x2"), F.abs("v_diff").alias("v"))
    return {1: n, 2: two}, n.select("graph", "x1")


@query(f"WITH {_TENSORS} SELECT graph, x1, round(o, 6) AS o0 FROM o")
def logic_layer(spark, d):
    tensors, domain = _tensors(spark, d)
    out = relalg.logic_layer(tensors, domain, {1: [([[0.5, -1.0, 2.0]], [0.1])]})
    return out[1].withColumn("o0", F.round("o0", 6))


@query(f"WITH {_TENSORS} SELECT graph, x1, round(1 / (1 + exp(-(1.5 * o - 0.5))), 6) AS o0 FROM o")
def logic_machine(spark, d):
    """Two layers, the second over what the first makes of nations."""
    tensors, domain = _tensors(spark, d)
    out = relalg.logic_machine(tensors, domain, [{1: [([[0.5, -1.0, 2.0]], [0.1])]}, {1: [([[1.5]], [-0.5])]}])
    (name,) = [c for c in out[1].columns if c not in ("graph", "x1")]
    return out[1].select("graph", "x1", F.round(name, 6).alias("o0"))
