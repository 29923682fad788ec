"""Fuzzy logic, truth bounds and relational calculus over the driver's star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from truthframe.functions import bounds as B
from truthframe.functions import fuzzy
from truthframe.operators import fuzzy_logic as L
from truthframe.operators import relalg
from truthframe.operators import relation as R
from truthframe.plans.registry import query
from truthframe.session import table

CONNECTIVES = {
    "not_std": ("1 - x", lambda x, y: fuzzy.not_std(x)),
    "not_godel": ("CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END", lambda x, y: fuzzy.not_godel(x)),
    "and_min": ("least(x, y)", fuzzy.and_min),
    "and_prod": ("(x * 0.9999 + 0.0001) * (y * 0.9999 + 0.0001)", fuzzy.and_prod),
    "and_luk": ("greatest(x + y - 1, 0.0)", fuzzy.and_luk),
    "or_max": ("greatest(x, y)", fuzzy.or_max),
    "or_prob_sum": ("x * 0.9999 + y * 0.9999 - x * 0.9999 * y * 0.9999", fuzzy.or_prob_sum),
    "or_luk": ("least(x + y, 1.0)", fuzzy.or_luk),
    "implies_kleene_dienes": ("greatest(1 - x, y)", fuzzy.implies_kleene_dienes),
    "implies_godel": ("CASE WHEN x <= y THEN 1.0 ELSE y END", fuzzy.implies_godel),
    "implies_reichenbach": ("1 - (x * 0.9999 + 0.0001) + (x * 0.9999 + 0.0001) * y * 0.9999", fuzzy.implies_reichenbach),
    "implies_goguen": ("CASE WHEN x <= y THEN 1.0 ELSE y / (x * 0.9999 + 0.0001) END", fuzzy.implies_goguen),
    "implies_luk": ("least(1 - x + y, 1.0)", fuzzy.implies_luk),
    "equiv_luk": ("greatest(least(1 - x + y, 1.0) + least(1 - y + x, 1.0) - 1, 0.0)", fuzzy.equiv(fuzzy.and_luk, fuzzy.implies_luk)),
}


def _xy(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.sqrt(F.col("l_discount") * 10).alias("x"), F.sqrt(F.col("l_tax") * 12.5).alias("y"))


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({sql}, 6) AS {n}" for n, (sql, _) in CONNECTIVES.items()) + " FROM (SELECT *, sqrt(l_discount * 10) AS x, sqrt(l_tax * 12.5) AS y FROM lineitem)")
def fuzzy_connectives(spark, d):
    x, y = F.col("x"), F.col("y")
    return _xy(spark, d).select("l_orderkey", "l_linenumber", *(F.round(f(x, y), 6).alias(n) for n, (_, f) in CONNECTIVES.items()))


@query("""
SELECT l_returnflag, round(min(x), 6) AS min_v, round(max(x), 6) AS max_v, round(avg(x), 6) AS mean_v,
  round(sqrt(avg(pow(x * 0.9999 + 0.0001, 2))), 6) AS pmean_v, round(1 - sqrt(avg(pow(1 - x * 0.9999, 2))), 6) AS pmean_error_v,
  round(sum(ln(x * 0.9999 + 0.0001)), 3) AS sum_log_v
FROM (SELECT l_returnflag, sqrt(l_discount * 10) AS x FROM lineitem) GROUP BY l_returnflag
""")
def fuzzy_aggregators(spark, d):
    x = F.col("x")
    return _xy(spark, d).groupBy("l_returnflag").agg(
        F.round(fuzzy.agg_min(x), 6).alias("min_v"),
        F.round(fuzzy.agg_max(x), 6).alias("max_v"),
        F.round(fuzzy.agg_mean(x), 6).alias("mean_v"),
        F.round(fuzzy.agg_pmean(x), 6).alias("pmean_v"),
        F.round(fuzzy.agg_pmean_error(x), 6).alias("pmean_error_v"),
        F.round(fuzzy.agg_sum_log(x), 3).alias("sum_log_v"),
    )


@query("""
SELECT r_name, round(product(1 - n_nationkey / 100.0), 9) AS prod_v FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")
def fuzzy_product(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_name").agg(F.round(fuzzy.agg_prod(1 - F.col("n_nationkey") / 100.0), 9).alias("prod_v"))


def _orders_by_segment(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("value"))
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")


_GUARDED = """
SELECT c_mktsegment, c_nationkey, round(coalesce({agg}, {empty}), 6) AS truth
FROM (SELECT c_mktsegment, c_nationkey, CASE WHEN o_orderstatus = 'P' THEN least(o_totalprice / 500000, 1.0) END AS v
      FROM customer LEFT JOIN orders ON c_custkey = o_custkey)
GROUP BY c_mktsegment, c_nationkey
"""


def _guarded(spark, d, aggregate, semantics):
    rows = _orders_by_segment(spark, d)
    free = ["c_mktsegment", "c_nationkey"]
    keys = [*free, "c_custkey", "o_orderkey"]
    # formula and guard stand in the same rows: one scan serves both
    formula = L.Fuzzy(rows.select(*keys, F.when(F.col("o_orderstatus") == "P", F.col("value")).alias("value")), keys)
    out = L.quantifier(aggregate, semantics)(["c_custkey", "o_orderkey"], formula)
    return out.df.select(*free, F.round("value", 6).alias("truth"))


@query(_GUARDED.format(agg="1 - sqrt(avg(pow(1 - v * 0.9999, 2)))", empty="1.0"))
def guarded_forall(spark, d):
    return _guarded(spark, d, fuzzy.agg_pmean_error, "forall")


@query(_GUARDED.format(agg="sqrt(avg(pow(v * 0.9999 + 0.0001, 2)))", empty="0.0"))
def guarded_exists(spark, d):
    return _guarded(spark, d, fuzzy.agg_pmean, "exists")


@query("""
SELECT a.vec_id AS a, b.vec_id AS b,
  round(exp(-0.1 * list_distance(a.e, b.e)), 6) AS by_exp, round(1 / (1 + 0.1 * list_distance(a.e, b.e)), 6) AS by_inv,
  CASE WHEN a.e = b.e THEN 1.0 ELSE 0.0 END AS strict
FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) a
JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) b ON a.label = b.label AND a.vec_id % 20 = 0
""")
def smooth_equality(spark, d):
    """Every twentieth vector as a query against all vectors of its label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    a, b = e.toDF("a", "label", "ea"), e.toDF("b", "label", "eb")
    ea, eb = F.col("ea"), F.col("eb")
    return a.filter("a % 20 = 0").join(b, "label").select(
        "a", "b", F.round(fuzzy.equal_smooth_exp(ea, eb, 0.1), 6).alias("by_exp"), F.round(fuzzy.equal_smooth_inv(ea, eb, 0.1), 6).alias("by_inv"), fuzzy.equal_strict(ea, eb).alias("strict")
    )


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS z FROM embeddings),
m AS (SELECT *, list_max(z) AS top FROM v), e AS (SELECT *, list_transform(z, lambda x: exp(x - top)) AS ex FROM m)
SELECT vec_id, round(ex[label % len(ex) + 1] / list_sum(ex), 6) AS single, round(1 / (1 + exp(-z[label % len(ex) + 1])), 6) AS multi FROM e
""")
def class_predicate(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("z"))
    i = F.col("label") % F.size("z")
    return v.select("vec_id", F.round(fuzzy.class_truth(F.col("z"), i), 6).alias("single"), F.round(fuzzy.class_truth(F.col("z"), i, True), 6).alias("multi"))


# truth bounds: two predicates over suppliers


def _bounds_rows(spark, d):
    # p: solvent; q: of a low nation key
    a = (F.col("s_acctbal") + 1000) / 11000
    return table(spark, d, "supplier").select(
        "s_suppkey", "s_nationkey", F.greatest(a - 0.1, F.lit(0.0)).alias("pl"), F.least(a + 0.1, F.lit(1.0)).alias("pu"), (F.col("s_nationkey") / 30).alias("ql"), F.least(F.col("s_nationkey") / 25 + 0.1, F.lit(1.0)).alias("qu")
    )


_BOUNDS = """(SELECT s_suppkey, s_nationkey, greatest((s_acctbal + 1000) / 11000 - 0.1, 0.0) AS pl, least((s_acctbal + 1000) / 11000 + 0.1, 1.0) AS pu,
  s_nationkey / 30.0 AS ql, least(s_nationkey / 25.0 + 0.1, 1.0) AS qu FROM supplier)"""


def _up(name, f, low, high):
    @query(f"SELECT s_suppkey, round({low}, 6) AS l, round({high}, 6) AS u FROM {_BOUNDS}", name)
    def run(spark, d):
        l, u = f((F.col("pl"), F.col("pu")), (F.col("ql"), F.col("qu")))
        return _bounds_rows(spark, d).select("s_suppkey", F.round(l, 6).alias("l"), F.round(u, 6).alias("u"))


_c = lambda x: f"greatest(least({x}, 1.0), 0.0)"
_AND = _c("pl + ql - 1"), _c("pu + qu - 1")
_OR = _c("pl + ql"), _c("pu + qu")
_IMP = _c("1 - pu + ql"), _c("1 - pl + qu")
_PMI = _c("1 - qu + pl"), _c("1 - ql + pu")
_up("bounds_and_up", lambda p, q: B.and_up([p, q]), *_AND)
_up("bounds_and_weighted", lambda p, q: B.and_up([p, q], [0.5, 2.0], 0.9), _c("0.9 - 0.5 * (1 - pl) - 2 * (1 - ql)"), _c("0.9 - 0.5 * (1 - pu) - 2 * (1 - qu)"))
_up("bounds_or_up", lambda p, q: B.or_up([p, q]), *_OR)
_up("bounds_implies_up", B.implies_up, *_IMP)
_up("bounds_not", lambda p, q: B.not_(p), "1 - pu", "1 - pl")
_up("bounds_iff", B.iff_up, *(_c(f"{a} + {b} - 1") for a, b in zip(_IMP, _PMI)))
_up("bounds_xor", lambda p, q: B.xor_up([p, q]), *(_c(f"{o} - {a}") for o, a in zip(_OR, reversed(_AND))))
_up("bounds_congruent", lambda p, q: B.congruent_up([p, q]), "greatest(pl, ql)", "least(pu, qu)")


@query(f"""
SELECT s_suppkey,
  round(CASE WHEN wl > 0 THEN {_c("wl + 1 - qu")} ELSE 0.0 END, 6) AS p_l, round(CASE WHEN wu < 1 THEN {_c("wu + 1 - ql")} ELSE 1.0 END, 6) AS p_u,
  round(CASE WHEN wl > 0 THEN {_c("wl + 1 - pu")} ELSE 0.0 END, 6) AS q_l, round(CASE WHEN wu < 1 THEN {_c("wu + 1 - pl")} ELSE 1.0 END, 6) AS q_u
FROM (SELECT *, (s_suppkey % 5) / 8.0 AS wl, 0.5 + (s_suppkey % 3) / 4.0 AS wu FROM {_BOUNDS})
""")
def bounds_and_down(spark, d):
    rows = _bounds_rows(spark, d).withColumns({"wl": (F.col("s_suppkey") % 5) / 8, "wu": F.lit(0.5) + (F.col("s_suppkey") % 3) / 4})
    p, q = B.and_down((F.col("wl"), F.col("wu")), [(F.col("pl"), F.col("pu")), (F.col("ql"), F.col("qu"))])
    return rows.select("s_suppkey", *(F.round(c, 6).alias(n) for c, n in zip((*p, *q), ("p_l", "p_u", "q_l", "q_u"))))


@query(f"""
SELECT s_suppkey,
  round(CASE WHEN wl > 0 THEN 0.0 ELSE 0.0 END + CASE WHEN 1 - wu > 0 THEN {_c("1 - wu + ql")} ELSE 0.0 END, 6) AS p_l,
  round(CASE WHEN 1 - wl < 1 THEN {_c("1 - wl + qu")} ELSE 1.0 END, 6) AS p_u,
  round(1 - CASE WHEN 1 - wl < 1 THEN {_c("1 - wl + 1 - pl")} ELSE 1.0 END, 6) AS q_l,
  round(1 - CASE WHEN 1 - wu > 0 THEN {_c("1 - wu + 1 - pu")} ELSE 0.0 END, 6) AS q_u
FROM (SELECT *, (s_suppkey % 5) / 8.0 AS wl, 0.5 + (s_suppkey % 3) / 4.0 AS wu FROM {_BOUNDS})
""")
def bounds_implies_down(spark, d):
    rows = _bounds_rows(spark, d).withColumns({"wl": (F.col("s_suppkey") % 5) / 8, "wu": F.lit(0.5) + (F.col("s_suppkey") % 3) / 4})
    p, q = B.implies_down((F.col("wl"), F.col("wu")), (F.col("pl"), F.col("pu")), (F.col("ql"), F.col("qu")))
    return rows.select("s_suppkey", *(F.round(c, 6).alias(n) for c, n in zip((*p, *q), ("p_l", "p_u", "q_l", "q_u"))))


_STATE_ROWS = "(SELECT s_suppkey, (s_suppkey * 7 % 5) / 4.0 AS l, (s_suppkey * 3 % 9) / 8.0 AS u FROM supplier)"


def _state_rows(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 7 % 5) / 4).alias("l"), ((F.col("s_suppkey") * 3 % 9) / 8).alias("u"))


@query(f"""
SELECT s_suppkey, CASE WHEN l > u THEN 'C' WHEN l = 0 AND u = 1 THEN 'U' WHEN u = 0 THEN 'F' WHEN l = 1 THEN 'T' WHEN l = 0.5 AND u = 0.5 THEN '=U'
  WHEN u < 0.5 THEN '~F' WHEN l > 0.5 THEN '~T' ELSE '~U' END AS state FROM {_STATE_ROWS}
""")
def bounds_state(spark, d):
    return _state_rows(spark, d).select("s_suppkey", B.state((F.col("l"), F.col("u"))).alias("state"))


@query(f"SELECT s_suppkey, l, u FROM {_STATE_ROWS} WHERE l > u")
def contradictions(spark, d):
    return _state_rows(spark, d).filter(B.is_contradiction((F.col("l"), F.col("u"))))


@query(f"""
SELECT coalesce(a.k, b.k) AS k, greatest(coalesce(a.l, 0.0), coalesce(b.l, 0.0)) AS l, least(coalesce(a.u, 1.0), coalesce(b.u, 1.0)) AS u
FROM (SELECT s_suppkey AS k, l, u FROM {_STATE_ROWS}) a
FULL JOIN (SELECT s_suppkey // 2 * 3 AS k, max(s_suppkey % 4 / 4.0) AS l, min(0.5 + s_suppkey % 3 / 4.0) AS u FROM supplier GROUP BY 1) b ON a.k = b.k
""")
def tighten(spark, d):
    """Proofs come several to a key, some of them for keys without bounds."""
    known = R.Relation(_state_rows(spark, d).withColumnRenamed("s_suppkey", "k"), ["k"])
    proofs = table(spark, d, "supplier").select((F.floor(F.col("s_suppkey") / 2) * 3).alias("k"), (F.col("s_suppkey") % 4 / 4).alias("l"), (F.col("s_suppkey") % 3 / 4 + 0.5).alias("u"))
    return known.tighten(proofs).df


@query(f"""
SELECT sum(greatest(l - u, 0)) AS contradiction, sum(greatest(u - l, 0)) AS uncertainty, round(avg((pow(l - 0.5, 2) + pow(u - 1, 2)) / 2), 6) AS supervised FROM {_STATE_ROWS}
""")
def bounds_losses(spark, d):
    x = (F.col("l"), F.col("u"))
    return _state_rows(spark, d).agg(B.contradiction_loss(x).alias("contradiction"), B.uncertainty_loss(x).alias("uncertainty"), F.round(B.supervised_loss(x, (F.lit(0.5), F.lit(1.0))), 6).alias("supervised"))


@query("""
WITH p AS (SELECT n_name AS x, n_regionkey AS y FROM nation), q AS (SELECT r_regionkey AS y, r_name AS z FROM region)
SELECT p.x, p.y, q.z FROM p, q UNION SELECT p.x, q.y, q.z FROM p, q
""")
def grounding_join(spark, d):
    p = table(spark, d, "nation").select(F.col("n_name").alias("x"), F.col("n_regionkey").alias("y"))
    return R.dual_key_join(p, table(spark, d, "region").select(F.col("r_regionkey").alias("y"), F.col("r_name").alias("z")))


@query("SELECT n_name AS x, 1.0::DOUBLE AS l, 1.0::DOUBLE AS u FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def binding(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rel = R.Relation(both.select(F.col("n_name").alias("g0"), F.col("r_name").alias("g1"), F.lit(1.0).alias("l"), F.lit(1.0).alias("u")), ["g0", "g1"])
    return rel.bind(["x", R.Const("ASIA")])


_NATION_BOUNDS = "(SELECT c_nationkey, c_custkey, greatest(1 - c_custkey % 97 / 900.0, 0.0) - 0.001 AS l, 1 - c_custkey % 89 / 9000.0 AS u FROM customer)"


def _customers(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", (F.greatest(1 - c % 97 / 900, F.lit(0.0)) - 0.001).alias("l"), (1 - c % 89 / 9000).alias("u"))


@query(f"SELECT c_nationkey, 0.0::DOUBLE AS l, round(greatest(0, 1 - sum(1 - u)), 6) AS u FROM {_NATION_BOUNDS} GROUP BY c_nationkey")
def forall_free(spark, d):
    return R.forall_up(_customers(spark, d), ["c_nationkey"]).withColumn("u", F.round("u", 6))


@query("SELECT c_nationkey, round(least(1, sum(c_custkey % 7 / 4000.0)), 6) AS l, 1.0::DOUBLE AS u FROM customer GROUP BY c_nationkey")
def exists_free(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 7 / 4000).alias("l"), F.lit(1.0).alias("u"))
    return R.exists_up(rows, ["c_nationkey"]).withColumn("l", F.round("l", 6))


@query(f"""
SELECT c_nationkey, c_custkey, round(greatest(least(0.9 + sum(1 - u) OVER w - (1 - u), 1), 0), 6) AS l, round(greatest(least(0.95 + sum(1 - l) OVER w - (1 - l), 1), 0), 6) AS u
FROM {_NATION_BOUNDS} WINDOW w AS (PARTITION BY c_nationkey)
""")
def quantifier_down(spark, d):
    rows = _customers(spark, d)
    whole = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(0.9).alias("l"), F.lit(0.95).alias("u"))
    out = R.forall_down(rows, whole, ["c_nationkey"])
    return out.withColumns({"l": F.round("l", 6), "u": F.round("u", 6)})


@query("""
WITH n AS (SELECT n_nationkey AS x, n_regionkey AS r, (n_nationkey % 7) / 7.0 AS v FROM nation),
p AS (SELECT a.r, a.x AS x1, b.x AS x2, round(abs(a.v - b.v), 6) AS v FROM n a JOIN n b ON a.r = b.r)
SELECT r, x1, max(CASE WHEN x1 <> x2 THEN v ELSE 0.0 END) AS v_exists, min(CASE WHEN x1 <> x2 THEN v ELSE 1.0 END) AS v_forall FROM p GROUP BY r, x1
""")
def reduce_exclude_self(spark, d):
    return relalg.reduce_last(_nation_pairs(spark, d), ["x1", "x2"], ["v"], ["r"])


def _nation_pairs(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("x"), (F.col("n_nationkey") % 7 / 7).alias("v"))
    pairs = relalg.meshgrid(n, "x", ["v"], "diff", ["r"])
    return pairs.select("r", F.col("x").alias("x1"), F.col("y").alias("x2"), F.round(F.abs("v_diff"), 6).alias("v"))


@query("SELECT n_regionkey AS r, n_nationkey AS x1, r_regionkey AS x2 FROM nation CROSS JOIN region")
def expand(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("x1"))
    return relalg.expand(n, table(spark, d, "region").select("r_regionkey"), "x2")


@query("""
WITH n AS (SELECT n_nationkey AS x, n_regionkey AS r FROM nation), p AS (SELECT a.r, a.x AS x1, b.x AS x2, (a.x * 31 + b.x) % 11 / 11.0 AS v FROM n a JOIN n b ON a.r = b.r)
SELECT p.r, p.x1, p.x2, round(p.v, 6) AS v_p01, round(q.v, 6) AS v_p10 FROM p JOIN p q ON p.r = q.r AND p.x1 = q.x2 AND p.x2 = q.x1
""")
def permute(spark, d):
    p = _nation_pairs(spark, d).withColumn("v", F.round((F.col("x1") * 31 + F.col("x2")) % 11 / 11, 6))
    return relalg.permute(p, ["x1", "x2"], ["v"], ["r"])


@query("SELECT a.p_brand, a.p_type, a.p_partkey AS x, b.p_partkey AS y, a.p_size < b.p_size AS p_size_lt, a.p_size = b.p_size AS p_size_eq, a.p_size > b.p_size AS p_size_gt FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type WHERE a.p_partkey <> b.p_partkey")
def cmp_meshgrid(spark, d):
    return relalg.meshgrid(table(spark, d, "part"), "p_partkey", ["p_size"], "cmp", ["p_brand", "p_type"], exclude_self=True)


@query("SELECT r, round(avg(v) FILTER (v > 0.2), 6) AS v_mean, max(v) FILTER (v > 0.2) AS v_max FROM (SELECT n_regionkey AS r, round((n_nationkey % 7) / 7.0, 6) AS v FROM nation) GROUP BY r")
def masked_pool(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("r"), F.round(F.col("n_nationkey") % 7 / 7, 6).alias("v"))
    return relalg.masked_pool(n, ["r"], ["v"], F.col("v") > 0.2).withColumn("v_mean", F.round("v_mean", 6))
