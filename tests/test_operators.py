"""Goldens and invariants of the core operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from truthframe.functions import fuzzy
from truthframe.functions import text as X
from truthframe.functions.bodies import body_triples
from truthframe.operators import fuzzy_logic as L
from truthframe.operators import graphs as G
from truthframe.operators import interactions as I
from truthframe.operators import metrics as M
from truthframe.operators import ontology as O
from truthframe.operators import patterns as P
from truthframe.operators import relalg, sampling, scorers
from truthframe.operators import triples as T


def one(df):
    (row,) = df.collect()
    return row


def test_guarded_exists_and_empty_groups(spark):
    mask = [[1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 0]]
    value = [[0.4, 0.2, 0.8, 0.0], [0.9, 0.1, 0.5, 0.2], [0.3, 0.0, 0.8, 0.9]]
    rows = [(x, y, value[x][y], bool(mask[x][y])) for x in range(3) for y in range(4)]
    df = spark.createDataFrame(rows, "x int, y int, value double, keep boolean")
    f = L.Fuzzy(df.select("x", "y", "value"), ["x", "y"])
    m = L.Fuzzy(df.select("x", "y", F.col("keep").alias("value")), ["x", "y"])
    out = L.quantifier(fuzzy.agg_mean, "exists")(["x"], f, m)
    assert [r.value for r in out.df.orderBy("y").collect()] == pytest.approx([0.4, 0.15, 0.65, 0])
    nothing = L.Fuzzy(df.select("x", "y", F.lit(False).alias("value")), ["x", "y"])
    assert one(L.quantifier(fuzzy.agg_pmean_error, "forall")(["x", "y"], f, nothing).df).value == 1.0
    assert one(L.quantifier(fuzzy.agg_pmean, "exists")(["x", "y"], f, nothing).df).value == 0.0


def test_broadcast_connective_and_diagonal(spark):
    a = L.variable(spark.createDataFrame([(i, [float(i)]) for i in range(3)], "id int, v array<double>"), "x", "id", "v")
    b = L.variable(spark.createDataFrame([(i, float(i)) for i in range(5, 8)], "id int, v double"), "y", "id", "v")
    p = L.predicate(lambda u: F.element_at(u, 1) / 2)
    q = L.predicate(lambda u, v: fuzzy.equal_smooth_inv(u, v))
    both = L.connective(fuzzy.and_min)(p(a), q(a, b))
    assert both.free == ["x", "y"] and both.df.count() == 9
    assert both.take("x", 0).free == ["y"] and both.take("y", [5, 6]).df.count() == 6 and both.reorder(["y", "x"]).df.columns[0] == "y"
    assert sorted((r.x, r.y) for r in L.diagonal(a, b).select("x", "y").collect()) == [(0, 5), (1, 6), (2, 7)]
    sat = fuzzy.sat_agg(fuzzy.agg_mean, [spark.createDataFrame([(v,)], "value double") for v in (0.2, 0.6)])
    assert one(sat).value == pytest.approx(0.4)


def test_with_rank_is_gapless(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v long").repartition(5)
    assert all(r.v + 1 == r.n for r in L.with_rank(df, "v", "n").collect())
    many = spark.range(400_000).select((F.col("id") * 7919 % 400_009).alias("v"), F.lit("x").alias("w"))
    got = L.with_rank(many, "v", "n").agg(F.countDistinct("n").alias("d"), F.max("n").alias("m"), F.min("n").alias("l")).first()
    assert (got.d, got.m, got.l) == (400_000, 400_000, 1)


def test_softmax_and_mlp(spark):
    df = spark.createDataFrame([([1.0, 2.0, 800.0],)], "z array<double>")
    assert one(df.select(fuzzy.class_truth(F.col("z"), F.lit(2)).alias("t"))).t == pytest.approx(1.0)
    y = fuzzy.mlp([F.lit(1.0), F.lit(-2.0)], [([[1.0, 1.0], [0.5, 0.0]], [0.0, 0.0]), ([[1.0, 2.0]], [0.1])])
    want = 1 / (1 + math.exp(-((math.exp(-1) - 1) + 2 * 0.5 + 0.1)))
    assert one(spark.range(1).select(y[0].alias("y"))).y == pytest.approx(want)


def test_reduce_and_permute(spark):
    df = spark.createDataFrame([(0, a, b, (a * 3 + b) / 10) for a in range(3) for b in range(3)], "graph int, x1 int, x2 int, v double")
    got = {r.x1: (r.v_exists, r.v_forall) for r in relalg.reduce_last(df, ["x1", "x2"], ["v"], ["graph"]).collect()}
    assert got == {0: (0.2, 0.1), 1: (0.5, 0.3), 2: (0.7, 0.6)}
    only_self = df.filter("x1 = x2")
    assert {(r.v_exists, r.v_forall) for r in relalg.reduce_last(only_self, ["x1", "x2"], ["v"], ["graph"]).collect()} == {(0.0, 1.0)}
    p = relalg.permute(df, ["x1", "x2"], ["v"], ["graph"])
    assert all(r.v_p10 == (r.x2 * 3 + r.x1) / 10 for r in p.collect())
    three = spark.createDataFrame([(a, b, c, a * 100 + b * 10 + c) for a in range(2) for b in range(2) for c in range(2)], "x1 int, x2 int, x3 int, v int")
    for r in relalg.permute(three, ["x1", "x2", "x3"], ["v"]).collect():
        assert r.v_p201 == (r.x3 * 100 + r.x1 * 10 + r.x2) and r.v_p012 == r.x1 * 100 + r.x2 * 10 + r.x3


def test_logic_machine_shapes(spark):
    domain = spark.createDataFrame([(0, i) for i in range(3)], "graph int, x int")
    unary = domain.select("graph", F.col("x").alias("x1"), (F.col("x") / 2).alias("a"))
    binary = relalg.expand(unary, domain, "x2", ["graph"]).select("graph", "x1", "x2", (F.col("a") * F.col("x2") / 4).alias("b"))
    layer = {1: [([[0.3] * 3], [0.1])], 2: [([[0.2] * 4], [0.0])]}
    out = relalg.logic_machine({1: unary, 2: binary}, domain, [layer], ["graph"])
    assert out[1].count() == 3 and out[2].count() == 9
    assert all(0 < r["l0_o0"] < 1 for r in out[2].collect())


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)]


def test_graph_operators(spark):
    e = spark.createDataFrame(EDGES, "src int, dst int")
    n = spark.createDataFrame([(i,) for i in range(1, 7)], "node int")
    d = {(r.src, r.dst): r.dist for r in G.distances(e, n, pairs=True).collect()}
    assert d[1, 4] == 3 and d[4, 1] == 7 and d[2, 2] == 0 and len(d) == 36
    assert {(r.src, r.dst) for r in G.on_cycle(e).collect()} == {(1, 2), (2, 3), (3, 1)}
    assert G.on_cycle(e.filter("src > 2")).count() == 0
    assert {r.node for r in G.closure(e, n.filter("node = 2")).collect()} == {1, 2, 3, 4}
    nodes, edges = G.k_hop(e, n.filter("node = 1"), 2)
    assert {(r.node, r.hop) for r in nodes.collect()} == {(1, 0), (2, 1), (3, 2)} and edges.count() == 3
    assert G.undirected(e).count() == 10 and G.with_identity(e, n).count() == 11
    reduced = G.transitive_reduction_step(spark.createDataFrame([(3, 2), (2, 1), (3, 1)], "src int, dst int"))
    assert {(r.src, r.dst) for r in reduced.collect()} == {(3, 2), (2, 1)}
    places = spark.createDataFrame(list(enumerate([2, 0, 1, 3, 5, 4])), "p int, v int")
    assert one(G.optimal_swaps(places, "p", "v")).swaps == 3


def test_family(spark):
    f = spark.createDataFrame(
        [("father", 3, 1), ("mother", 3, 2), ("father", 4, 1), ("son", 1, 3), ("daughter", 1, 4), ("daughter", 2, 4), ("father", 5, 3), ("mother", 6, 4), ("daughter", 3, 5)], "rel string, a int, b int"
    )
    people = spark.createDataFrame([(i,) for i in range(1, 7)], "p int")
    assert {r.p for r in G.has_sister(f, people).collect()} == {3}
    assert {(r.a, r.b) for r in G.grandparents(f).collect()} == {(5, 1), (5, 2), (6, 1)}
    assert {(r.a, r.b) for r in G.uncles(f).collect()} == {(6, 3)}
    family = G.random_family(spark, 40)
    assert family.filter("rel = 'wife'").count() == family.filter("rel = 'husband'").count() == 20
    assert G.random_graph(spark, 30, 0.5).count() > 300
    near = G.nearest_neighbours(spark.createDataFrame([(i, i / 10, 0.0) for i in range(9)], "node int, x double, y double"), 1)
    assert near.count() == 9 and near.filter("abs(src - dst) != 1").count() == 0


def test_long_chains_have_no_cycle(spark):
    e = spark.range(450).selectExpr("id as src", "id + 1 as dst")
    assert G.on_cycle(e).count() == 0
    loop = spark.createDataFrame([(5, 3), (9, 9)], "src long, dst long")
    got = {(r.src, r.dst) for r in G.on_cycle(e.union(loop)).collect()}
    assert got == {(3, 4), (4, 5), (5, 3), (5, 6), (6, 7), (7, 8), (8, 9), (9, 9)}


def test_closure_follows_long_chains(spark):
    e = spark.range(104).coalesce(1).selectExpr("id as src", "id + 1 as dst")
    assert G.closure(e, spark.range(1)).count() == 105


def test_walks(spark):
    e = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c"), ("b", "r", "a")], "s string, p string, o string")
    w = G.random_walks(e, spark.createDataFrame([("a",), ("c",)], "n string"), 2)
    assert {tuple(r.walk) for r in w.collect()} == {("a", "p", "b", "q", "c"), ("a", "p", "b", "r", "a"), ("c",)}
    assert {tuple(r.walk) for r in G.anonymous(w).collect()} == {("a", "1", "2", "3", "4"), ("a", "1", "2", "3", "0"), ("c",)}
    assert G.random_walks(e, spark.createDataFrame([("a",)], "n string"), 2, cap=1).count() == 1


def test_blocks(spark):
    on = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 0)], "world int, block int, under int")
    assert {r.block for r in G.clear_blocks(on).collect()} == {2, 3}
    moved = G.move_block(on, spark.createDataFrame([(1, 2, 3), (1, 1, 3)], "world int, block int, target int"))
    assert {(r.block, r.under) for r in moved.collect()} == {(1, 0), (2, 3), (3, 0)}
    assert {(r.block, r.depth) for r in G.block_depths(moved).collect()} == {(1, 1), (3, 1), (2, 2)}
    assert one(G.goal_reached(on, on)).reached and not one(G.goal_reached(moved, on)).reached


@pytest.mark.parametrize(
    "expr, want",
    [
        (lambda r: M.average_precision(r), {(1, 1, 0, 1, 0, 1, 0, 0, 0, 1): 0.7833333}),
        (lambda r: M.dcg_at(r, 1), {(3, 2, 3, 0, 0, 1, 2, 2, 3, 0): 3.0}),
        (lambda r: M.dcg_at(r, 2), {(3, 2, 3, 0, 0, 1, 2, 2, 3, 0): 5.0}),
        (lambda r: M.dcg_at(r, 2, 1), {(3, 2, 3, 0, 0, 1, 2, 2, 3, 0): 4.2618595}),
        (lambda r: M.dcg_at(r, 10), {(3, 2, 3, 0, 0, 1, 2, 2, 3, 0): 9.6051177}),
        (lambda r: M.reciprocal_rank(r), {(0, 0, 1): 1 / 3, (0, 1, 0): 0.5, (0, 0, 0): 0.0}),
        (lambda r: M.r_precision(r), {(0, 1, 0): 0.5, (1, 0, 0): 1.0, (0, 0): 0.0}),
        (lambda r: M.precision_at(r, 2), {(0, 1, 1): 0.5}),
        (lambda r: M.ndcg_at(r, 4), {(0, 0): 0.0, (3, 2): 1.0}),
    ],
)
def test_ranking_lists(spark, expr, want):
    for r, w in want.items():
        df = spark.createDataFrame([(list(r),)], "r array<int>")
        assert one(df.select(expr(F.col("r")).alias("v"))).v == pytest.approx(w)


def test_threshold_and_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert one(M.auc(df, "s", "y")).auc == pytest.approx(0.75)
    best = one(M.best_threshold(df, "s", "y"))
    assert best.balanced == pytest.approx(0.75) and 0.1 < best.threshold <= 0.35
    assert one(M.best_threshold(df, "s", "y", robust=True)).threshold == pytest.approx(0.5)
    flat = spark.createDataFrame([(0.3, 0), (0.3, 1)], "s double, y int")
    assert one(M.best_threshold(flat, "s", "y", robust=True)).threshold == pytest.approx(0.3)
    assert one(M.auc(flat.filter("y = 1"), "s", "y")).auc is None
    many = spark.range(200_000).select((F.col("id") / 200_000).alias("s"), (F.col("id") % 2).cast("int").alias("y"))
    assert one(M.auc(many, "s", "y")).auc == pytest.approx(0.5, abs=1e-5)
    c = one(M.confusion(flat.limit(0), "s", "y"))
    assert (c.tp, c.f1) == (0, 0.0)
    assert M.early_stop([1, 3, 2, 2], 2) and not M.early_stop([1, 2, 3], 2)


def test_leave_out_with_labels(spark):
    labels = [0, 1, 1, 0, 0, 1, 0, 1, 0]
    df = spark.createDataFrame([(1, i, y) for i, y in enumerate(labels)], "uid int, time int, label int")
    got = [r.split for r in I.leave_out_by_time(df, 1, 2, 1, positives_only=False).orderBy("time").collect()]
    assert got == ["train"] * 7 + ["out1"] * 2
    got = [r.split for r in I.leave_out_by_time(df, 1, 2, 2, positives_only=False).orderBy("time").collect()]
    assert got == ["train"] * 5 + ["out2"] * 2 + ["out1"] * 2
    none = I.leave_out_by_time(df.withColumn("label", F.lit(0)), 1, 2, 1, positives_only=False)
    assert {r.split for r in none.collect()} == {"train"}


def test_histories_and_negatives(spark):
    df = spark.createDataFrame([(1, 10, 1, 1), (1, 11, 0, 2), (1, 12, 1, 3), (1, 13, 1, 4)], "uid int, iid int, label int, time int")
    h = [r.history for r in I.history(df, 1).orderBy("time").collect()]
    assert h == [[], [10], [10], [12]]
    assert [r.history for r in I.history(df, 0, "signed").orderBy("time").collect()][3] == [10, -11, 12]
    n = I.history(df, 2, "column").orderBy("time").collect()[3]
    assert n.history == [10, 12] and n.history_neg == [11]
    users, items = spark.createDataFrame([(1,), (2,)], "uid int"), spark.createDataFrame([(i,) for i in range(10, 40)], "iid int")
    neg = I.negatives(users, items, df, 3).collect()
    assert len(neg) == 6 and not {(r.uid, r.iid) for r in neg} & {(1, i) for i in range(10, 14)}
    few = I.negatives(users.limit(1), items, items.select(F.lit(1).alias("uid"), "iid").filter("iid > 12"), 5)
    assert {r.iid for r in few.collect()} == {10, 11, 12}
    assert one(df.limit(1).select(I.padded(F.array(F.lit(3), F.lit(4)), 4).alias("x"))).x == [0, 0, 3, 4]
    assert I.multi_hot_offsets({"a": 3, "b": 2}) == {"a": 0, "b": 3}


def test_splits_have_their_sizes(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    out = sampling.stratified_split(df, "id", ["k"], [("test", 0.1), ("validation", 0.2), ("train", 0.7)])
    sizes = {(r.k, r.split): r["count"] for r in out.groupBy("k", "split").count().collect()}
    assert sizes[0, "test"] == 33 and sizes[0, "validation"] == 66 and sizes[0, "train"] == 235
    assert out.repartition(7).exceptAll(sampling.stratified_split(df.repartition(9), "id", ["k"], [("test", 0.1), ("validation", 0.2), ("train", 0.7)])).count() == 0


LINES = """Prefix: ex: <http://x.org/>
Ontology:
Class: ex:Cat
SubClassOf:
ex:Animal
ex:eats some ex:Mouse
and ex:Pet
DisjointWith:
ex:Dog, ex:Fish
Individual: ex:Tom
Types:
ex:Cat
Facts:
ex:eats  ex:Jerry
Weird: ex:Rose"""


def test_lines_to_triples(spark):
    df = spark.createDataFrame([("f", i, line) for i, line in enumerate(LINES.split("\n"))], "file_name string, line_no int, line string")
    t = T.clean_triples(T.translate_lines(T.remove_prefixes(df)))
    assert {(r.s, r.p, r.o) for r in t.collect()} == {
        ("Cat", "SubClassOf", "Animal"), ("Cat", "SubClassOf", "eats some Mouse and Pet"), ("Cat", "DisjointWith", "Dog"), ("Cat", "DisjointWith", "Fish"),
        ("Tom", "is", "Cat"), ("Tom", "eats", "Jerry"), ("Rose", "is", "Weird"),
    }


def test_text_functions(spark):
    df = spark.createDataFrame([("eats some (Cat or not Dog), only x,",)], "o string")
    r = one(df.select(X.expression_tokens(F.col("o")).alias("t"), X.operators_in(F.col("o")).alias("ops"), X.first_restriction(F.col("o")).alias("first")))
    assert r.t == ["eats", "some", "Cat", "or", "not", "Dog", "only", "x"] and r.ops == ["not", "only", "or", "some"] and r.first == "some"
    n = one(spark.range(1).select(X.camel_words(F.lit("hasHTTPServer_id2")).alias("c"), X.plain_name(F.lit("GraduateStudent12")).alias("p"), X.natural_key(F.lit("a10b2")).alias("k"), X.shorten(F.lit("  a  b "), 2).alias("s")))
    assert n.c == ["has", "http", "server", "id2"] and n.p == "graduate student 12" and n.k == "a000000000010b000000000002" and n.s == "a …"
    assert X.isub_score("Professor", "professor") == 1.0 and X.isub_score("FullProfessor", "AssociateProfessor") > X.isub_score("FullProfessor", "Course")
    assert one(df.select(body_triples(F.lit("(('a ', 'b', 'c'),)")).alias("t"))).t[0].asDict() == {"s": "a", "p": "b", "o": "c"}


def test_dnf(spark):
    df = spark.createDataFrame([({1: 1, 2: 0, 3: 1},)], "v map<int,int>")
    for s, want in (("(1 ^ ~2) v 3", True), ("2 v (1 ^ 2)", False), ("~3 v (1 ^ 3)", True)):
        assert one(df.select(X.dnf_holds(X.parse_dnf(F.lit(s)), F.col("v")).alias("x"))).x is want


def axioms(spark, *rows):
    return spark.createDataFrame([("o", k, a, p, b, n) for k, a, p, b, n in rows], "onto string, kind string, a string, prop string, b string, n string")


def test_patterns(spark):
    ax = axioms(spark, ("some", "A", "r", "B", None), ("someand", "A", "r", "B", "C"), ("dis", "C", None, "B", None), ("domain", None, "p", "D", None), ("fact", "i", "p", "j", None), ("type", "i", None, "E", None), ("dis", "D", None, "E", None))
    assert one(P.detect(ax, "AIO")).c1 == "A" and P.detect(ax, "OOD").count() == 1 and P.detect(ax, "OOD", strict=True).count() == 0
    part = ax.filter("kind != 'dis'")
    got = {(r.kind, r.a, r.b) for r in P.complete(part, "OOD").collect()}
    assert got == {("dis", "D", "E")} and P.complete(ax, "OOD").filter("kind = 'dis'").count() == 0
    chain = axioms(spark, ("sub", "A", None, "B", None), ("sub", "B", None, "C", None))
    assert {(r.a, r.b) for r in P.complete(chain, "CSC").collect()} == {("C", "A")}
    injected = P.inject(chain, ["CSC"], 3)
    assert injected.count() == 1 and P.detect(chain.unionByName(injected.select(*chain.columns)), "CSC").count() == 3
    assert one(P.missing_signals(chain, "EID")).missing == ["dis", "eq"]


def test_axioms_from_triples(spark):
    t = spark.createDataFrame(
        [("o", "A", "SubClassOf", "B and (r some C)"), ("o", "A", "SubClassOf", "r max 1 Thing"), ("o", "A", "EquivalentTo", "D"), ("o", "x", "is", "A"), ("o", "x", "likes", "y"), ("o", "r", "Domain", "A")], "onto string, s string, p string, o string"
    )
    got = {(r.kind, r.a, r.prop, r.b) for r in P.axioms_from_triples(t).collect()}
    assert got == {("sub", "A", None, "B"), ("some", "A", "r", "C"), ("max1", "A", "r", None), ("eq", "A", None, "D"), ("type", "x", None, "A"), ("fact", "x", "likes", "y"), ("domain", None, "r", "A")}


def test_locality():
    c = lambda n: ["class", n]
    assert O.is_local(["sub", c("A"), c("B")], set()) and not O.is_local(["sub", c("A"), c("B")], {"A"})
    assert not O.is_local(["sub", c("A"), c("B")], {"B"}, bottom=False) and O.is_local(["sub", c("A"), c("B")], {"B"})
    assert O.is_local(["sub", ["some", "r", c("A")], c("B")], {"A", "B"}) and not O.is_local(["sub", ["some", "r", c("A")], c("B")], {"A", "r"})
    assert O.is_local(["domain", "r", c("A")], {"A"}) and not O.is_local(["domain", "r", c("A")], {"r"})
    assert not O.is_local(["eq", c("A"), c("B")], {"B"}) and O.is_local(["eq", c("A"), c("B")], set())
    assert not O.is_local(["type", c("A"), "x"], set()) and O.is_local(["type", c("A"), "x"], set(), ignore_assertions=True)
    assert O.terms_of(["sub", ["min", 2, "r", c("A")], c("Thing")]) == ["A", "r"]


def test_module_extraction(spark):
    rows = ['["sub",["class","A"],["some","r",["class","B"]]]', '["sub",["class","B"],["class","C"]]', '["sub",["class","X"],["class","A"]]', '["domain","r",["class","D"]]']
    ax = spark.createDataFrame([("o", a) for a in rows], "onto string, axiom string")
    got = {r.axiom for r in O.extract_module(ax, spark.createDataFrame([("o", "A")], "onto string, term string")).collect()}
    assert got == {rows[0], rows[1], rows[3]}


def test_projection_and_merging(spark):
    ax = axioms(spark, ("sub", "A", None, "B", None), ("inverse", "p", None, "q", None), ("fact", "i", "p", "j", None), ("domain", None, "p", "A", None), ("range", None, "p", "B", None))
    got = {(r.s, r.p, r.o) for r in O.project(ax, both_ways=True).collect()}
    assert {("A", "subClassOf", "B"), ("B", "superClassOf", "A"), ("i", "p", "j"), ("j", "q", "i"), ("A", "p", "B"), ("B", "q", "A")} == got
    merged = O.merge_by_mapping(ax, spark.createDataFrame([("Bee", "B")], "a string, b string"))
    assert merged.filter("b = 'Bee'").count() == 2
    q = one(O.merge_quality(ax, merged))
    assert 0 < q.coverage < 1 and q.redundancy == 0
    names = O.match_names(spark.createDataFrame([("FullProfessor",), ("Course",)], "n string"), spark.createDataFrame([("fullProfessors",), ("Courses",)], "m string"), 0.5)
    assert {(r.a, r.b) for r in names.collect()} == {("FullProfessor", "fullProfessors"), ("Course", "Courses")}


def test_partitions(spark):
    e = [(i, j) for g in (0, 10) for i in range(g, g + 5) for j in range(g, g + 5) if i < j] + [(4, 10)]
    blocks = {r.node: r.block for r in O.agglomerate(spark.createDataFrame(e, "src long, dst long"), 5).collect()}
    assert len({blocks[i] for i in range(5)}) == 1 and len({blocks[i] for i in range(10, 15)}) == 1 and blocks[0] != blocks[10]


def test_name_matching_loses_no_likeness(spark):
    rng = random.Random(3)
    syllables = ("iso", "organ", "ization", "course", "pro", "fessor", "of", "x")
    a, b = ({"".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(25)} | set(extra) for extra in (("isorganization", "ab"), ("organization", "ac")))
    rest = [(X.isub_score(x, y), x, y) for x in a for y in b]
    rest = sorted((round(s, 9), x, y) for s, x, y in rest if round(s, 9) >= 0.5)[::-1]
    one_col = lambda names: spark.createDataFrame([(n,) for n in sorted(names)], "n string").coalesce(1)
    got = O.match_names(one_col(a), one_col(b), 0.5).collect()
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got)
    assert sorted(r.likeness for r in got)[-1] == rest[0][0]
    left = {r.a for r in got}, {r.b for r in got}
    assert all(x in left[0] or y in left[1] for _, x, y in rest)  # nothing above the threshold is left unmatched
    names = O.match_names(one_col({"isorganization"}), one_col({"organization"}), 0.5).collect()
    assert [(r.a, r.b) for r in names] == [("isorganization", "organization")]


def test_scorers(spark):
    w = {"and": [(np.eye(4)[:, :2], np.zeros(2))], "or": [(np.eye(4)[:, :2], np.zeros(2))], "not": [(-np.eye(2), np.zeros(2))]}
    net = scorers.LogicNet(np.array([[0, 0], [1, 0], [0, 1]], float), np.array([1.0, 0.0]), w)
    df = spark.createDataFrame([([[1, 2]],), ([[-1]],)], "d array<array<int>>")
    got = [r.s for r in df.select(net.column(F.col("d")).alias("s")).collect()]
    assert got[0] == pytest.approx(1 / (1 + math.exp(-10))) and got[1] == pytest.approx(1 / (1 + math.exp(10)))
    gru = scorers.Recurrent(np.ones((3, 2)), np.ones((2, 6)) * 0.1, np.ones((2, 6)) * 0.1, np.zeros(6))
    h = spark.createDataFrame([([1, 2], 0), ([], 1)], "h array<int>, i int")
    a, b = (r.s for r in h.select(gru.column(F.col("h"), F.col("i")).alias("s")).collect())
    assert a > 0 and b == 0
    users = spark.createDataFrame([(1, [1.0, 2.0], 0.5)], "uid int, factors array<double>, bias double")
    items = spark.createDataFrame([(7, [3.0, 1.0], 0.1)], "iid int, factors array<double>, bias double")
    pairs = spark.createDataFrame([(1, 7), (2, 7)], "uid int, iid int")
    assert {r.uid: r.score for r in scorers.biased_mf(pairs, users, items, 1.0).collect()} == {1: 6.6, 2: 1.1}
    moved = scorers.svdpp(pairs, users, items, pairs.limit(1), spark.createDataFrame([(7, [1.0, 0.0])], "iid int, vector array<double>"))
    assert {r.uid: r.score for r in moved.collect()}[1] == pytest.approx(8.6)


def test_entity_counts_and_histogram(spark):
    rows = [("f", "Class1", True), ("f", "Class2", True), ("f", "prop", False), ("f", "Class1", False)]
    df = spark.createDataFrame(rows, "file string, tag string, identified boolean")
    assert tuple(one(T.entity_counts(df)))[1:] == (2, 1, 3)
    assert tuple(one(T.entity_counts(df, df.select("tag").filter("tag != 'prop'"))))[1:] == (2, 0, 2)
    assert [r.n for r in T.dense_histogram(spark.createDataFrame([(0,), (3,), (3,)], "v int"), "v").orderBy("value").collect()] == [1, 0, 0, 2]


def test_hash_embedding_has_unit_length(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "k int, token string")
    source = spark.createDataFrame([(1, "x"), (2, "y")], "k int, raw string")
    got = T.hash_embedding(t, "k", 8, fallback=F.col("raw"), source=source).groupBy("k").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert {r.k: round(r.n, 9) for r in got} == {1: 1.0, 2: 1.0}
