import itertools

import pytest
from pyspark.sql import functions as F

from truthframe.functions import bounds as B
from truthframe.operators.formula import And, Congruent, Exists, Forall, Iff, Implies, Not, Or, Predicate, Predicates, Proposition, Theory, XOr, variables
from truthframe.operators.relation import Const, Relation, dual_key_join

T, U_ = "TRUE", "UNKNOWN"


def states(theory, f):
    r = theory.relation(f)
    return {tuple(x[k] for k in r.keys): x.state for x in r.states().collect()}


def test_grounding_join_two_by_two(spark):
    x, y, z = variables("x", "y", "z")
    p, q = Predicate("p", 2), Predicate("q", 2)
    f = And(p(x, y), q(y, z))
    t = Theory(spark, f)
    t.add_data({p: {("x1", "y1"): True, ("x2", "y2"): True}, q: {("y1", "z1"): True, ("y3", "z2"): True}})
    t.upward(f)
    got = states(t, f)
    assert len(got) == 7 and [g for g, s in got.items() if s == "T"] == [("x1", "y1", "z1")] and set(got.values()) == {"T", "U"}


def test_grounding_join_three_by_two(spark):
    x, y, z = variables("x", "y", "z")
    p, q = Predicate("p", 3), Predicate("q", 2)
    f = And(p(x, y, z), q(y, z))
    t = Theory(spark, f)
    t.add_data({p: {("x1", "y1", "z1"): True, ("x3", "y3", "z3"): True}, q: {("y1", "z1"): True, ("y2", "z2"): True}})
    t.upward(f)
    got = states(t, f)
    assert len(got) == 5 and [g for g, s in got.items() if s == "T"] == [("x1", "y1", "z1")]


def test_empty_side_keeps_complete_rows(spark):
    a = spark.createDataFrame([("1", "2")], "x string, y string")
    b = spark.createDataFrame([], "y string")
    assert [tuple(r) for r in dual_key_join(a, b).collect()] == [("1", "2")]
    assert dual_key_join(a.select("x"), b).count() == 0


def test_constants_are_bound_and_put_back(spark):
    x, y = variables("x", "y")
    p, q = Predicate("p", 2), Predicate("q")
    f = And(p(x, y), q("a"))
    t = Theory(spark, f)
    t.add_data({p: {("1", "2"): True}, q: {"a": True, "b": False}})
    t.upward(f)
    assert states(t, f) == {("1", "2"): "T"}
    r = Relation.from_facts(spark, ["g0", "g1"], {("a", "a"): True, ("a", "b"): True})
    assert r.bind([x, x]).count() == 1 and r.bind([Const("a"), y]).columns == ["y", "l", "u"]


def test_square_chain_in_three_passes(spark):
    (x,) = variables("x")
    square, rectangle, foursides = Predicates("square", "rectangle", "foursides")
    t = Theory(spark)
    t.add(Implies(square(x), rectangle(x)), Implies(rectangle(x), foursides(x)), world="AXIOM")
    t.add_data({square: {"c": True, "k": True}})
    steps, _ = t.infer()
    assert steps == 3
    assert states(t, foursides(x)) == {("c",): "T", ("k",): "T"}


def test_who_is_a_criminal(spark):
    x, y, z, w = variables("x", "y", "z", "w")
    owns, missile, american, enemy, criminal, hostile, weapon = Predicate("owns", 2), Predicate("missile"), Predicate("american"), Predicate("enemy", 2), Predicate("criminal"), Predicate("hostile"), Predicate("weapon")
    sells = Predicate("sells", 3)
    t = Theory(spark, natural=True)
    t.add(
        Implies(And(american(x), weapon(y), sells(x, y, z), hostile(z)), criminal(x)),
        Implies(And(missile(x), owns("nono", x)), sells("west", x, "nono")),
        Implies(missile(x), weapon(x)),
        Implies(enemy(x, "america"), hostile(x)),
        world="AXIOM",
    )
    t.add_data({owns: {("nono", "m1"): True}, missile: {"m1": True}, american: {"west": True}, enemy: {("nono", "america"): True}})
    t.infer(max_steps=4)
    assert states(t, criminal(w)) == {("west",): "T"}
    q = Exists(x, criminal(x))
    t.set_query(q)
    t.upward(q)
    assert states(t, q) == {(): "T"} and not t.has_contradiction()


def test_duplicate_rows_prove_the_tightest(spark):
    x, y = variables("x", "y")
    p, q = Predicate("p", 2), Predicate("q")
    f = And(p(x, y), q(y))
    t = Theory(spark, f)
    rows = spark.createDataFrame([("x1", "y1", 0.3, 1.0), ("x2", "y1", 0.7, 0.9)], "g0 string, g1 string, l double, u double")
    t.add_data({p: rows})
    t.relations[f.key()] = t.relations[f.key()].add_data(rows.toDF("x", "y", "l", "u"))
    t.downward(f)
    (got,) = t.relation(q).df.collect()
    assert got.g0 == "y1" and got.l == pytest.approx(0.8) and got.u == 1.0


def grid(spark):
    v = [i / 20 for i in range(21)]
    return spark.createDataFrame([(a, b) for a in v for b in v], "a double, b double")


def test_connectives_on_a_grid(spark):
    a, b = (F.col("a"), F.col("a")), (F.col("b"), F.col("b"))
    rows = grid(spark).select(
        "a", "b", *(x[0].alias(n) for n, x in {"and_": B.and_up([a, b]), "or_": B.or_up([a, b]), "imp": B.implies_up(a, b), "iff": B.iff_up(a, b), "xor": B.xor_up([a, b]), "nand": B.not_(B.and_up([a, b])), "dm": B.or_up([B.not_(a), B.not_(b)])}.items())
    )
    for r in rows.collect():
        x, y = r.a, r.b
        assert r.and_ == pytest.approx(max(0, x + y - 1)) and r.or_ == pytest.approx(min(1, x + y)) and r.imp == pytest.approx(min(1, 1 - x + y))
        assert r.iff == pytest.approx(1 - abs(x - y)) and r.nand == pytest.approx(r.dm)
        assert r.xor == pytest.approx(max(0, min(1, x + y) - max(0, x + y - 1)), abs=1e-9)


def test_modus_ponens_tollens_and_syllogism(spark):
    a, b = Proposition("a"), Proposition("b")
    for fact, value, other, want in ((a, True, b, "T"), (b, False, a, "F")):
        t = Theory(spark)
        t.add(Implies(a, b), world="AXIOM")
        t.add_data({fact: value})
        t.infer(max_steps=3)
        assert t.relation(other).states().first().state == want
    t = Theory(spark)
    t.add(Or(a, b), world="AXIOM")
    t.add_data({a: False})
    t.infer(max_steps=3)
    assert t.relation(b).states().first().state == "T"


def test_truth_tables(spark):
    a, b, c = Proposition("a"), Proposition("b"), Proposition("c")
    checks = [(And(a, b, c), lambda *v: all(v)), (XOr(a, b, c), lambda *v: sum(v) == 1), (Iff(a, Not(b)), lambda x, y, _: x != y)]
    x = [(F.col(n), F.col(n)) for n in "abc"]
    rows = spark.createDataFrame(list(itertools.product([0.0, 1.0], repeat=3)), "a double, b double, c double")
    got = rows.select("*", B.and_up(x)[0].alias("x0"), B.xor_up(x)[0].alias("x1"), B.iff_up(x[0], B.not_(x[1]))[0].alias("x2")).collect()
    for r in got:
        for i, (_, truth) in enumerate(checks):
            assert (r[f"x{i}"] == 1) == truth(bool(r.a), bool(r.b), bool(r.c))
    t = Theory(spark, checks[1][0])
    t.add_data({a: True, b: False, c: False})
    t.infer("up")
    assert t.relation(checks[1][0]).states().first().state == "T"


def test_quantifiers(spark):
    x, y = variables("x", "y")
    p = Predicate("p", 2)
    some, every = Exists(x, p(x, y)), Forall(x, p(x, y))
    t = Theory(spark, some, every, Forall(y, Exists(x, p(x, y))))
    t.add_data({p: {("1", "a"): True, ("2", "a"): False, ("1", "b"): (0.2, 0.4), ("2", "b"): (0.3, 1.0)}})
    t.infer("up")
    assert {r.y: (r.l, r.u) for r in t.relation(some).df.collect()} == {"a": (1.0, 1.0), "b": (0.5, 1.0)}
    assert {r.y: (r.l, round(r.u, 6)) for r in t.relation(every).df.collect()} == {"a": (0.0, 0.0), "b": (0.0, 0.4)}
    assert [r.y for r in t.relation(some).true_groundings().collect()] == ["a"]
    t = Theory(spark)
    f = Forall(x, p(x, y))
    t.add(f, world="AXIOM")
    t.add_data({p: {("1", "a"): U_, ("2", "a"): U_}})
    t.infer("down")
    assert {r.state for r in t.relation(p).states().collect()} == {"T"}


def test_congruent_and_contradiction(spark):
    a, b = Proposition("a"), Proposition("b")
    f = Congruent(a, b)
    t = Theory(spark, f)
    t.add_data({a: True, b: False})
    t.infer("up")
    assert t.relation(f).states().first().state == "C" and t.has_contradiction()


def test_states(spark):
    cases = {(0.0, 1.0): "U", (0.0, 0.0): "F", (1.0, 1.0): "T", (0.5, 0.5): "=U", (0.1, 0.4): "~F", (0.0, 0.4): "~F", (0.6, 0.9): "~T", (0.6, 1.0): "~T", (0.2, 0.8): "~U", (0.9, 0.2): "C", (1.0, 0.0): "C"}
    df = spark.createDataFrame(list(cases), "l double, u double")
    assert {(r.l, r.u): r.s for r in df.select("*", B.state((F.col("l"), F.col("u"))).alias("s")).collect()} == cases


def test_relation_data(spark):
    r = Relation.from_facts(spark, ["k"], {"a": T, "b": U_}).add_data(spark.createDataFrame([("b", 0.2, 0.9), ("b", 0.3, 1.0), ("c", 1.0, 1.0)], "k string, l double, u double"))
    assert {x.k: (x.l, x.u) for x in r.df.collect()} == {"a": (1, 1), "b": (0.3, 0.9), "c": (1, 1)}
    tight = r.tighten(spark.createDataFrame([("b", 0.5, 1.0), ("d", 0.1, 0.2)], "k string, l double, u double"), "lower")
    assert {x.k: (x.l, x.u) for x in tight.df.collect()}["d"] == (0.1, 1.0)
    assert tight.reset().df.count() == 3 and tight.flush().states().filter("state = 'U'").count() == 4
    asked = r.in_world("CLOSED").get(spark.createDataFrame([("z",), ("a",)], "k string"))
    assert {x.k: (x.l, x.u) for x in asked.collect()} == {"z": (0, 0), "a": (1, 1)}


def test_downward_never_loosens(spark):
    rows = grid(spark).withColumns({"wl": F.col("a") * 0.5, "wu": F.least(F.col("a") + 0.2, F.lit(1.0))})
    xs = [(F.col("a") * 0.3, F.col("a")), (F.col("b") * 0.5, F.col("b"))]
    down = B.and_down((F.col("wl"), F.col("wu")), xs)
    tight = [B.tighten(x, d) for x, d in zip(xs, down)]
    loose = rows.select(*(c.alias(f"c{i}") for i, c in enumerate([tight[0][0] - xs[0][0], xs[0][1] - tight[0][1], tight[1][0] - xs[1][0], xs[1][1] - tight[1][1]])))
    assert loose.filter("least(c0, c1, c2, c3) < -1e-12").count() == 0
