"""Sessions, names, samples, blocks and scorers."""

import math
import os
import random
import subprocess
import sys
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from truthframe import session
from truthframe.functions import bounds as B
from truthframe.functions import text as X
from truthframe.operators import interactions, metrics, patterns, sampling, scorers
from truthframe.operators import ontology as O
from truthframe.operators import triples as T

ALONE = """
import os, sys
sys.path.insert(0, {root!r})
from truthframe.session import get_spark
from truthframe.operators import ontology as O
from pyspark.sql import SparkSession
SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark = get_spark("alone", "local[2]", 2)
names = spark.createDataFrame([("FullProfessor",), ("Course",)], "n string")
print(sorted(r.b for r in O.match_names(names, names, 0.9).collect()))
blocks = O.agglomerate(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "src long, dst long"), 5)
print(len({{r.block for r in blocks.collect()}}), len(os.listdir({shared!r})) > 0)
"""


def test_operators_find_the_package_and_clean_up(tmp_path):
    """Plain frames, the package on no worker's path, and nothing left in the shared folder at the end."""
    shared = tmp_path / "shared"
    shared.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(session.__file__)))
    out = subprocess.run([sys.executable, "-c", ALONE.format(root=root, shared=str(shared))], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.split("\n")[:2] == ["['Course', 'FullProfessor']", "2 True"], out.stderr[-2000:]
    assert not [p for p in shared.rglob("*") if p.is_file()]


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="x", master="spark://host:7077")))


def test_settle_writes_what_is_large(spark):
    df = spark.range(50)
    small, head = session.settle(df, small=50)
    large, none = session.settle(df, small=49)
    assert head.num_rows == 50 and none is None and small.count() == large.count() == 50
    assert session.local_frame(spark, [], "a int, b string").count() == 0


def test_string_similarity():
    assert X.isub_score("has_part", "haspart") == pytest.approx(1.0)
    assert X.isub_score("Professor", "professor") == 1.0
    assert X.isub_score("._", "._ ") == math.exp(-1 / 4) and X.isub_score("...", "___") == 0.0 and X.isub_score("...", "abc") == 1.0
    assert X.isub_score("ab", "ab") == 1.0 and X.isub_score("", "") == 1.0 and X.isub_score("ab", "cd") == pytest.approx(math.exp(-1))
    # six of ten characters in common, the first four of them at the start
    assert X.isub_score("abcdefgh", "abcdefxy") == pytest.approx(0.75 - 0.0625 / (0.6 + 0.4 * 0.4375) + 0.4 * 0.25)
    assert X.isub_score("ABcdef", "abcdef") == 1.0 and X.isub_score("Xbcdef", "xbcdeg") < X.isub_score("xbcdef", "xbcdeg")


def test_term_tokens(spark):
    cases = {"http://x.org/a#hasHTTPServer": ["has", "httpserver"], "XMLParser": ["xmlparser"], "Graduate_Student-12.b": ["graduate", "student", "12", "b"], "ÉcoleÉlite": ["école", "élite"], "": []}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.term_tokens(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == cases


def test_precision_of_short_lists(spark):
    r = spark.createDataFrame([([1, 0, 1],), ([],)], "r array<int>").select(metrics.precision_at(F.col("r"), 5).alias("p")).collect()
    assert r[0].p == pytest.approx(2 / 3) and r[1].p == 0.0


@pytest.mark.parametrize("per_user", [1, 5, 24, 40])
def test_negatives_are_complete(spark, per_user):
    rng = random.Random(per_user)
    known = {(u, i) for u in range(8) for i in rng.sample(range(25), rng.randrange(25))} | {(9, i) for i in range(25)}
    df = spark.createDataFrame(sorted(known), "uid int, iid int")
    items = spark.createDataFrame([(i,) for i in range(25)], "iid int")
    users = spark.createDataFrame([(u,) for u in range(10)], "uid int")
    got = interactions.negatives(users, items, df, per_user).collect()
    assert not {(r.uid, r.iid) for r in got} & known and len(set(got)) == len(got)
    for u in range(10):
        assert sum(r.uid == u for r in got) == min(per_user, 25 - sum(k[0] == u for k in known))


def test_blocks_are_the_same_in_one_task_and_in_many(spark, monkeypatch):
    edges = spark.createDataFrame([(i, j) for i in range(-20, 20) for j in range(-20, 20) if (i * 7 + j * 3) % 11 == 0 and i < j], "src long, dst long")
    one = {(r.node, r.block) for r in O.agglomerate(edges, 9).collect()}
    monkeypatch.setattr(O, "COUPLED", 5)
    assert one == {(r.node, r.block) for r in O.agglomerate(edges, 9).collect()} and len(one) == 40
    assert O.agglomerate(edges.limit(0), 9).count() == 0


def test_samples_of_large_classes(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(500)], "id int, label string")
    got = sampling.balanced_sample(df, "id", "label", 20).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"a": 20, None: 20}
    batches = sampling.balanced_batches(df, "id", "label", 10).groupBy("label", "batch").count().collect()
    assert max(r["count"] for r in batches) == 5


def test_two_axioms_complete_a_pattern(spark):
    ax = spark.createDataFrame([("o", "only", "A", "r", "B", None), ("o", "sub", "A", None, "D", None)], "onto string, kind string, a string, prop string, b string, n string")
    (r,) = patterns.complete_two(ax, "UE").collect()
    assert (r.kind, r.a, r.prop, r.b, r.dis_a, r.dis_b) == ("some", "A", "r", "D", "B", "D")
    both = ax.union(spark.createDataFrame([("o", r.kind, r.a, r.prop, r.b, None), ("o", "dis", r.dis_a, None, r.dis_b, None)], ax.schema))
    assert patterns.detect(both, "UE").count() == 1 and patterns.complete_two(ax.limit(0), "EID").count() == 0


def test_embedding_is_the_same_however_tokens_repeat(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b")], "k int, token string")
    got = {(r.k, r.index): r.value for r in T.hash_embedding(t, "k", 7).collect()}
    assert sum(v * v for (k, _), v in got.items() if k == 1) == pytest.approx(1)


def test_regularisers_are_small_where_the_laws_hold():
    rng = np.random.default_rng(1)
    w = {n: [(rng.normal(size=(4 if n != "not" else 2, 2)), np.zeros(2))] for n in ("and", "or", "not")}
    net = scorers.LogicNet(np.zeros((3, 2)), np.array([1.0, 0.0]), w)
    v = rng.normal(size=(5, 2))
    got = net.regularisers(v)
    assert len(got) == 12 and all(np.isfinite(x) and x >= 0 for x in got.values()) and got["length"] == pytest.approx(np.linalg.norm(v, axis=1).sum())
    w["not"] = [(-np.eye(2), np.zeros(2))]  # the law of double negation holds
    assert scorers.LogicNet(np.zeros((3, 2)), np.array([1.0, 0.0]), w).regularisers(v)["not_not_self"] == pytest.approx(5 * (1 - 1 / (1 + math.exp(-10))))


def test_losses_and_truth_tables(spark):
    assert B.logical_loss([1.0, 1.0], 1.0) == pytest.approx(0.0, abs=1e-6) and B.logical_loss([0.5], 1.0) > 0.4
    assert B.truth_table(spark, "abcd").count() == 16


def test_models_that_spark_fits(spark):
    rows = [([float(i % 2), float(i % 3)], float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "x array<double>, y double")
    for kind in ("forest", "svm"):
        model = scorers.fit_classifier(df, "x", "y", kind)
        from pyspark.ml.functions import array_to_vector

        out = model.transform(df.withColumn("features__", array_to_vector("x")))
        assert out.filter("prediction = y").count() == 60
    words = spark.createDataFrame([(["a", "b", "c"] * 4,)] * 10, "w array<string>")
    assert scorers.fit_word_vectors(words, "w", 4, minCount=1).getVectors().count() == 3


def test_rendering_of_expressions(spark):
    c = lambda n: ["class", n]
    assert O.render(["and", c("A"), ["some", "r", ["or", c("B"), c("C")]]]) == "A and r some B or C"
    assert O.render(["min", 2, "r", ["not", c("A")]]) == "r min 2 not A" and O.render(["oneof", "i", "j"]) == "OneOf: i, j"
    assert O.render_axiom(["sub", c("A"), c("Thing")]) is None and O.render_axiom(["type", c("A"), "i"]) == "i Type A" and O.render_axiom(["fact", "p", "i", "j"]) == "i p j"
    assert [r[0] for r in spark.createDataFrame([('["eq",["class","A"],["class","B"]]',), (None,)], "a string").select(O.manchester("a")).collect()] == ["A EquivalentTo B", None]
