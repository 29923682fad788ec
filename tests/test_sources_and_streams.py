import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from truthframe.sources import tables as S
from truthframe.streaming import stages


def test_histories_and_info_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 1, 2), (1, 4, 1, 1), (2, 9, 0, 1)], "uid int, iid int, label int, time long")
    df.coalesce(1).write.csv(f"{tmp_path}/d.train.csv", sep="\t", header=True)
    splits = S.read_splits(spark, f"{tmp_path}/d")
    assert list(splits) == ["train"] and splits["train"].count() == 3
    assert {(r.label, r.n) for r in S.label_counts(splits).collect()} == {(1, 2), (0, 1)}
    S.write_history(df, f"{tmp_path}/his")
    assert [(r.uid, r.iids) for r in S.read_history(spark, f"{tmp_path}/his").collect()] == [(1, [4, 5])]
    assert S.write_column_info(f"{tmp_path}/info.json", df)["max"]["iid"] == 9
    assert (tmp_path / "info.json").read_text().count("\n") == 2


def test_ontology_csv_round_trip(spark, tmp_path):
    body = '[["a", "b", "it\'s\n(so), \\"x\\""]]'
    df = spark.createDataFrame([("f1", None, 3, body, None, "train"), ("f2", "Inconsistent", 4, "[]", "AIO", "test")], S.ONTOLOGY + ", split string")
    summary = S.write_splits(df, str(tmp_path))
    assert {(r.split, r.rows) for r in summary.collect()} == {("train", 1), ("test", 1)}
    back = S.read_ontologies(spark, f"{tmp_path}/train").first()
    assert back.body == body and back.consistency == "Consistent" and back.injected_pattern is None
    with pytest.raises(ValueError):
        S.require_columns(df, ["nope"])


RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:o="http://x#">
<o:Cat rdf:about="Tom"><o:eats rdf:resource="Jerry"/><o:name>Thomas</o:name><o:has><o:Tail/></o:has></o:Cat></rdf:RDF>"""


def test_rdf_lines_and_triples(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.owl").write_text(RDF)
    (tmp_path / "in/b.owl").write_text("<broken")
    rows = S.read_rdf_xml(spark, f"{tmp_path}/in")
    got = {(r.s, r.p, r.o) for r in rows.filter("file_name = 'a.owl'").collect()}
    assert {("Tom", "type", "http://x#Cat"), ("Tom", "http://x#eats", "Jerry"), ("Tom", "http://x#name", "Thomas"), ("Tom", "http://x#has", "_:b1")} <= got
    assert rows.filter("file_name = 'b.owl' and s is null").count() == 1
    S.write_triples(rows.filter("s is not null"), f"{tmp_path}/json")
    assert {(r.s, r.p, r.o) for r in S.read_triples(spark, f"{tmp_path}/json").collect()} == got
    (tmp_path / "t.txt").write_text("one\ntwo\r\nthree")
    assert [(r.line_no, r.line) for r in S.read_lines(spark, f"{tmp_path}/t.txt").orderBy("line_no").collect()] == [(0, "one"), (1, "two"), (2, "three")]


def test_upserts_manifest_and_embeddings(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert {tuple(r) for r in S.upsert(t, new, ["k"]).collect()} == {("a", 1), ("b", 9), ("c", 3)}
    assert {tuple(r) for r in S.upsert(t, new, ["k"], replace=False).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert [r[0] for r in S.manifest(t.withColumnRenamed("k", "file_name"), new.withColumnRenamed("k", "file_name")).collect()] == ["a"]
    rows = spark.createDataFrame([("x.owl",), ("EID_y.owl",), ("z.owl",)], "file_name string")
    v = spark.createDataFrame([("x", [1.0]), ("y", [2.0])], "stem string, embedding array<double>")
    assert {(r.file_name, r.embedding[0]) for r in S.join_embeddings(rows, v).collect()} == {("x.owl", 1.0), ("EID_y.owl", 2.0)}


def test_stages_chain_and_go_on(spark, tmp_path):
    schema = "file_name string, n int"
    put = lambda rows, k: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([("a", 1), ("b", 2), ("a", 1)], 0)
    run = lambda: [
        stages.stage(stages.files(spark, f"{tmp_path}/in", schema), lambda df: df.withColumn("n", F.col("n") * 10), f"{tmp_path}/one", f"{tmp_path}/c1").awaitTermination(),
        stages.stage(stages.files(spark, f"{tmp_path}/one", schema), lambda df: df.withColumn("n", F.col("n") + 1), f"{tmp_path}/two", f"{tmp_path}/c2").awaitTermination(),
        stages.keep_latest(stages.files(spark, f"{tmp_path}/two", schema), f"{tmp_path}/kept", f"{tmp_path}/c3", ["file_name"], ["n"]).awaitTermination(),
    ]
    run()
    put([("b", 2), ("c", 3)], 1)
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/two").collect()) == [("a", 11), ("b", 21), ("c", 31)]
    assert sorted(tuple(r) for r in stages.current(spark, f"{tmp_path}/kept").collect()) == [("a", 11), ("b", 21), ("c", 31)]


def test_entry_and_registry(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 100 and set(o) <= set(q)
    assert entry.entry(spark).columns == ["c_mktsegment", "c_nationkey", "truth"]
