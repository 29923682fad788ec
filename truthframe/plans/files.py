"""Files, streams and scorers: what is written comes back, and streams say what tables say."""

from __future__ import annotations

from pyspark.sql import functions as F

from truthframe.operators import scorers
from truthframe.plans.registry import query
from truthframe.plans.streams import _EVENT
from truthframe.session import table, written_path
from truthframe.sources import tables as S
from truthframe.streaming import stages

_LABELLED = "(SELECT event_id, user_id AS uid, event_id * 7 % 60 AS iid, CASE WHEN value > 60 THEN 1 ELSE 0 END AS label, event_id AS time FROM events)"


def _labelled(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("int").alias("uid"), (F.col("event_id") * 7 % 60).cast("int").alias("iid"), F.when(F.col("value") > 60, 1).otherwise(0).alias("label"), F.col("event_id").alias("time"))


@query("""
SELECT split, nullif(file_name, '') AS file_name, coalesce(nullif(consistency, ''), 'Consistent') AS consistency, tokenized_length, md5(nullif(body, '')) AS body_md5, nullif(injected_pattern, '') AS injected_pattern FROM (
  SELECT 'train' AS split, * FROM train_data UNION ALL SELECT 'eval', * FROM eval_data UNION ALL SELECT 'test', * FROM test_data)
""")
def ontology_files(spark, d):
    """All rows of the three splits, written as CSV files and read again."""
    rows = None
    for n in ("train", "eval", "test"):
        one = table(spark, d, f"{n}_data").select(F.lit(n).alias("split"), "file_name", "consistency", "tokenized_length", "body", "injected_pattern")
        rows = one if rows is None else rows.union(one)
    base = written_path(spark, "csv")
    S.write_splits(rows, base)
    out = None
    for n in ("train", "eval", "test"):
        one = S.read_ontologies(spark, f"{base}/{n}").select(F.lit(n).alias("split"), "file_name", "consistency", "tokenized_length", F.md5("body").alias("body_md5"), "injected_pattern")
        out = one if out is None else out.union(one)
    return out


@query(f"SELECT uid, string_agg(iid, ',' ORDER BY time) AS iids FROM {_LABELLED} WHERE label > 0 GROUP BY uid")
def history_files(spark, d):
    path = written_path(spark, "history")
    S.write_history(_labelled(spark, d), path)
    return S.read_history(spark, path).select("uid", F.array_join(F.transform("iids", lambda x: x.cast("string")), ",").alias("iids"))


@query(f"SELECT split, label, count(*) AS n FROM (SELECT CASE WHEN time % 5 = 0 THEN 'test' WHEN time % 5 = 1 THEN 'validation' ELSE 'train' END AS split, label FROM {_LABELLED}) GROUP BY ALL")
def split_files(spark, d):
    """Tab-separated splits read in their declared schema, with the labels of each."""
    base = written_path(spark, "splits")
    at = F.col("time") % 5
    for name, part in (("test", at == 0), ("validation", at == 1), ("train", at > 1)):
        _labelled(spark, d).filter(part).write.csv(f"{base}.{name}.csv", sep="\t", header=True)
    return S.label_counts(S.read_splits(spark, base))


@query("SELECT user_id::VARCHAR AS file_name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_type AS s, 'of' AS p, props AS o FROM events")
def triple_files(spark, d):
    path = written_path(spark, "triples")
    e = table(spark, d, "events")
    S.write_triples(e.select(F.col("user_id").cast("string").alias("file_name"), F.col("event_id").alias("pos"), F.col("event_type").alias("s"), F.lit("of").alias("p"), F.col("props").alias("o")), path)
    return S.read_triples(spark, path)


@query("SELECT 'part ' || p_partkey AS first, p_name || ' of ' || p_type AS second FROM part")
def line_files(spark, d):
    """Text files whose lines keep their order: each line and the one after it."""
    path = written_path(spark, "lines")
    table(spark, d, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string"), F.lit("\n"), "p_name", F.lit(" of "), "p_type").alias("value")).repartition(5).write.text(path)
    lines = S.read_lines(spark, f"{path}/*.txt")
    after = lines.select("file_name", (F.col("line_no") - 1).alias("line_no"), F.col("line").alias("second"))
    return lines.filter("line like 'part %'").join(after, ["file_name", "line_no"]).select(F.col("line").alias("first"), "second")


@query("SELECT vec_id::VARCHAR AS stem, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def embedding_sink(spark, d):
    """Vectors stored in two goes that overlap: none is stored twice."""
    path = written_path(spark, "vectors")
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("stem"), "embedding", "vec_id")
    S.write_embeddings(e.filter("vec_id % 3 < 2").drop("vec_id"), path)
    out = S.write_embeddings(e.filter("vec_id % 3 > 0").drop("vec_id"), path)
    return out.select("stem", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("""
WITH f AS (SELECT row_id, regexp_replace(file_name, '\\.[^./]*$', '') AS stem FROM train_data WHERE file_name IS NOT NULL), v AS (SELECT DISTINCT stem FROM f WHERE length(stem) % 2 = 0)
SELECT row_id FROM f WHERE stem IN (SELECT stem FROM v) OR regexp_replace(stem, '^[^_]*_', '') IN (SELECT stem FROM v)
""")
def embedding_join(spark, d):
    """Rows that have a vector under their name or under what follows its first part."""
    rows = table(spark, d, "train_data").select("row_id", "file_name")
    stem = F.regexp_replace("file_name", r"\.[^./]*$", "")
    v = rows.select(stem.alias("stem")).filter("length(stem) % 2 = 0").distinct().withColumn("embedding", F.array(F.lit(1.0)))
    return S.join_embeddings(rows, v).select("row_id")


@query("SELECT DISTINCT user_id * 3 AS user_id FROM events")
def stream_stage(spark, d):
    """Each key once through a stage of a pipeline; keys are remembered for as long as a week."""
    source = spark.readStream.schema(_EVENT).parquet(f"{d}/events.parquet*").select("user_id", "ts")
    out = written_path(spark, "stage")
    stages.stage(source, lambda df: df.select((F.col("user_id") * 3).alias("user_id")), f"{out}/rows", f"{out}/checkpoint", "user_id", time="ts", late="3650 days").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts, count(*) AS rows FROM events GROUP BY user_id")
def stream_running(spark, d):
    """The latest value of each key as a stateful aggregation."""
    source = spark.readStream.schema(_EVENT).parquet(f"{d}/events.parquet*")
    path = written_path(spark, "running")
    q = stages.running_state(source, ["user_id"], "ts", "event_type").writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/b{n}"))
    q = q.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/b{q.lastProgress['batchId'] if q.lastProgress else 0}")


@query("""
WITH m AS (SELECT o_custkey AS uid, avg(o_orderkey % 7 / 7.0) AS m FROM orders GROUP BY 1)
SELECT c_custkey AS uid, p_partkey AS iid, round(0.2 + (c_custkey % 5 / 5.0 + coalesce(m, 0)) * (p_partkey % 3 / 3.0) + c_custkey % 4 / 10.0, 6) AS score FROM customer JOIN part ON p_partkey % 200 = c_custkey % 200 LEFT JOIN m ON m.uid = c_custkey
""")
def svdpp_score(spark, d):
    """A customer's factors moved by the mean of the vectors of what was ordered."""
    u, i, o = F.col("c_custkey"), F.col("p_partkey"), F.col("o_orderkey")
    users = table(spark, d, "customer").select(u.alias("uid"), F.array(u % 5 / 5).alias("factors"), (u % 4 / 10).alias("bias"))
    items = table(spark, d, "part").select(i.alias("iid"), F.array(i % 3 / 3).alias("factors"), F.lit(0.0).alias("bias"))
    orders = table(spark, d, "orders")
    pairs = users.select("uid").join(items.select("iid"), F.col("iid") % 200 == F.col("uid") % 200)
    out = scorers.svdpp(pairs, users, items, orders.select(F.col("o_custkey").alias("uid"), o.alias("iid")), orders.select(o.alias("iid"), F.array(o % 7 / 7).alias("vector")), 0.2)
    return out.select("uid", "iid", F.round("score", 6).alias("score"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-((2 * l_discount + l_tax) / 3 * 0.5 - l_quantity / 50))), 6) AS score FROM lineitem
""")
def attention_score(spark, d):
    """Two vectors of a history, the first of double weight, against an item's vector."""
    l = table(spark, d, "lineitem")
    vector = lambda *xs: F.array(*(x.cast("double") for x in xs))
    history = F.array(vector(F.col("l_discount"), F.col("l_quantity")), vector(F.col("l_tax"), F.col("l_quantity")))
    score = scorers.attention_score(history, F.array(F.lit(2.0), F.lit(1.0)), vector(F.lit(0.5), F.lit(-0.02)))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.round(score, 6).alias("score"))
