"""Status, sources and streaming queries over the events and pipeline tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from truthframe.operators import scorers
from truthframe.plans.registry import query
from truthframe.session import table, written_path
from truthframe.sources import tables as S
from truthframe.streaming import stages


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def status_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return S.latest(e, ["user_id"], ["ts", "event_id"])


@query("""
WITH r AS (SELECT * FROM pipeline_status WHERE file_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY status_id ORDER BY loaded_at DESC) = 1)
SELECT stage, file_name, status_id, status_ts FROM r QUALIFY row_number() OVER (PARTITION BY stage, file_name ORDER BY status_ts DESC, status_id DESC) = 1
""")
def pipeline_latest(spark, d):
    """The latest status of every file in every stage, rows delivered twice counted once."""
    rows = table(spark, d, "pipeline_status").filter("file_name is not null").select("status_id", "stage", "file_name", "status_ts", "loaded_at")
    once = S.latest(rows, ["status_id"], ["loaded_at"]).select("stage", "file_name", "status_id", "status_ts")
    return S.latest(once, ["stage", "file_name"], ["status_ts", "status_id"])


@query("SELECT stage, upper(trim(status)) AS status, count(DISTINCT status_id) AS n, max(tokens) AS most_tokens FROM pipeline_status GROUP BY ALL")
def pipeline_counts(spark, d):
    rows = table(spark, d, "pipeline_status").select("stage", F.upper(F.trim("status")).alias("status"), "status_id", "tokens")
    return rows.groupBy("stage", "status").agg(F.countDistinct("status_id").alias("n"), F.max("tokens").alias("most_tokens"))


@query("SELECT DISTINCT file_name FROM train_data WHERE file_name IS NOT NULL AND file_name NOT IN (SELECT file_name FROM predictions WHERE file_name IS NOT NULL)")
def manifest(spark, d):
    return S.manifest(table(spark, d, "train_data"), table(spark, d, "predictions"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 3 = 0
""")
def upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    fresh = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("segment"))
    return S.upsert(c, fresh.union(fresh.select(F.col("c_custkey") + 1000000, "segment")), ["c_custkey"])


@query("SELECT split, consistency, count(*) AS rows, max(tokenized_length) AS most_tokens FROM (SELECT 'train' AS split, consistency, tokenized_length FROM train_data UNION ALL SELECT 'eval', consistency, tokenized_length FROM eval_data UNION ALL SELECT 'test', consistency, tokenized_length FROM test_data) GROUP BY ALL")
def split_summary(spark, d):
    parts = [table(spark, d, f"{n}_data").select(F.lit(n).alias("split"), "consistency", "tokenized_length") for n in ("train", "eval", "test")]
    return S.split_summary(parts[0].union(parts[1]).union(parts[2]))


_EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def stream_status(spark, d):
    """The same by a stream that keeps the latest row of each user, merged batch by batch."""
    source = spark.readStream.schema(_EVENT).parquet(f"{d}/events.parquet*").select("user_id", "event_type", "ts")
    out = written_path(spark, "status")
    stages.keep_latest(source, f"{out}/table", f"{out}/checkpoint", ["user_id"], ["ts"]).awaitTermination()
    return stages.current(spark, f"{out}/table")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    source = spark.readStream.schema(_EVENT).parquet(f"{d}/events.parquet*")
    day = stages.windowed(source, "ts", "1 day", None, ["event_type"], "value", "1 hour")
    path = written_path(spark, "windows")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/b{number}")

    # complete mode: every batch holds all windows, the last is the answer
    q = day.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return spark.read.parquet(f"{path}/b{last}").withColumn("total", F.round("total", 4))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k
""")
def sessions(spark, d):
    return stages.sessions(table(spark, d, "events"), "ts", "6 hours", "user_id")


@query("""
SELECT l_orderkey, l_linenumber, round(0.1 + l_suppkey % 7 / 7.0 * (l_partkey % 5 / 5.0) + l_suppkey % 3 / 10.0 + l_partkey % 4 / 10.0, 6) AS score FROM lineitem
""")
def mf_score(spark, d):
    users = table(spark, d, "supplier").select(F.col("s_suppkey").alias("uid"), F.array(F.col("s_suppkey") % 7 / 7).alias("factors"), (F.col("s_suppkey") % 3 / 10).alias("bias"))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("iid"), F.array(F.col("p_partkey") % 5 / 5).alias("factors"), (F.col("p_partkey") % 4 / 10).alias("bias"))
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("uid"), F.col("l_partkey").alias("iid"))
    return scorers.biased_mf(pairs, users, items, 0.1).select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))
