"""Interaction histories, splits, negatives and metrics over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from truthframe.operators import interactions as I
from truthframe.operators import metrics as M
from truthframe.operators import sampling as S
from truthframe.plans.registry import query
from truthframe.session import table

_EVENTS = "(SELECT event_id, user_id AS uid, event_id * 7 % 60 AS iid, CASE WHEN value > 60 THEN 1 ELSE 0 END AS label, ts AS time FROM events)"


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("uid"), (F.col("event_id") * 7 % 60).alias("iid"), F.when(F.col("value") > 60, 1).otherwise(0).alias("label"), F.col("ts").alias("time"))


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"""
SELECT event_id, coalesce(array_to_string(list_slice(h, -5, -1), ','), '') AS history FROM (
  SELECT event_id, list(iid) FILTER (label > 0) OVER (PARTITION BY uid ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM {_EVENTS})
""")
def history_last_n(spark, d):
    return I.history(_events(spark, d), 5, order=("time", "event_id")).select("event_id", _text(F.col("history")).alias("history"))


@query(f"""
SELECT event_id, coalesce(array_to_string(list_slice(h, -4, -1), ','), '') AS history FROM (
  SELECT event_id, list(CASE WHEN label > 0 THEN iid ELSE -iid END) OVER (PARTITION BY uid ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM {_EVENTS})
""")
def history_signed(spark, d):
    return I.history(_events(spark, d), 4, "signed", ("time", "event_id")).select("event_id", _text(F.col("history")).alias("history"))


@query(f"""
SELECT e.event_id, coalesce(h.history, '') AS history FROM {_EVENTS} e
LEFT JOIN (SELECT uid, string_agg(iid, ',' ORDER BY time, event_id) AS history FROM {_EVENTS} WHERE label > 0 GROUP BY uid) h USING (uid)
""")
def history_full(spark, d):
    e = _events(spark, d)
    return I.full_history(e, e, ("time", "event_id")).select("event_id", _text(F.col("history")).alias("history"))


@query(f"SELECT uid, string_agg(iid, ',' ORDER BY time, event_id) AS iids FROM {_EVENTS} WHERE label > 0 GROUP BY uid")
def group_interactions(spark, d):
    return I.group_interactions(I.drop_negatives(_events(spark, d)), ("time", "event_id")).withColumn("iids", _text(F.col("iids")))


@query(f"""
SELECT event_id, CASE WHEN up > 5 AND down <= 2 THEN 'out' || down ELSE 'train' END AS split FROM (
  SELECT event_id, row_number() OVER (PARTITION BY uid ORDER BY time, event_id) AS up, row_number() OVER (PARTITION BY uid ORDER BY time DESC, event_id DESC) AS down
  FROM {_EVENTS} WHERE label > 0)
""")
def leave_one_out(spark, d):
    pos = I.drop_negatives(_events(spark, d))
    return I.leave_out_by_time(pos, 1, 5, 2, ("time", "event_id")).select("event_id", "split")


@query(f"""
WITH r AS (SELECT *, row_number() OVER w AS nth, sum(label) OVER w AS seen, sum(label) OVER (PARTITION BY uid) AS positives FROM {_EVENTS} WINDOW w AS (PARTITION BY uid ORDER BY time, event_id)),
m AS (SELECT uid, max(nth) AS mark FROM r WHERE label = 1 AND seen = least(5, positives) GROUP BY uid),
k AS (SELECT r.*, coalesce(nth <= mark + 1, false) AS warm FROM r LEFT JOIN m USING (uid)),
l AS (SELECT uid, nth, row_number() OVER (PARTITION BY uid ORDER BY nth DESC) AS back FROM k WHERE label = 1 AND NOT warm),
s AS (SELECT uid, max(nth) FILTER (back = 1) AS one, max(nth) FILTER (back = 2) AS two FROM l GROUP BY uid)
SELECT event_id, CASE WHEN NOT warm AND nth >= one THEN 'out1' WHEN NOT warm AND nth >= two THEN 'out2' ELSE 'train' END AS split FROM k LEFT JOIN s USING (uid)
""")
def leave_one_out_labels(spark, d):
    return I.leave_out_by_time(_events(spark, d), 1, 5, 2, ("time", "event_id"), positives_only=False).select("event_id", "split")


@query("SELECT event_id, user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return I.dedupe_first(e, ["user_id", "event_type"], ["ts", "event_id"])


@query(f"SELECT u.uid, i.iid FROM (SELECT DISTINCT uid FROM {_EVENTS}) u, (SELECT DISTINCT iid FROM {_EVENTS}) i EXCEPT SELECT uid, iid FROM {_EVENTS}")
def negatives_all(spark, d):
    e = _events(spark, d)
    return I.all_negatives(e, e, e)


@query()
def negatives_sampled(spark, d):
    e = _events(spark, d)
    return I.negatives(e, e, e, 3)


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type) AS type_id FROM events")
def dense_ids(spark, d):
    return I.dense_ids(table(spark, d, "events"), "event_type", "type_id").select("event_id", "type_id")


@query("""
SELECT 'l_quantity' AS "column", min(l_quantity)::DOUBLE AS lowest, max(l_quantity)::DOUBLE AS highest FROM lineitem
UNION ALL SELECT 'l_linenumber', min(l_linenumber), max(l_linenumber) FROM lineitem
""")
def column_ranges(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", "l_linenumber")
    return I.column_ranges(rows.filter("l_linenumber < 4"), rows.filter("l_linenumber >= 4"))


@query(f"SELECT event_id, c_mktsegment, p_brand FROM {_EVENTS} LEFT JOIN customer ON c_custkey = uid LEFT JOIN part ON p_partkey = iid")
def feature_join(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), "c_mktsegment")
    items = table(spark, d, "part").select(F.col("p_partkey").alias("iid"), "p_brand")
    return I.with_features(_events(spark, d), users, items).select("event_id", "c_mktsegment", "p_brand")


_SPLIT = """
SELECT doc_id, CASE WHEN r <= floor(n * 0.1 + 1e-9) THEN 'test' WHEN r <= floor(n * 0.1 + 1e-9) * 2 THEN 'validation' ELSE 'train' END AS split FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY {by} ORDER BY md5(doc_id || ':42'), doc_id) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM documents)
"""


@query(_SPLIT.format(by="lang"))
def strat_split(spark, d):
    return S.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", ["lang"], [("test", 0.1), ("validation", 0.1), ("train", 0.8)]).select("doc_id", "split")


@query(_SPLIT.format(by="1"))
def random_split(spark, d):
    return S.random_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1, 0.1).select("doc_id", "split")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) <= 20")
def balanced_sample(spark, d):
    return S.balanced_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 20)


@query("SELECT event_id, event_type, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || ':42'), event_id) - 1) / 20) AS INTEGER) AS batch FROM events")
def balanced_batches(spark, d):
    return S.balanced_batches(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type", 100)


@query("""
WITH o AS (SELECT e.event_id, e.event_type AS own, t.event_type AS x, md5(e.event_id || ':' || t.event_type || ':42') AS o FROM events e, (SELECT DISTINCT event_type FROM events) t),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY own = x DESC, o) AS r FROM o)
SELECT event_id, string_agg(x, ',' ORDER BY o) AS candidates FROM k WHERE r <= 3 GROUP BY event_id
""")
def candidate_labels(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return S.candidate_labels(e, e, "event_id", "event_type", 3).select("event_id", F.array_join("candidates", ",").alias("candidates"))


# scores: a line's quantity tells of its return


_SCORES = "(SELECT l_orderkey, l_linenumber, l_suppkey, (l_quantity * 2 + l_linenumber * 7 % 5) / 110 AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"


def _scores(spark, d):
    score = (F.col("l_quantity") * 2 + F.col("l_linenumber") * 7 % 5) / 110
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", score.alias("score"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))


@query(f"""
WITH c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM {_SCORES})
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced,
  round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c
""")
def confusion(spark, d):
    out = M.confusion(_scores(spark, d), "score", "label")
    return out.select("tp", "fp", "tn", "fn", *(F.round(c, 9).alias(c) for c in ("accuracy", "balanced", "precision", "recall", "f1")))


@query(f"""
WITH g AS (SELECT score, count(*) AS n, sum(label) AS p FROM {_SCORES} GROUP BY score),
c AS (SELECT *, coalesce(sum(n - p) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(p * (below + (n - p) / 2)) / (sum(p) * sum(n - p)), 9) AS auc FROM c
""")
def auc(spark, d):
    return M.auc(_scores(spark, d), "score", "label").select(F.round("auc", 9).alias("auc"))


@query(f"""
WITH s AS (SELECT DISTINCT score AS s FROM {_SCORES}), n AS (SELECT s, lag(s) OVER (ORDER BY s) AS prev FROM s),
t AS (SELECT 0.5 AS t UNION SELECT s FROM s UNION SELECT (s + prev) / 2 FROM n WHERE prev IS NOT NULL UNION SELECT greatest(min(s) - 1e-12, 0) FROM s UNION SELECT least(max(s) + 1e-12, 1) FROM s),
g AS (SELECT score, count(*) AS n, sum(label) AS p FROM {_SCORES} GROUP BY score),
c AS (SELECT t, sum(p) FILTER (score >= t) AS tp, sum(n - p) FILTER (score >= t) AS fp, sum(p) AS pos, sum(n) AS total FROM t, g GROUP BY t),
m AS (SELECT t, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, pos, total FROM c),
r AS (SELECT t, (tp / pos + (total - pos - fp) / (total - pos)) / 2 AS balanced, CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + pos) ELSE 0 END AS f1, (tp + total - pos - fp) / total AS accuracy FROM m)
SELECT round(t, 9) AS threshold, round(balanced, 9) AS balanced, round(f1, 9) AS f1, round(accuracy, 9) AS accuracy FROM r ORDER BY round(r.balanced, 12) DESC, t LIMIT 1
""")
def best_threshold(spark, d):
    return M.best_threshold(_scores(spark, d), "score", "label").select(*(F.round(c, 9).alias(c) for c in ("threshold", "balanced", "f1", "accuracy")))


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, label DESC, l_linenumber) AS rank,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY label DESC, l_linenumber) AS ideal FROM {_SCORES}),
g AS (SELECT l_orderkey, sum(CASE WHEN rank <= 3 THEN label / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 3 THEN label / log2(ideal + 1) ELSE 0 END) AS idcg,
  sum(CASE WHEN rank <= 3 THEN label ELSE 0 END) AS hits, sum(label) AS positives, count(*) AS n FROM r GROUP BY l_orderkey)
SELECT round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0 END), 6) AS hit,
  round(avg(hits / least(3, n)), 6) AS precision, round(avg(CASE WHEN positives > 0 THEN hits / positives ELSE 0 END), 6) AS recall FROM g
""")
def rank_metrics_at_k(spark, d):
    out = M.ranking_at_k(_scores(spark, d), "score", "label", 3, ["l_orderkey"], ["l_linenumber"])
    return out.select(*(F.round(c, 6).alias(c) for c in ("ndcg", "hit", "precision", "recall")))


@query(f"""
WITH r AS (SELECT l_orderkey, label, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, label) AS rank FROM {_SCORES}),
h AS (SELECT *, sum(label) OVER (PARTITION BY l_orderkey ORDER BY rank) AS hits FROM r)
SELECT round(avg(mrr), 6) AS mrr, round(avg(ap), 6) AS map, round(avg(rp), 6) AS r_precision FROM (
  SELECT l_orderkey, coalesce(1 / min(rank) FILTER (label = 1), 0) AS mrr, coalesce(avg(hits / rank) FILTER (label = 1), 0) AS ap, coalesce(sum(label) / max(rank) FILTER (label = 1), 0) AS rp FROM h GROUP BY l_orderkey)
""")
def rank_metrics_lists(spark, d):
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "l_linenumber", "label")))
    lists = _scores(spark, d).groupBy("l_orderkey").agg(F.transform(rows, lambda r: r["label"]).alias("r"))
    r = F.col("r")
    return lists.agg(F.round(F.avg(M.reciprocal_rank(r)), 6).alias("mrr"), F.round(F.avg(M.average_precision(r)), 6).alias("map"), F.round(F.avg(M.r_precision(r)), 6).alias("r_precision"))


@query(f"SELECT round(sqrt(avg(pow(score - label, 2))), 9) AS rmse, round(avg(abs(score - label)), 9) AS mae, round(avg(pow(score - label, 2)), 9) AS mse, round(avg(pow(ln(1 + score) - ln(1 + label), 2)), 9) AS msle FROM {_SCORES}")
def regression_errors(spark, d):
    out = M.regression_errors(_scores(spark, d), "score", "label")
    return out.select(*(F.round(c, 9).alias(c) for c in ("rmse", "mae", "mse", "msle")))


@query("""
WITH c AS (SELECT o_orderpriority AS p, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][1 + o_orderkey % 5] AS t, count(*) AS n FROM orders GROUP BY ALL),
a AS (SELECT p AS k, sum(n) FILTER (p = t) / sum(n) AS v FROM c GROUP BY p), b AS (SELECT t AS k, sum(n) FILTER (p = t) / sum(n) AS v FROM c GROUP BY t)
SELECT round(avg(coalesce(a.v, 0)), 9) AS precision, round(avg(coalesce(b.v, 0)), 9) AS recall FROM a FULL JOIN b ON a.k = b.k
""")
def macro_metrics(spark, d):
    names = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    o = table(spark, d, "orders").select("o_orderpriority", F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("t"))
    return M.macro_precision_recall(o, "o_orderpriority", "t").select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"""
SELECT label, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(min(score), 6) AS least, round(quantile_cont(score, 0.25), 6) AS q25,
  round(median(score), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q75, round(max(score), 6) AS most FROM {_SCORES} GROUP BY label
""")
def score_summary(spark, d):
    out = M.score_summary(_scores(spark, d), "score", ["label"])
    return out.select("label", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "least", "q25", "median", "q75", "most")))


@query(f"SELECT label, round(avg(m), 6) AS m_mean, round(stddev_samp(m), 6) AS m_std FROM (SELECT label, l_linenumber, avg(score) AS m FROM {_SCORES} GROUP BY ALL) GROUP BY label")
def mean_and_std(spark, d):
    runs = _scores(spark, d).groupBy("label", "l_linenumber").agg(F.avg("score").alias("m"))
    return M.mean_and_std(runs, ["label"], ["m"]).select("label", F.round("m_mean", 6).alias("m_mean"), F.round("m_std", 6).alias("m_std"))


@query(f"""
WITH p AS (SELECT l_orderkey, max(score) AS sp FROM {_SCORES} WHERE label = 1 GROUP BY ALL),
n AS (SELECT l_orderkey, score AS sn, exp(score - max(score) OVER (PARTITION BY l_orderkey)) AS e FROM {_SCORES} WHERE label = 0)
SELECT l_orderkey, round(-ln(sum(e / (1 + exp(sn - sp))) / sum(e)), 6) AS loss FROM n JOIN p USING (l_orderkey) GROUP BY l_orderkey
""")
def bpr_max(spark, d):
    rows = _scores(spark, d)
    best = rows.filter("label = 1").groupBy("l_orderkey").agg(F.max("score").alias("score"), F.lit(1).alias("label"))
    out = M.bpr_max_loss(best.unionByName(rows.filter("label = 0").select("l_orderkey", "score", "label")), "score", "label", ["l_orderkey"])
    return out.select("l_orderkey", F.round("loss", 6).alias("loss"))


@query(f"""
WITH g AS (SELECT l_linenumber, score, count(*) AS n, sum(label) AS p FROM {_SCORES} GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY l_linenumber ORDER BY score DESC))
SELECT l_linenumber, round(sum(p * cp / cn) / sum(p), 6) AS average_precision FROM c GROUP BY l_linenumber
""")
def average_precision_by_label(spark, d):
    return M.label_average_precision(_scores(spark, d), "score", "label", ["l_linenumber"]).withColumn("average_precision", F.round("average_precision", 6))


@query(f"SELECT event_id, CASE WHEN label * 5 - 2 > 0 THEN 1 ELSE 0 END AS label FROM {_EVENTS}")
def label_binary(spark, d):
    return I.label_01(_events(spark, d).withColumn("label", F.col("label") * 5 - 2)).select("event_id", "label")


@query(f"SELECT event_id FROM {_EVENTS} WHERE label > 0")
def positives(spark, d):
    return I.drop_negatives(_events(spark, d)).select("event_id")


_BEFORE = f"(SELECT event_id, list(CASE WHEN label > 0 THEN iid ELSE -iid END) OVER (PARTITION BY uid ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM {_EVENTS})"


def _histories(spark, d):
    return I.history(_events(spark, d), 4, "signed", ["time", "event_id"])


@query(f"SELECT event_id FROM {_BEFORE} WHERE len(h) > 0")
def history_not_empty(spark, d):
    return I.drop_first(_histories(spark, d)).select("event_id")


@query(f"SELECT event_id, array_to_string(list_concat(list_transform(range(0, 6 - len(coalesce(h, [])[-4:])), lambda x: 0), coalesce(h, [])[-4:]), ',') AS padded FROM {_BEFORE}")
def history_padded(spark, d):
    return _histories(spark, d).select("event_id", _text(I.padded(F.col("history"), 6)).alias("padded"))


@query(f"SELECT event_id, abs(v) AS item, sign(v)::INT AS sign FROM (SELECT event_id, unnest(h[-4:]) AS v FROM {_BEFORE})")
def history_signs(spark, d):
    return I.sparse_signs(_histories(spark, d), "event_id", "history")


@query(f"""
WITH u AS (SELECT uid, count(DISTINCT iid) AS seen FROM {_EVENTS} GROUP BY uid), n AS (SELECT count(DISTINCT iid) AS n FROM {_EVENTS})
SELECT uid, least(24, n - seen) AS n, true AS fresh FROM u, n WHERE n > seen
""")
def negatives_complete(spark, d):
    """As many negatives as asked for or all there are, and none that is known."""
    e = _events(spark, d)
    got = I.negatives(e, e, e, 24).join(e.select("uid", "iid", F.lit(1).alias("known")).distinct(), ["uid", "iid"], "left")
    return got.groupBy("uid").agg(F.countDistinct("iid").alias("n"), (F.count("known") == 0).alias("fresh"))


_LINKS = "(SELECT DISTINCT o_custkey AS src, -l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"""
WITH n AS (SELECT count(*) AS n FROM {_LINKS})
SELECT split, n, true AS absent FROM (SELECT 'test' AS split, floor(n * 0.2 + 1e-9)::BIGINT AS n FROM n UNION ALL SELECT 'validation', floor(n * 0.1 + 1e-9)::BIGINT FROM n UNION ALL SELECT 'train', n - floor(n * 0.2 + 1e-9)::BIGINT - floor(n * 0.1 + 1e-9)::BIGINT FROM n)
""")
def link_split(spark, d):
    """Edges of each split, and whether every negative edge is one that doesn't occur."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    e = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (-F.col("l_suppkey")).alias("dst")).distinct()
    out = S.link_split(e, e.select("dst").distinct(), 0.1, 0.2)
    known = e.select("src", F.col("dst").alias("neg"), F.lit(1).alias("known"))
    return out.join(known, ["src", "neg"], "left").groupBy("split").agg(F.count("*").alias("n"), ((F.count("known") == 0) & (F.count("neg") == F.count("*"))).alias("absent"))
