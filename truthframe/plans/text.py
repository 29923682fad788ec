"""Text, triple and encoding operators over documents, events and the module tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from truthframe.functions import text as X
from truthframe.operators import ontology as O
from truthframe.operators import patterns as P
from truthframe.operators import triples as T
from truthframe.plans.registry import query
from truthframe.session import table


@query(r"""
SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+'), lambda x: x <> ''), ' ') AS words,
  len(list_filter(regexp_split_to_array(rtrim(trim(text), ','), '[\s(),;]+'), lambda x: x <> '')) AS pieces FROM documents
""")
def tokenise(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(X.word_tokens(F.col("text")), " ").alias("words"), F.size(X.expression_tokens(F.col("text"))).alias("pieces"))


@query(r"""
WITH t AS (SELECT unnest(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+')) AS token FROM documents),
c AS (SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY token HAVING count(*) >= 5)
SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM c ORDER BY n DESC, token LIMIT 200
""")
def vocab_topk(spark, d):
    """The report is of the 200 most frequent words; all are counted."""
    docs = table(spark, d, "documents")
    return T.vocabulary(docs.select(F.explode(X.word_tokens(F.col("text"))).alias("token")), least=5, most=200)


@query("""
SELECT doc_id, array_to_string(list_transform(list_filter([1, 2, 3, 5, 10, 20, 50, 100, 200, 500, 1000], lambda b: n_chars // 10 >= b), lambda b: 'n>=' || b), ',') AS features FROM documents
""")
def bucket_features(spark, d):
    n = F.floor(F.col("n_chars") / 10)
    return table(spark, d, "documents").select("doc_id", F.array_join(X.bucket_features("n", n), ",").alias("features"))


@query(r"""
SELECT p_partkey, regexp_extract(iri, '([^/#]*)[/#]?$', 1) AS local, regexp_extract(iri, '^(.*[/#])[^/#]*$', 1) AS base, lower(p_type) AS plain
FROM (SELECT p_partkey, p_type, 'http://x.org/' || replace(p_brand, '#', '/') || '#' || p_name AS iri FROM part)
""")
def iri_parts(spark, d):
    iri = F.concat(F.lit("http://x.org/"), F.replace("p_brand", F.lit("#"), F.lit("/")), F.lit("#"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.local_name(iri).alias("local"), X.base_iri(iri).alias("base"), F.lower("p_type").alias("plain"))


@query("""
SELECT a.p_partkey AS x, b.p_partkey AS y, round(CASE WHEN a.p_name = b.p_name THEN 1.0 ELSE exp(-levenshtein(a.p_name, b.p_name)::DOUBLE / (length(a.p_name) + length(b.p_name) - levenshtein(a.p_name, b.p_name))) END, 9) AS likeness
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
""")
def edit_similarity(spark, d):
    p = table(spark, d, "part")
    a, b = p.select("p_brand", "p_size", F.col("p_partkey").alias("x"), F.col("p_name").alias("nx")), p.select("p_brand", "p_size", F.col("p_partkey").alias("y"), F.col("p_name").alias("ny"))
    return a.join(b, ["p_brand", "p_size"]).filter("x < y").select("x", "y", F.round(X.edit_similarity(F.col("nx"), F.col("ny")), 9).alias("likeness"))


@query()
def isub_similarity(spark, d):
    n, r = table(spark, d, "nation").select("n_name"), table(spark, d, "region").select("r_name")
    return n.crossJoin(F.broadcast(r)).select("n_name", "r_name", F.round(X.isub("n_name", "r_name"), 9).alias("likeness"))


@query("""
SELECT event_id, ('0x' || substr(h, 1, 16))::UBIGINT % 64 AS index, (CASE WHEN ('0x' || substr(h, 17, 2))::INT % 2 = 1 THEN -1.0 ELSE 1.0 END) * (1 + ('0x' || substr(h, 19, 2))::INT / 255) AS weight
FROM (SELECT event_id, sha256(event_type || event_id) AS h FROM events)
""")
def hash_slots(spark, d):
    h = X.hash_slot(F.concat("event_type", F.col("event_id").cast("string")), 64)
    return table(spark, d, "events").select("event_id", h.alias("h")).select("event_id", "h.index", "h.weight")


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+')) AS token FROM documents),
h AS (SELECT doc_id, sha256(token) AS h FROM t WHERE token <> ''),
w AS (SELECT doc_id, ('0x' || substr(h, 1, 16))::UBIGINT % 16 AS index, sum((CASE WHEN ('0x' || substr(h, 17, 2))::INT % 2 = 1 THEN -1.0 ELSE 1.0 END) * (1 + ('0x' || substr(h, 19, 2))::INT / 255)) AS v FROM h GROUP BY ALL)
SELECT doc_id, index, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM w WHERE v <> 0
""")
def hash_embed(spark, d):
    docs = table(spark, d, "documents")
    tokens = docs.select("doc_id", F.explode(X.word_tokens(F.col("text"))).alias("token"))
    return T.hash_embedding(tokens, "doc_id", 16).withColumn("value", F.round("value", 6))


@query("SELECT l_orderkey, l_linenumber, (f = 1 AND r = 0) OR (s = 1 AND NOT f = 1 AND r = 1) AS holds FROM (SELECT *, (l_linestatus = 'F')::INT AS f, (l_returnflag = 'R')::INT AS r, (l_shipdate < '1996-01-01')::INT AS s FROM lineitem)")
def dnf_eval(spark, d):
    bit = lambda c: c.cast("int")
    flags = F.create_map(F.lit(1), bit(F.col("l_linestatus") == "F"), F.lit(2), bit(F.col("l_returnflag") == "R"), F.lit(3), bit(F.col("l_shipdate") < "1996-01-01"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.dnf_holds(X.parse_dnf(F.lit("(1 ^ ~2) v (3 ^ ~1 ^ 2)")), flags).alias("holds"))


# triples: events as (user, type, props), nations as ontologies


def _event_triples(spark, d):
    e = table(spark, d, "events")
    o = F.concat(F.lit("some "), F.get_json_object("props", "$.k"))
    return e.select(F.col("user_id").alias("onto"), F.col("event_id").alias("pos"), F.col("event_type").alias("s"), F.concat(F.lit("p"), F.col("event_id") % 3).alias("p"), o.alias("o"))


_TRIPLES = "(SELECT user_id AS onto, event_id AS pos, event_type AS s, 'p' || event_id % 3 AS p, 'some ' || json_extract_string(props, '$.k') AS o FROM events)"


@query(f"""
SELECT onto, e AS entity, row_number() OVER (PARTITION BY onto ORDER BY min(a)) + 1 AS local_id FROM (SELECT onto, s AS e, pos * 2 AS a FROM {_TRIPLES} UNION ALL SELECT onto, o, pos * 2 + 1 FROM {_TRIPLES}) GROUP BY onto, e
""")
def local_ids(spark, d):
    return T.local_ids(_event_triples(spark, d))


@query(f"""
WITH e AS (SELECT onto, e, row_number() OVER (PARTITION BY onto ORDER BY min(a)) + 1 AS id FROM (SELECT onto, s AS e, pos * 2 AS a FROM {_TRIPLES} UNION ALL SELECT onto, o, pos * 2 + 1 FROM {_TRIPLES}) GROUP BY onto, e),
v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM (SELECT p || '::some' AS token, count(*) AS n FROM {_TRIPLES} GROUP BY 1 ORDER BY n DESC, token LIMIT 2))
SELECT t.onto, pos, a.id AS s_id, coalesce(v.id, 1) AS p_id, b.id AS o_id FROM {_TRIPLES} t JOIN e a ON a.onto = t.onto AND a.e = t.s JOIN e b ON b.onto = t.onto AND b.e = t.o LEFT JOIN v ON v.token = t.p || '::some'
""")
def encode_triples(spark, d):
    t = _event_triples(spark, d)
    predicates = T.vocabulary(t.select(F.concat("p", F.lit("::some")).alias("token")), most=2)
    return T.encode_triples(t, predicates)


@query(f"""
WITH t AS (SELECT * FROM {_TRIPLES}), u AS (SELECT onto, p, count(*) AS n FROM t GROUP BY ALL)
SELECT DISTINCT * FROM (
  SELECT onto, unnest(['pred=' || p, 'obj_op=some', 'pred_op=' || p || '::some', 'obj_token=' || substr(o, 6), 'pred_obj_token=' || p || '::' || substr(o, 6)]) AS feature FROM t
  UNION ALL SELECT onto, unnest(list_transform(list_filter([1, 2, 3, 5, 10, 20, 50, 100], lambda b: n >= b), lambda b: 'pred_count=' || p || '>=' || b)) FROM u
  UNION ALL SELECT a.onto, 'pred_pair=' || a.p || '&&' || b.p FROM u a JOIN u b ON a.onto = b.onto AND a.p < b.p
  UNION ALL SELECT onto, unnest(list_transform(list_filter([1, 2, 3, 5, 10, 20, 50, 100, 200, 500, 1000], lambda b: n >= b), lambda b: k || '>=' || b)) FROM (
    SELECT onto, 'n_triples' AS k, count(*) AS n FROM t GROUP BY onto UNION ALL SELECT onto, 'n_subjects', count(DISTINCT s) FROM t GROUP BY onto
    UNION ALL SELECT onto, 'n_objects', count(DISTINCT o) FROM t GROUP BY onto UNION ALL SELECT onto, 'n_entities', count(DISTINCT e) FROM (SELECT onto, s AS e FROM t UNION ALL SELECT onto, o FROM t) GROUP BY onto)
  UNION ALL SELECT onto, unnest(list_transform(list_filter([1, 2, 3, 4, 5, 8, 12, 20, 40], lambda b: n >= b), lambda b: 'n_predicates>=' || b)) FROM (SELECT onto, count(*) AS n FROM u GROUP BY onto)
  UNION ALL SELECT onto, 'graph:same_subject_multiple_predicates' FROM t GROUP BY onto, s HAVING count(DISTINCT p) > 1)
""")
def structural_features(spark, d):
    return T.structural_features(_event_triples(spark, d))


@query("""
WITH f AS (SELECT DISTINCT l_orderkey AS k, 'mode' || l_linenumber AS feature FROM lineitem UNION SELECT DISTINCT l_orderkey, 'flag' || l_returnflag FROM lineitem),
y AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders),
c AS (SELECT feature, count(*) AS df, sum(label) AS p, sum(1 - label) AS q FROM f JOIN y USING (k) GROUP BY feature),
t AS (SELECT sum(label) AS pos, sum(1 - label) AS neg FROM y)
SELECT feature, df, round(p / pos, 9) AS pos_rate, round(q / neg, 9) AS neg_rate, round(abs(p / pos - q / neg), 9) AS score FROM c, t ORDER BY round(abs(p / pos - q / neg), 12) DESC, df DESC, feature LIMIT 5
""")
def supervised_vocabulary(spark, d):
    """A report of the five features that tell most."""
    l = table(spark, d, "lineitem")
    f = l.select(F.col("l_orderkey").alias("k"), F.explode(F.array(F.concat(F.lit("mode"), "l_linenumber"), F.concat(F.lit("flag"), "l_returnflag"))).alias("feature"))
    y = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
    return T.supervised_vocabulary(f, y, "k", 5).select("feature", "df", *(F.round(c, 9).alias(c) for c in ("pos_rate", "neg_rate", "score")))


@query("SELECT s AS value, count(q) AS n FROM (SELECT unnest(range(0, 51)) AS s) LEFT JOIN (SELECT l_quantity::INT AS q FROM lineitem) ON q = s GROUP BY s")
def dense_histogram(spark, d):
    return T.dense_histogram(table(spark, d, "lineitem"), "l_quantity")


@query("""
SELECT 'n_chars' AS value, count(n_chars) AS n, min(n_chars)::DOUBLE AS least, max(n_chars)::DOUBLE AS most, median(n_chars) AS median, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS sd FROM documents
""")
def summary_stats(spark, d):
    return T.summary(table(spark, d, "documents"), ["n_chars"]).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


_LABEL = """CASE WHEN lower(trim(consistency)) IN ('inconsistent', '0', 'false', 'unsat', 'no') THEN 'inconsistent' WHEN lower(trim(consistency)) IN ('consistent', '1', 'true', 'sat', 'yes') THEN 'consistent' ELSE lower(trim(consistency)) END"""


@query(f"""
WITH p AS (SELECT regexp_extract(file_name, '^(.*?)(?:_Department|_module|_|$)', 1) AS onto, {_LABEL} AS label FROM predictions)
SELECT onto, CASE WHEN bool_or(label = 'inconsistent') THEN 'inconsistent' ELSE 'consistent' END AS label, count(*) AS modules, count(*) FILTER (label = 'inconsistent') AS inconsistent,
  printf('%.1f%%', 100.0 * count(*) FILTER (label = 'inconsistent') / count(*)) AS share FROM p WHERE onto IS NOT NULL AND label IS NOT NULL GROUP BY onto
""")
def votes(spark, d):
    return O.module_votes(table(spark, d, "predictions"))


# a body's entries stand in quotes, three in a bracket or three named ones in braces; what is left of a sound body is a list of such
_QUOTED = r"""(?:''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*"|“[^”]*”)"""
_SOUND = r"^(\[|\()((\[s(,s)*,?\]|\(s(,s)*,?\)|\[\]|\(\)|\{s:s(,s:s)*\}),?)*(\]|\))$"


@query(rf"""
WITH body AS (SELECT trim(body, chr(32) || chr(9) || chr(10) || chr(13)) AS b FROM train_data WHERE body IS NOT NULL),
good AS (SELECT b FROM body WHERE regexp_matches(regexp_replace(regexp_replace(b, '{_QUOTED}', 's', 'g'), '\s', '', 'g'), '{_SOUND}')),
p AS (SELECT unnest(regexp_extract_all(b, '[\[(]\s*{_QUOTED}\s*,\s*({_QUOTED})\s*,\s*{_QUOTED}\s*,?\s*[\])]', 1)) AS p FROM good
  UNION ALL SELECT regexp_extract(i, '["“]?(?:p|predicate|pred)["”]?\s*:\s*({_QUOTED})', 1) FROM (SELECT unnest(regexp_extract_all(b, '\{{(?:\s*{_QUOTED}\s*[:,]?)*\}}')) AS i FROM good))
SELECT trim(substr(p, 2, length(p) - 2)) AS p, count(*) AS n FROM p GROUP BY 1
""")
def body_predicates(spark, d):
    """Predicates of all bodies, in whatever notation."""
    t = T.parse_bodies(table(spark, d, "train_data").select("body"))
    return t.filter("triples is not null").select(F.explode("triples").alias("t")).groupBy(F.col("t.p").alias("p")).agg(F.count("*").alias("n"))


@query()
def module_axioms(spark, d):
    """How many axioms of each kind every module states."""
    t = T.parse_bodies(table(spark, d, "train_data").select("row_id", "body"))
    rows = t.select(F.col("row_id").cast("string").alias("onto"), F.explode("triples").alias("t")).select("onto", "t.s", "t.p", "t.o")
    return P.profile(P.axioms_from_triples(rows))


@query("""
WITH t AS (SELECT p_brand AS file, p_type AS tag, p_size > 25 AS identified FROM part), k AS (SELECT file, tag, bool_or(identified) AS i FROM t WHERE tag NOT LIKE 'S%' GROUP BY ALL)
SELECT file, count(*) FILTER (i) AS classes, count(*) FILTER (NOT i) AS properties, count(*) AS combined FROM k GROUP BY file
""")
def entity_counts(spark, d):
    p = table(spark, d, "part")
    return T.entity_counts(p.select(F.col("p_brand").alias("file"), F.col("p_type").alias("tag"), (F.col("p_size") > 25).alias("identified")), p.filter("p_type not like 'S%'").select(F.col("p_type").alias("tag")))


@query("""
SELECT file_name, coalesce(lower(trim(injected_pattern)) NOT IN ('none'), false) AS strict, coalesce(lower(trim(injected_pattern)) NOT IN ('none', '', 'nan'), false) AS loose FROM train_data
""")
def injected_rows(spark, d):
    p = F.col("injected_pattern")
    return table(spark, d, "train_data").select("file_name", T.injected(p).alias("strict"), T.injected(p, False).alias("loose"))


@query(f"SELECT s, p, o, row_number() OVER (ORDER BY min((onto, pos)), s, p, o) AS atom FROM {_TRIPLES} GROUP BY s, p, o")
def atom_ids(spark, d):
    return T.atom_ids(_event_triples(spark, d))


@query(f"SELECT onto, pos, row_number() OVER (PARTITION BY onto ORDER BY p, s, o, pos) - 1 AS place FROM {_TRIPLES}")
def order_triples(spark, d):
    return T.order_triples(_event_triples(spark, d)).select("onto", "pos", "place")


@query(f"""
WITH f AS (SELECT DISTINCT onto, s AS feature FROM {_TRIPLES}), n AS (SELECT count(DISTINCT onto) AS n FROM {_TRIPLES})
SELECT feature, round(0.75 * count(*) / n, 6) AS rate FROM f, n GROUP BY feature, n
""")
def feature_activation(spark, d):
    t = _event_triples(spark, d)
    seen = t.select("onto", F.col("s").alias("feature"))
    return T.activation_rates(T.feature_bounds(t, seen.select("feature").distinct(), seen)).withColumn("rate", F.round("rate", 6))


@query("""
SELECT round(avg(CASE WHEN lower(trim(consistency)) = lower(trim(injected_pattern)) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM train_data
""")
def text_accuracy(spark, d):
    from truthframe.operators import metrics as M

    rows = table(spark, d, "train_data")
    return M.text_scores(rows, "consistency", "injected_pattern").crossJoin(rows.agg(F.count("*").alias("n"))).select(F.round("accuracy", 6).alias("accuracy"), "n")


_CUT = r"""regexp_replace({x}, '(\p{Ll}[\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{N}]*)(\p{Lu})', '\1 \2', 'g')"""
_TERMS = r"array_to_string(list_filter(regexp_split_to_array(lower(" + _CUT + r"), '[^\p{L}\p{N}]+'), lambda t: t <> ''), ' ')"


@query("SELECT DISTINCT file_name, " + _TERMS.replace("{x}", "regexp_extract(file_name, '([^/#]*)$', 1)") + " AS terms FROM train_data WHERE file_name IS NOT NULL")
def term_tokens(spark, d):
    names = table(spark, d, "train_data").select("file_name").filter("file_name is not null").distinct()
    return names.select("file_name", F.array_join(X.term_tokens(F.col("file_name")), " ").alias("terms"))


@query(r"""
SELECT DISTINCT file_name, array_to_string(list_transform(regexp_extract_all(file_name, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 12, '0') ELSE x END), '') AS key,
  trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(file_name, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS plain,
  array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(file_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS words
FROM train_data WHERE file_name IS NOT NULL
""")
def name_forms(spark, d):
    """Sort keys, plain names and words of file names."""
    f = F.col("file_name")
    names = table(spark, d, "train_data").select("file_name").filter("file_name is not null").distinct()
    return names.select("file_name", X.natural_key(f).alias("key"), X.plain_name(f).alias("plain"), F.array_join(X.camel_words(f), " ").alias("words"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS likeness FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0")
def cosine(spark, d):
    """Every twentieth vector as a query against all vectors of its label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    both = e.filter("vec_id % 20 = 0").toDF("a", "label", "ea").join(e.toDF("b", "label", "eb"), "label")
    return both.select("a", "b", F.round(X.cosine(F.col("ea"), F.col("eb")), 6).alias("likeness"))


_SHORT = r"""(SELECT p_partkey AS k, p_brand || 'XMLPart' || p_size || 'Kind' AS s, 'isMadeBy' AS p, p_type || ' ' || p_name AS o FROM part)"""


def _part_triples(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("k"), F.concat("p_brand", F.lit("XMLPart"), F.col("p_size").cast("string"), F.lit("Kind")).alias("s"), F.lit("isMadeBy").alias("p"), F.concat_ws(" ", "p_type", "p_name").alias("o"))


@query(f"""
WITH t AS (SELECT k, unnest(string_split({_TERMS.replace("{x}", "regexp_extract(x, '([^/#]*)$', 1)")}, ' ')) AS token FROM (SELECT k, unnest([s, p, o]) AS x FROM {_SHORT})),
h AS (SELECT k, sha256(token) AS h FROM t),
w AS (SELECT k, ('0x' || substr(h, 1, 16))::UBIGINT % 10 AS index, sum((CASE WHEN ('0x' || substr(h, 17, 2))::INT % 2 = 1 THEN -1.0 ELSE 1.0 END) * (1 + ('0x' || substr(h, 19, 2))::INT / 255)) AS v FROM h GROUP BY ALL)
SELECT k, index, round(v / sqrt(sum(v * v) OVER (PARTITION BY k)), 6) AS value FROM w WHERE v <> 0
""")
def triple_embed(spark, d):
    """Hash embeddings of triples by the tokens of their terms, in a number of dimensions that is no power of two."""
    terms = _part_triples(spark, d).select("k", F.explode(F.array("s", "p", "o")).alias("term"))
    tokens = terms.select("k", F.explode(X.term_tokens(F.col("term"))).alias("token"))
    return T.hash_embedding(tokens, "k", 10).withColumn("value", F.round("value", 6))


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+')) AS token FROM documents),
e AS (SELECT doc_id, sha256(doc_id || ':' || coalesce(source, '')) AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t WHERE token <> '')),
v AS (SELECT doc_id, i AS index, ('0x' || substr(h, (i * 2 + 1)::BIGINT, 2))::INT / 255 * 2 - 1 AS v FROM e, (SELECT unnest(range(0, 16)) AS i))
SELECT doc_id, index::INT AS index, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM v
""")
def hash_embed_fallback(spark, d):
    """Vectors of the documents without any word, from a hash of what else is known."""
    docs = table(spark, d, "documents")
    tokens = docs.select("doc_id", F.explode(X.word_tokens(F.col("text"))).alias("token"))
    raw = docs.select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("source", F.lit(""))).alias("raw"))
    out = T.hash_embedding(tokens, "doc_id", 16, fallback=F.col("raw"), source=raw)
    return out.join(tokens.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("value", F.round("value", 6))


def _nation_lines(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    name = lambda c: F.concat(F.lit("ex:"), F.replace(c, F.lit(" "), F.lit("")))
    lines = F.array(
        F.lit("Prefix: ex: <http://x.org/>"), F.concat(F.lit("Individual: "), name("n_name")), F.lit("Types:"), name("r_name"), F.concat(F.lit("and ex:Land")), F.lit("Facts:"),
        F.concat(F.lit("ex:hasKey  "), F.col("n_nationkey").cast("string")), F.concat(F.lit("ex:lies in"), F.lit("  "), name("r_name")), F.lit("DisjointWith:"), F.lit("ex:Sea, ex:Air"),
    )
    return both.select(F.col("n_name").alias("file_name"), F.posexplode(lines).alias("line_no", "line"))


@query("""
WITH n AS (SELECT n_name AS file_name, replace(n_name, ' ', '') AS s, replace(r_name, ' ', '') AS r, n_nationkey::VARCHAR AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT file_name, s, 'is' AS p, r || ' and Land' AS o FROM n UNION ALL SELECT file_name, s, 'hasKey', k FROM n UNION ALL SELECT file_name, s, 'lies in', r FROM n
UNION ALL SELECT file_name, s, 'DisjointWith', unnest(['Sea', 'Air']) FROM n
""")
def line_triples(spark, d):
    """Ontology lines without their prefixes, as cleaned triples."""
    return T.clean_triples(T.translate_lines(T.remove_prefixes(_nation_lines(spark, d)))).select("file_name", "s", "p", "o")


_FEATURES = ("owl_pred=subclassof", "owl_pred=disjointwith", "owl_pred=equivalentto", "owl_pred=subpropertyof", "owl_pred=domain", "owl_pred=range", "obj_op=not", "obj_op=some", "graph:subclass_cycle", "graph:subclass_chain_len2", "n_triples>=3", "pred=label", "pred=note")
_FEATURE_ROWS = f"(SELECT p_type AS onto, {list(_FEATURES)}[(p_partkey * 7 + p_size) % {len(_FEATURES)} + 1] AS f FROM part WHERE p_size < 30)"


@query(f"""
WITH h AS (SELECT onto, bool_or(f = 'owl_pred=subclassof') AS sub, bool_or(f = 'owl_pred=disjointwith') AS dis, bool_or(f = 'owl_pred=equivalentto') AS equ, bool_or(f = 'owl_pred=subpropertyof') AS prop,
  bool_or(f = 'owl_pred=domain') AS dom, bool_or(f = 'owl_pred=range') AS ran, bool_or(f = 'obj_op=not') AS neg, bool_or(f = 'graph:subclass_cycle') AS cyc, bool_or(f = 'graph:subclass_chain_len2') AS multi FROM {_FEATURE_ROWS} GROUP BY onto)
SELECT onto, 'rule_subclass_cycle' AS rule FROM h WHERE cyc UNION ALL SELECT onto, 'rule_disjoint_subclass_conflict' FROM h WHERE sub AND dis AND multi UNION ALL SELECT onto, 'rule_disjoint_equivalent_mix' FROM h WHERE equ AND dis
UNION ALL SELECT onto, 'rule_property_constraint_mix' FROM h WHERE prop AND dom AND ran UNION ALL SELECT onto, 'rule_negated_restriction' FROM h WHERE sub AND neg
""")
def rule_atoms(spark, d):
    p = table(spark, d, "part").filter("p_size < 30")
    at = ((F.col("p_partkey") * 7 + F.col("p_size")) % len(_FEATURES) + 1).cast("int")
    return T.rule_atoms(p.select(F.col("p_type").alias("onto"), F.element_at(F.array(*map(F.lit, _FEATURES)), at).alias("feature")))


@query("SELECT DISTINCT l_suppkey AS onto, l_partkey % 40 AS s, l_orderkey % 40 AS o, l_linenumber AS p FROM lineitem WHERE l_partkey % 40 < 30 AND l_orderkey % 40 < 30 AND l_linenumber < 4")
def multi_hot(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("onto"), (F.col("l_partkey") % 40).alias("s_id"), (F.col("l_orderkey") % 40).alias("o_id"), F.col("l_linenumber").alias("p_id"))
    return T.multi_hot(l, 30, 4)


@query('SELECT event_id, sum(event_id % 9 + 1) OVER w - event_id % 9 - 1 AS start, sum(event_id % 9 + 1) OVER w AS "end" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)')
def relative_positions(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 9 + 1).alias("size"))
    return T.relative_positions(e, "user_id", "event_id", "size").select("event_id", "start", "end")


@query("""
SELECT k FROM (SELECT p_partkey AS k, ['label', 'is', 'Note', 'madeOf'][p_partkey % 4 + 1] AS p, CASE WHEN p_size % 5 = 0 THEN 'skos:Concept' WHEN p_size % 5 = 1 THEN 'http://x.org/skos/1' ELSE p_name END AS o FROM part)
WHERE lower(p) NOT IN ('label', 'comment', 'note', 'seealso', 'isdefinedby') AND NOT regexp_matches(lower(o), '(^|[ /:#(])skos[:/#]')
""")
def annotations_dropped(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    o = F.when(size % 5 == 0, "skos:Concept").when(size % 5 == 1, "http://x.org/skos/1").otherwise(F.col("p_name"))
    p = F.element_at(F.array(*map(F.lit, ("label", "is", "Note", "madeOf"))), (k % 4 + 1).cast("int"))
    return T.drop_annotations(table(spark, d, "part").select(k.alias("k"), F.col("p_type").alias("s"), p.alias("p"), o.alias("o"))).select("k")


@query("SELECT row_id FROM train_data WHERE tokenized_length <= 4096")
def within_length(spark, d):
    return T.within_length(table(spark, d, "train_data")).select("row_id")


@query(f"SELECT onto, pos FROM {_TRIPLES} QUALIFY row_number() OVER (PARTITION BY onto ORDER BY pos) <= 7")
def first_triples(spark, d):
    """What a reader of fixed length keeps of each ontology."""
    return T.first_triples(_event_triples(spark, d), 7).select("onto", "pos")


@query(f"""
WITH e AS (SELECT onto, e, row_number() OVER (PARTITION BY onto ORDER BY min(a)) AS nth FROM (SELECT onto, s AS e, pos * 2 AS a FROM {_TRIPLES} UNION ALL SELECT onto, o, pos * 2 + 1 FROM {_TRIPLES}) GROUP BY onto, e)
SELECT e.onto, count(*) AS entities, count(*) FILTER (nth > 6) AS overflow, (SELECT count(*) FROM (SELECT onto, unnest([s, o]) AS x FROM {_TRIPLES}) t JOIN e f ON f.onto = t.onto AND f.e = t.x AND f.nth > 6 WHERE t.onto = e.onto) AS unknown_ends FROM e GROUP BY e.onto
""")
def entity_overflow(spark, d):
    return T.entity_overflow(_event_triples(spark, d), 6)


@query("""
WITH f AS (SELECT DISTINCT l_orderkey AS k, 'mode' || l_linenumber AS feature FROM lineitem UNION SELECT DISTINCT l_orderkey, 'flag' || l_returnflag FROM lineitem),
y AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders),
c AS (SELECT feature, count(*) AS df, sum(label) AS p, sum(1 - label) AS q FROM f JOIN y USING (k) GROUP BY feature), t AS (SELECT sum(label) AS pos, sum(1 - label) AS neg FROM y)
SELECT feature, CASE WHEN p / pos >= q / neg THEN 1 ELSE -1 END AS polarity FROM c, t
QUALIFY row_number() OVER (PARTITION BY feature[1:4] ORDER BY round(abs(p / pos - q / neg), 12) DESC, round(p / pos + q / neg, 12) DESC, feature) <= 2
""")
def grouped_vocabulary(spark, d):
    """The two best features of each group, and the class that they speak for."""
    l = table(spark, d, "lineitem")
    f = l.select(F.col("l_orderkey").alias("k"), F.explode(F.array(F.concat(F.lit("mode"), "l_linenumber"), F.concat(F.lit("flag"), "l_returnflag"))).alias("feature"))
    y = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
    return T.polarity(T.supervised_vocabulary(f, y, "k", 2, group=F.substring("feature", 1, 4))).select("feature", "polarity")
