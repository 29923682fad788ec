"""SQL that the training-data queries must equal: by brute force, where the answer is defined by the data alone."""

from __future__ import annotations

_TOKENS = "regexp_extract_all(body, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\r]')"

# A body's triples in any notation: quoted entries, three in a bracket or three named ones in braces. What is left of a
# sound body without its entries is a list of such triples.
_QUOTED = r"""(?:''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*"|“[^”]*”)"""
_ITEM = rf"[\[(]\s*({_QUOTED})\s*,\s*({_QUOTED})\s*,\s*({_QUOTED})\s*,?\s*[\])]"
_NAMES = {"s": "s|subject|subj", "p": "p|predicate|pred", "o": "o|object|obj"}
_OBJECT = rf"\{{(?:\s*{_QUOTED}\s*[:,]?)*\}}"


def _field(names: str) -> str:
    return rf"""regexp_extract(i, '["“]?(?:{names})["”]?\s*:\s*({_QUOTED})', 1)"""


def _triples(table: str) -> str:
    """``(row_id, t)``: the distinct canonical triples of each row that has a content."""
    sound = r"^(\[|\()((\[s(,s)*,?\]|\(s(,s)*,?\)|\[\]|\(\)|\{s:s(,s:s)*\}),?)*(\]|\))$"
    columns = ", ".join(f"unnest(regexp_extract_all(b, '{_ITEM}', {k})) AS {c}" for k, c in enumerate("spo", 1))
    plain = r"regexp_replace(lower(regexp_replace(regexp_replace(x, '\\u[0-9a-fA-F]{4}', '', 'g'), '\\[a-z]', '', 'g')), '[^a-z0-9]', '', 'g')"
    return rf"""(
      WITH body AS (SELECT row_id, trim(body, chr(32) || chr(9) || chr(10) || chr(13)) AS b FROM {table} WHERE body IS NOT NULL),
      good AS (SELECT row_id, b FROM body WHERE regexp_matches(regexp_replace(regexp_replace(b, '{_QUOTED}', 's', 'g'), '\s', '', 'g'), '{sound}')),
      entry AS (SELECT row_id, {columns} FROM good
        UNION ALL SELECT row_id, {', '.join(map(_field, _NAMES.values()))} FROM (SELECT row_id, unnest(regexp_extract_all(b, '{_OBJECT}')) AS i FROM good)),
      t AS (SELECT DISTINCT row_id, array_to_string(list_transform([s, p, o], lambda x: {plain}), '|') AS t FROM entry)
      SELECT * FROM t QUALIFY count(*) OVER (PARTITION BY row_id) >= 5)"""


_EVALUATION = "(SELECT *, 'eval' AS split_name FROM eval_data UNION ALL SELECT *, 'test' FROM test_data)"
_OVERLAPS = f"""
WITH a AS MATERIALIZED (SELECT * FROM {_triples('train_data')}), b AS MATERIALIZED (SELECT * FROM {_triples(_EVALUATION)}),
na AS (SELECT row_id, count(*) AS n FROM a GROUP BY row_id), nb AS (SELECT row_id, count(*) AS n FROM b GROUP BY row_id),
met AS (SELECT a.row_id AS train_row_id, b.row_id, count(*) AS shared FROM a JOIN b USING (t) GROUP BY ALL),
found AS (SELECT train_row_id, met.row_id, split_name, shared::INT AS shared, shared / (na.n + nb.n - shared) AS similarity, shared / nb.n AS overlap, shared / na.n AS train_overlap
  FROM met JOIN na ON na.row_id = train_row_id JOIN nb ON nb.row_id = met.row_id JOIN (SELECT row_id, split_name FROM {_EVALUATION}) e ON e.row_id = met.row_id WHERE 5 * shared >= 4 * (na.n + nb.n - shared))
"""

_NUMBERS = r"""list_distinct(list_transform(regexp_extract_all(%s, '(?i)(?:university|univ|\bu|_u)[ _-]*0*([0-9]+)', 1), lambda x: x::BIGINT))"""
_NAME = "replace(coalesce(file_name, ''), '%20', ' ')"

_TERMS = r"""
WITH words AS (
  SELECT row_number() OVER () AS record, regexp_extract_all(body, '[A-Za-z0-9_]+') AS terms FROM train_data
), term AS (SELECT record, lower(unnest(terms)) AS term FROM words),
counted AS (SELECT term, count(*) AS occurrences, count(DISTINCT record) AS records FROM term GROUP BY term)
SELECT term, occurrences, records,
  CASE WHEN records <= 2 THEN 'rare' WHEN records >= 0.25 * (SELECT count(*) FROM train_data) THEN 'common' END AS mark
FROM counted
"""

_RELATED = f"""
WITH RECURSIVE named AS (
  SELECT row_id, unnest({_NUMBERS % f"{_NAME} || ' ' || coalesce(injected_pattern, '')"}) AS key FROM train_data
), tie AS (SELECT DISTINCT a.key AS src, b.key AS dst FROM named a JOIN named b ON a.row_id = b.row_id AND a.key <> b.key),
reach(key, root) AS (
  SELECT DISTINCT key, key FROM named
  UNION
  SELECT tie.dst, reach.root FROM reach JOIN tie ON tie.src = reach.key AND reach.root < tie.dst
)
SELECT row_id, min(root) AS group_key FROM named JOIN reach USING (key) GROUP BY row_id
"""

_CONTENT = f"WITH RECURSIVE c AS MATERIALIZED (SELECT row_id, list_sort(list(t)) AS c FROM {_triples('train_data')} GROUP BY row_id), f AS (SELECT c, min(row_id) AS first_row_id, count(*) AS copies FROM c GROUP BY c)"

_GROUPS = f"""{_CONTENT}, t AS MATERIALIZED (SELECT first_row_id AS id, unnest(c) AS t FROM f), n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
met AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM t x JOIN t y ON x.t = y.t AND x.id <> y.id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
reach(id, root) AS (SELECT id, id FROM n UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id AND reach.root < link.b),
root AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
grouped AS (SELECT root AS first_row_id, c.row_id, copies FROM c JOIN f USING (c) JOIN root ON root.id = f.first_row_id)
"""

_WINDOWS = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT DISTINCT doc_id, place, substring(text, place, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS place FROM d)),
held AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT DISTINCT doc_id, place FROM w SEMI JOIN held USING (s))
"""

ORACLES: dict[str, str] = {
    "p1_found": f"SELECT row_id FROM train_data WHERE len({_TOKENS}) > 1024",
    "p1_rejoined": f"SELECT row_id, len({_TOKENS}) AS n_tokens, md5(body) AS body_md5, true AS within FROM train_data WHERE len({_TOKENS}) > 1024",
    "p2_found": f"{_OVERLAPS} SELECT DISTINCT train_row_id, row_id, split_name FROM found",
    "p2_overlaps": f"{_OVERLAPS} SELECT DISTINCT * FROM found",
    "p2_report": f"""{_OVERLAPS}, named AS (SELECT row_id, unnest(CASE WHEN len(u) = 0 THEN [NULL] ELSE u END) AS university FROM (SELECT row_id, {_NUMBERS % _NAME} AS u FROM {_EVALUATION}))
SELECT split_name, university, count(*) AS pairs, count(DISTINCT row_id) AS rows FROM (SELECT DISTINCT train_row_id, row_id, split_name FROM found) JOIN named USING (row_id) GROUP BY ALL""",
    "p2_classes": f"""{_OVERLAPS}, ca AS (SELECT row_id, min(row_id) OVER (PARTITION BY c) AS class, count(*) OVER (PARTITION BY c) AS copies FROM (SELECT row_id, list_sort(list(t)) AS c FROM a GROUP BY row_id)),
cb AS (SELECT row_id, min(row_id) OVER (PARTITION BY c) AS class, count(*) OVER (PARTITION BY c) AS copies FROM (SELECT row_id, list_sort(list(t)) AS c FROM b GROUP BY row_id))
SELECT train_row_id AS train_class, found.row_id AS class, ca.copies AS train_copies, cb.copies, shared, similarity, overlap, train_overlap
FROM found JOIN ca ON ca.row_id = train_row_id AND ca.class = train_row_id JOIN cb ON cb.row_id = found.row_id AND cb.class = found.row_id""",
    "p3_terms": _TERMS,
    "p3_found": f"SELECT term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p4_found": _RELATED,
    "p4_kept": f"SELECT group_key, count(*) AS rows, 1 AS splits FROM ({_RELATED}) GROUP BY group_key",
    "p5_found": f"{_CONTENT} SELECT first_row_id, row_id FROM c JOIN f USING (c) WHERE row_id > first_row_id",
    "p5_records": f"{_CONTENT} SELECT first_row_id, copies FROM f",
    "p6_found": f"{_GROUPS} SELECT first_row_id, row_id FROM grouped WHERE row_id > first_row_id",
    "p6_groups": f"{_GROUPS} SELECT first_row_id, row_id, copies FROM grouped",
    "p7_rejoined": "SELECT doc_id, length(text) AS n_chars, md5(text) AS text_md5 FROM documents WHERE text <> ''",
    "p7_limits": "SELECT true AS within, true AS gapless, true AS nearly_full",
    "p8_limits": "SELECT trim(regexp_replace(lower(trim(t.source)), '[\\s_-]+', '_', 'g')) AS source, true AS within_repeats, true AS near_share FROM mix_targets t",
    "p9_found": f"{_WINDOWS} SELECT DISTINCT doc_id FROM hit",
    "p9_characters": f"{_WINDOWS} SELECT doc_id, sum(least(200, coalesce(after - place, 200)))::BIGINT AS shared_chars FROM (SELECT doc_id, place, lead(place) OVER (PARTITION BY doc_id ORDER BY place) AS after FROM hit) GROUP BY doc_id",
}
