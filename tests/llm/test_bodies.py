"""Problems 1, 3, 5: bodies, pieces, terms, formatting."""

import ast
import json
import random
import re
from collections import Counter

import pytest

from truthframe.functions.bodies import parse_body
from truthframe.llm.contents import canonical, contents
from truthframe.llm.formatting import formatting_groups, formatting_members
from truthframe.llm.splitting import split_body, split_oversized
from truthframe.llm.terms import HELD, count_terms, marked_terms, term_frequencies

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r]")
TRIPLES = [(f"Fellow{i}", "SubClassOf", f"(audits some Panel{i}) and Bench") for i in range(6)]


def notations(triples):
    lists = [list(t) for t in triples]
    yield str(lists)
    yield str(tuple(map(tuple, lists)))
    yield json.dumps(lists)
    yield json.dumps(lists, indent=2).replace("\n", "\r\n")
    yield json.dumps([{"o": o, "s": s, "p": p} for s, p, o in triples])
    yield json.dumps([dict(zip(("subject", "predicate", "object"), t)) for t in triples])
    yield re.sub('"([^"]*)"', "“\\1”", json.dumps(lists))
    yield str([[x.upper(), f" <{y}> ", z.replace(" ", "\t") + " ,"] for x, y, z in reversed(lists)])


def test_all_notations_say_the_same():
    sets = set()
    for text in notations(TRIPLES):
        flat = canonical(parse_body(text))
        sets.add(frozenset(zip(flat[::3], flat[1::3], flat[2::3])))
    assert len(sets) == 1 and len(sets.pop()) == 6


def test_quotes_inside_values_and_separator():
    flat = parse_body("[['a', 'label', \"the panel's 'old' room\"]]")
    assert flat == ["a", "label", "the panel's 'old' room"]
    assert canonical(["A\x1fb", "C"]) == ["ab", "c"] and canonical([]) == []


@pytest.mark.parametrize("bad", [None, "", " \n", "[]x", "ERR no list: [['a','b','c']]", "[['a', 'b', 'c'", "['a','b','c'], ['d','e','f']]", "{'s': 1}", "[" * 5000])
def test_broken_bodies(bad):
    assert not parse_body(bad)


def test_malformed_triples_are_dropped():
    assert parse_body('[["a","b","c"],["d","e"],{"s":"x","p":"y","q":"z"},7]') == ["a", "b", "c"]


def frame(spark, rows, extra="id long, content string"):
    return spark.createDataFrame([(*r, 99, "clash") for r in rows], f"row_id long, body string, {extra}")


def test_formatting_groups(spark):
    other = [(f"X{i}", "is", "Y") for i in range(5)]
    bodies = [*notations(TRIPLES), str([list(t) for t in other]), None, "", "broken [", str([["a", "b", "c"]])]
    rows = list(enumerate(bodies, 10)) + [(10, bodies[0]), (None, bodies[0])]
    df = frame(spark, rows)
    assert {tuple(r) for r in formatting_members(df).collect()} == {(10, i) for i in range(11, 18)}
    assert {(r.first_row_id, r.copies) for r in formatting_groups(df).collect()} == {(10, 9), (18, 1)}
    assert formatting_members(df.limit(0)).count() == 0 and formatting_groups(df.limit(0)).count() == 0


def test_five_distinct_triples_are_needed(spark):
    four = str([["a", "b", str(i % 4)] for i in range(9)])
    five = str([["a", "b", str(i % 5)] for i in range(9)])
    assert [(r.id, r.n) for r in contents(frame(spark, [(1, four), (2, five)])).collect()] == [(2, 5)]


def long_body(n, seed=0):
    rng = random.Random(seed)
    return str([[f"Fellow{rng.randrange(900)}", "SubClassOf", f"(audits some Panel{rng.randrange(900)})"] for _ in range(n)])


@pytest.mark.parametrize("body", [long_body(700), long_body(700)[:-30], long_body(300) * 3, json.dumps([["a", "label", "word " * 5000]] + [["x", "y", "it's (so"]] * 400), "(" * 4000, "é " * 3000])
def test_pieces_hold_the_whole_body(body):
    pieces, tokens = split_body(body), TOKEN.findall(body)
    assert len(pieces) > 1
    joined, before = [], None
    for first, overlap, size, cut, text in pieces:
        own = TOKEN.findall(text)
        assert len(own) == size <= 1024 and own == tokens[first : first + size]
        if before:
            assert own[:overlap] == before[-overlap:] and overlap == min(64, len(before))
        joined += own[overlap:]
        before = own
    assert joined == tokens


def test_cuts_fall_between_triples():
    pieces = split_body(long_body(700))
    assert {p[3] for p in pieces} == {"triple", "end"}
    assert all(TOKEN.findall(p[4])[p[1]] == "[" for p in pieces[1:])


def test_a_huge_entry_is_cut_inside_and_nowhere_else():
    cuts = Counter(p[3] for p in split_body(str([["a", "is", "b"]] * 200 + [["c", "label", "word " * 4000]] + [["d", "is", "e"]] * 200)))
    assert cuts["inside"] >= 3 and cuts["triple"] >= 2


def test_an_edit_moves_only_cuts_nearby():
    body = long_body(3000)
    edited = body[:400] + body[400:].replace("Fellow", "Fellow changed for ", 3)
    starts = [{TOKEN.findall(p[4])[p[1]] + p[4][-60:] for p in split_body(b)} for b in (body, edited)]
    assert len(starts[0] - starts[1]) <= 4 < len(starts[0])


def test_split_oversized(spark):
    limit = "a " * 1024
    df = frame(spark, [(1, limit), (2, limit + "b"), (3, None), (4, ""), (2, limit + "b"), (None, long_body(700))], "piece int, text string")
    out = split_oversized(df)
    assert Counter(r.row_id for r in out.filter("piece = 0").collect()) == {2: 2, None: 1}
    assert out.filter("n_tokens > 1024").count() == 0
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, limit=64, overlap=64)


def brute_terms(bodies):
    occurrences, records = Counter(), Counter()
    for b in bodies:
        terms = [t.lower() for t in re.findall("[A-Za-z0-9_]+", b or "")]
        occurrences.update(terms)
        records.update(set(terms))
    return {t: (occurrences[t], records[t]) for t in occurrences}


def test_terms(spark):
    bodies = ["A a_b, B9", None, "", "broken [ a", "ſtraße KKelvin A", "a " * 20000, "A a_b, B9", "  "]
    df = frame(spark, list(enumerate(bodies)), "records long, term string")
    assert {r.term: (r.occurrences, r.records) for r in term_frequencies(df).collect()} == brute_terms(bodies)
    marks = {r.term: r.mark for r in marked_terms(df).collect()}
    assert marks["a"] == "common" and marks["a_b"] == "rare" and marks["b9"] == "rare"
    assert marked_terms(df.limit(0)).count() == 0


def test_common_begins_at_a_quarter_of_all_rows_and_rare_wins(spark):
    bodies = ["t u"] * 3 + ["u"] + [None] * 8
    marks = {r.term: r.mark for r in marked_terms(frame(spark, list(enumerate(bodies)))).collect()}
    assert marks == {"t": "common", "u": "common"}
    marks = {r.term: r.mark for r in marked_terms(frame(spark, [(1, "x"), (2, "x")])).collect()}
    assert marks == {"x": "rare"}


def test_last_seen_counters():
    counters = {}
    assert count_terms(["a a b", None, "", "a"], counters, 5) == 7
    assert counters["a"] == [3, 2, 7] and counters["b"] == [1, 1, 6] and HELD > 0
    assert ast.literal_eval(str(counters["a"])) == [3, 2, 7]
