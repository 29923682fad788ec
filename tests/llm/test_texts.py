"""Problems 7, 8, 9: containers, mixtures, shared spans."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest


from truthframe.llm.mixing import Flow, Mixture, plan, route
from truthframe.llm.packing import fill_containers, fill_report, pack
from truthframe.llm.spans import SharedSpans, align, chain, grams, seeds
from truthframe.llm.tokens import VOCABULARY, cut_text, tokenizer

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
WORDS = "module axiom panel annex river quarry supplies bench the of and closure grew before".split()


@pytest.mark.parametrize("seed", range(6))
def test_pack_places_every_item_once(seed):
    rng = random.Random(seed)
    histogram = Counter(min(100, 1 + int(rng.expovariate(0.03))) for _ in range(rng.choice([1, 30, 5000])))
    if seed == 5:
        histogram = Counter({40: 7, 33: 1_000_000, 34: 3, 100: 2})
    bins = pack(histogram, 100)
    placed = Counter()
    for pattern, n in bins:
        assert n > 0 and sum(s * k for s, k in pattern) <= 100 and sum(k for s, k in pattern if 3 * s > 100) <= 2
        for s, k in pattern:
            placed[s] += k * n
    assert placed == histogram
    total, least = sum(n for _, n in bins), -(-sum(s * n for s, n in histogram.items()) // 100)
    assert total <= least * 1.25 + 2
    assert pack({}, 100) == [] and pytest.raises(ValueError, pack, {101: 1}, 100)


@needs_vocabulary
@pytest.mark.parametrize("text", ["", "one axiom", "axiom " * 400, "日本語のテキスト🙂" * 60, "x" * 5000, " " * 4000, "é́" * 500])
def test_cut_text_covers_the_text(text):
    enc = tokenizer()
    found = cut_text(text, 64, enc)
    assert "".join(text[a : a + n] for a, n, _ in found) == text
    assert all(0 < len(enc.encode_ordinary(text[a : a + n])) == k <= 64 for a, n, k in found)


@needs_vocabulary
def test_fill_containers(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 200)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "axiom " * 3000), (303, "   "), (5, rows[5][1]), (None, "a note")]
    rows += [(400 + i, "axiom") for i in range(400)]  # one size that very many have
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, bin_id long, salt int")
    got = fill_containers(df, capacity=256).collect()
    enc, texts = tokenizer(), {i: t for i, t in rows if t}
    room = Counter()
    for r in got:
        room[r.bin_id] += r.n_tokens
        assert len(enc.encode_ordinary(texts[r.doc_id][r.first_char : r.first_char + r.n_chars])) == r.n_tokens
    assert max(room.values()) <= 256 and sorted(room) == list(range(len(room)))
    pieces = Counter(r.doc_id for r in got)
    assert set(pieces) == set(texts) and pieces[302] > 5 and pieces[5] == 2 and all(n == 1 for i, n in pieces.items() if i not in (5, 302))
    report = fill_report(fill_containers(df, capacity=256), 256).first()
    assert report.bins == len(room) and report.filled > 0.97
    assert fill_containers(df.limit(0)).count() == 0 and fill_report(fill_containers(df.limit(0))).first().bins == 0


def test_flow_prefers_fewer_repetitions():
    flow, total = route({1: 100, 3: 50, 2: 30}, [120, 80], [1, 3])
    assert total == 200 and sum(v for (_, s), v in flow.items() if s == 0) == 120
    assert flow[(1, 0)] == 100  # the text of both sources is left to the scarcer as far as may be
    flow, total = route({1: 10}, [100], [3])
    assert flow == {(1, 0): 30} and total == 30
    net = Flow(2)
    net.arc(0, 1, 5)
    assert net.run(0, 1) == 5 and net.run(0, 1) == 0


def test_plan_scales_to_sources_that_exist():
    flow, wanted = plan({1: 1000, 2: 100}, [0.5, 0.3, 0.2], [1, 5, 1])
    assert wanted == pytest.approx([0.625, 0.375, 0.0])
    by = {s: sum(v for (_, t), v in flow.items() if t == s) for s in (0, 1)}
    assert by[1] == 499 or by[1] == 500
    assert plan({}, [1.0], [1])[0] == {}


@needs_vocabulary
def test_mixture(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 60)))
    rows = [(i, text(), "big") for i in range(600)] + [(1000 + i, text(), " Small-Source ") for i in range(40)]
    rows += [(2000 + i, rows[i][1], "small_source") for i in range(10)]  # texts of both
    rows += [(3000, None, "big"), (3001, "", "big"), (3002, text(), None), (3003, text(), "other"), (0, rows[0][1], "big")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, bit string, order long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small_source", 0.3, 4), ("missing", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = Mixture(df, targets)
    draws = mix.draws().collect()
    uses = Counter((r.doc_id, r.source) for r in draws)
    assert max(n for (_, s), n in uses.items() if s == "big") == 1 and max(uses.values()) <= 4
    assert {r.copy for r in draws if r.source == "small_source"} <= set(range(4))
    assert all(Counter((r.doc_id, r.source, r.copy) for r in draws)[k] == 1 for k in [(r.doc_id, r.source, r.copy) for r in draws])
    report = {r.source: r for r in mix.report().collect()}
    assert report["missing"].tokens == 0 and report["missing"].wanted_share == 0
    for s in ("big", "small_source"):
        assert abs(report[s].reached_share - report[s].wanted_share) < 0.02
    again = Mixture(df, targets).draws().collect()
    assert sorted(draws) == sorted(again)
    assert Mixture(df.limit(0), targets).draws().count() == 0
    more = {r.source: r for r in Mixture(df, targets, total_tokens=10**9).report().collect()}
    assert more["big"].most_repeats == 1 and more["small_source"].most_repeats == 4


def brute_shared(rows, length):
    owners = defaultdict(set)
    for i, t in rows:
        for p in range(len(t or "") - length + 1):
            owners[t[p : p + length]].add(i)
    out = {}
    for i, t in rows:
        covered = set()
        for p in range(len(t or "") - length + 1):
            if owners[t[p : p + length]] - {i}:
                covered |= set(range(p, p + length))
        if covered:
            out[i] = len(covered)
    return out


def test_shared_spans_equal_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh 🙂é") for _ in range(n))
    quote, rows = text(130), []
    for i in range(60):
        t = text(rng.randrange(0, 200))
        if i % 3 == 0:  # a third of all hold parts of one quotation, cut differently
            a = rng.randrange(0, 60)
            t += quote[a : a + rng.randrange(30, 130)] + text(rng.randrange(0, 40))
        rows.append((i, t))
    rows += [(60, rows[1][1][-40:] + text(30)), (61, rows[1][1][-39:] + text(30)), (62, "z" * 300), (63, "z" * 90 + text(5)), (64, text(50) * 3)]
    rows += [(70, None), (71, ""), (72, quote[:39]), (73, quote[5:45])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + rows[:2] + [(None, quote)]], "doc_id long, text string, doc long, seeds string")
    want = brute_shared(rows, 40)
    spans = SharedSpans(df, length=40)
    assert {r.doc_id for r in spans.documents().collect()} == set(want)
    assert {r.doc_id: r.shared_chars for r in spans.characters().collect()} == want
    texts = dict(rows)
    for r in spans.passages().collect():
        assert 0 <= r.start < r.end <= len(texts[r.doc_id]) and 20 <= r.longest <= r.matched <= r.end - r.start
    empty = SharedSpans(df.limit(0), length=40)
    assert empty.documents().count() == 0 and empty.characters().count() == 0 and empty.passages().count() == 0


def test_passages_of_documents_chained_with_others(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    boilerplate = [text(30) for _ in range(12)]
    rows = [(1, "".join(text(20) + b for b in boilerplate))]
    for i, b in enumerate(boilerplate):  # a pair shares 42 characters, of which 30 are in the first document as well
        run = text(6) + b + text(6)
        rows += [(10 + 2 * i, text(50) + run + text(50)), (11 + 2 * i, text(70) + run + text(30))]
    spans = SharedSpans(spark.createDataFrame(rows, "doc_id long, text string"), length=40)
    assert {r.doc_id for r in spans.documents().collect()} == set(range(10, 34))
    got = {(r.doc_id, r.partner_id): r for r in spans.passages().filter("end - start >= 40").collect()}
    texts = dict(rows)
    for i in range(12):
        for a, b in ((10 + 2 * i, 11 + 2 * i), (11 + 2 * i, 10 + 2 * i)):
            r = got[a, b]
            assert r.longest >= 42 and texts[a][r.start : r.end] == texts[b][r.partner_start : r.partner_end]


def test_a_full_filter_changes_nothing(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab c") for _ in range(150))) for i in range(40)]
    rows.append((99, rows[3][1][20:120]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in SharedSpans(df, length=40, bits=64).documents().collect()} == set(brute_shared(rows, 40)) == {3, 99}


def test_every_window_holds_a_seed():
    rng = random.Random(4)
    for t in ("".join(rng.choice("abc") for _ in range(700)), "a" * 700, "ab" * 350):
        _, pos, h = seeds([t, "short", t], 50, 20)
        pos = pos[: len(pos) // 2]
        assert all(any(s <= p <= s + 30 for p in pos) for s in range(len(t) - 50 + 1))
    assert len(seeds(["", "x"], 50, 20)[0]) == 0 and len(grams(np.zeros(3, np.uint32), 5)) == 0


def test_chains_are_collinear_and_complete():
    x, y = np.array([0, 10, 20, 500, 30, 5]), np.array([100, 110, 121, 300, 20, 104])
    chains = chain(x, y, k=20, gap=0.1)
    assert sorted(i for members, _ in chains for i in members) == list(range(6))
    for members, _ in chains:
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(members, members[1:]))
    assert max(chains, key=lambda c: c[1])[0] == [0, 5, 1, 2]
    assert chain(np.zeros(0, int), np.zeros(0, int)) == []


def test_align_widens_and_measures():
    a, b = "..hello old world!!", "xxhello new world??"
    assert align(a, b, 2, 7, 2, 7)[:4] == (2, 8, 2, 8)
    start, end, _, _, matched, longest = align(a, b, 2, 17, 2, 17)
    assert (start, end) == (2, 17) and matched >= 12 and longest == 6




def test_operators_on_plain_frames_find_the_package(tmp_path):
    """The package on no worker's path, and frames that the caller made."""
    import subprocess
    import sys

    import truthframe

    root = os.path.dirname(os.path.dirname(os.path.abspath(truthframe.__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from truthframe.session import get_spark
from truthframe.llm.splitting import split_oversized
from truthframe.llm.terms import term_frequencies
spark = get_spark("alone", "local[2]", 2)
df = spark.createDataFrame([(1, str([["a%d" % i, "is", "b"] for i in range(300)]))], "row_id long, body string")
print(split_oversized(df).count() > 1, term_frequencies(df).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip() == "True 302", out.stderr[-2000:]
