"""Problems 2, 4, 6: overlaps, related splits, near duplicates; against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from truthframe.llm.near import exact_pairs, near_groups, parity, region_pairs
from truthframe.llm.contents import contents, distinct_contents
from truthframe.llm.overlap import cross_overlaps, overlap_classes
from truthframe.llm.related import anneal, pattern_codes, related_groups, related_splits, split_report, university_numbers


def corpus(seed, families=25, sizes=(5, 6, 8, 12, 30, 70, 90, 130)):
    """Sets of triples with near copies on both sides of the threshold."""
    rng = random.Random(seed)
    fresh = lambda: (f"E{rng.randrange(10**9)}", "is", f"C{rng.randrange(4)}")
    common = [(f"Common{i}", "SubClassOf", "Thing") for i in range(40)]
    out = []
    for _ in range(families):
        n = rng.choice(sizes)
        base = list({*rng.sample(common, min(n // 3, 40)), *(fresh() for _ in range(n))})[: max(n, 5)]
        out.append(base)
        for share in (0.0, 0.05, 0.1, 0.12, 0.2, 0.3):
            edits = round(len(base) * share)
            kept = rng.sample(base, len(base) - edits)
            out.append(kept + [fresh() for _ in range(rng.randrange(edits + 1))])
    rng.shuffle(out)
    return [s for s in out if len(set(s)) >= 5]


def similar(a, b):
    a, b = set(a), set(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def body(triples, rng):
    triples = [list(t) for t in triples]
    rng.shuffle(triples)
    return str(triples)


DIRTY = [(9001, None), (9002, ""), (9003, "[['a'"), (9004, "[['a', 'b', 'c']]")]


def test_near_groups_equal_brute_force(spark):
    rng, sets = random.Random(3), corpus(1)
    rows = [(i, body(s, rng)) for i, s in enumerate(sets)]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + rows[:3] + DIRTY], "row_id long, body string, cid long, n int")
    got = near_groups(df).collect()
    assert {(r.first_row_id, r.row_id) for r in got} == {(root[i], i) for i in range(len(sets))} and len(got) == len(sets)
    assert {r.row_id: r.copies for r in got}[0] == 1 + (0 in range(3)) + sum(set(sets[i]) == set(sets[0]) for i in range(1, len(sets)))
    assert near_groups(df.limit(0)).count() == 0


def test_a_dense_region_is_linked_without_all_pairs(spark):
    rng = random.Random(4)
    base = [(f"E{i}", "is", "C") for i in range(30)]
    rows = [(i, body(base + [(f"N{i}", "is", f"D{i}")], rng)) for i in range(300)]
    got = near_groups(spark.createDataFrame(rows, "row_id long, body string")).collect()
    assert len(got) == 300 and {r.first_row_id for r in got} == {0}


def test_isolated_links_in_a_large_family_are_found(spark):
    rng = random.Random(7)
    core = [(f"E{i}", "is", "C") for i in range(15)]
    rows = []
    for i in range(10_000):  # each shares 16 of 20 triples with one other, 15 of 21 with the rest
        rows.append((i, body([*core, (f"P{i // 2}", "is", "C"), *((f"N{i}", "is", f"D{k}") for k in range(2))], rng)))
    got = near_groups(spark.createDataFrame(rows, "row_id long, body string").repartition(8)).collect()
    assert {(r.first_row_id, r.row_id) for r in got} == {(i // 2 * 2, i) for i in range(10_000)}


def test_exact_pairs_miss_none(spark):
    sets = [sorted({hash(t) for t in s}) for s in corpus(8)]
    rows = [(i, len(s), i, s) for i, s in enumerate(sets)]
    got = exact_pairs(spark.createDataFrame(rows, "cid long, n int, of long, triples array<long>"), 4, 5).collect()
    want = {(i, j) for j in range(len(sets)) for i in range(j) if similar(sets[i], sets[j])}
    assert want and want <= {(r.a, r.b) for r in got}


def test_region_pairs_of_small_runs_are_all_pairs():
    keys = np.array([[0, 1, 1], [0, 1, 2], [0, 1, 3], [0, 2, 1], [1, 2, 1]])
    i, j, spoke = region_pairs(keys, region=3)
    assert {*zip(i.tolist(), j.tolist())} == {(0, 1), (0, 2), (1, 2)} and not spoke.any()
    assert all(len(x) == 0 for x in region_pairs(np.zeros((0, 3), int)))


def test_region_pairs_deepen():
    keys = np.array([[0, 1, k // 2] for k in range(40)])
    i, j, spoke = region_pairs(keys, region=4, neighbours=2)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist())} == {(k, k + 1) for k in range(39)} and not spoke.any()
    i, j, spoke = region_pairs(np.zeros((9, 3), int), region=4, neighbours=2)
    assert {*zip(i[spoke].tolist(), j[spoke].tolist())} == {(0, k) for k in range(1, 9)} and (j - i)[~spoke].max() == 2


def test_parity_differs_in_no_more_bits_than_triples():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 50, dtype=np.uint64)
    b = np.concatenate((a[5:], rng.integers(0, 2**63, 3, dtype=np.uint64)))
    pa, pb = parity(np.sort(a), np.array([0, 50])), parity(np.sort(b), np.array([0, 48]))
    assert np.bitwise_count(pa ^ pb)[0] <= 8


def test_cross_overlaps_equal_brute_force(spark):
    rng, sets = random.Random(5), corpus(2)
    ours = [(i, body(s, rng)) for i, s in enumerate(sets) if i % 2]
    theirs = [(10_000 + i, body(s, rng), ("eval", "test", None)[i % 3]) for i, s in enumerate(sets) if i % 2 == 0]
    want = {(i, 10_000 + j, ("eval", "test", None)[j % 3]) for i in range(1, len(sets), 2) for j in range(0, len(sets), 2) if similar(sets[i], sets[j])}
    train = spark.createDataFrame([(*r, 0) for r in ours + ours[:5] + DIRTY], "row_id long, body string, cid long")
    other = spark.createDataFrame([(*r, 0) for r in theirs + theirs[:5] + [(*d, "eval") for d in DIRTY]], "row_id long, body string, split_name string, n int")
    got = cross_overlaps(train, other).collect()
    assert {(r.train_row_id, r.row_id, r.split_name) for r in got} == want and len(got) == len(want)
    assert all(r.similarity >= 0.8 and r.overlap >= 0.8 and r.train_overlap >= 0.8 for r in got)
    assert cross_overlaps(train.limit(0), other).count() == 0 and cross_overlaps(train, other.limit(0)).count() == 0


@pytest.mark.parametrize("n", [100, 5_000, 20_000, 50_000])
def test_overlaps_of_long_records_equal_brute_force(spark, n):
    rng = random.Random(n)
    ours, theirs = [], []
    for family in range(3):
        base = [(f"E{family}_{i}", "is", "C") for i in range(n)]
        for k, edits in enumerate((n // 9, n // 9 + 2, n * 15 // 185, n // 20)):  # substituted triples: 0.8, just below, 0.85, 0.9
            gone = set(rng.sample(range(n), edits))
            theirs.append([*(t for i, t in enumerate(base) if i not in gone), *((f"X{family}_{k}_{i}", "is", "D") for i in range(edits))])
        ours.append(base)
    schema = "row_id long, body string, split_name string"
    train = spark.createDataFrame([(i, body(s, rng), None) for i, s in enumerate(ours)], schema).repartition(4)
    other = spark.createDataFrame([(100 + i, body(s, rng), "eval") for i, s in enumerate(theirs)], schema).repartition(4)
    want = {(i, 100 + j) for i, a in enumerate(ours) for j, b in enumerate(theirs) if similar(a, b)}
    assert len(want) == 9 and {(r.train_row_id, r.row_id) for r in cross_overlaps(train, other).collect()} == want


def test_overlap_classes_stand_for_their_copies(spark):
    rng, sets = random.Random(9), corpus(6, 6)
    ours = [(i, body(s, rng)) for i, s in enumerate(sets + sets[:8])]
    theirs = [(1000 + i, body(s, rng), "eval") for i, s in enumerate(sets[3:20] + sets[5:9])]
    train, other = spark.createDataFrame(ours, "row_id long, body string"), spark.createDataFrame(theirs, "row_id long, body string, split_name string")
    pairs, members = (df.collect() for df in overlap_classes(train, other))
    same = lambda rows, k: {r[0] for r in rows if set(eval(r[1])) == set(eval(rows[k][1]))}
    full = {(r.train_row_id, r.row_id) for r in cross_overlaps(train, other).collect()}
    copies = {r.train_class: same([(i, b.replace("[", "(").replace("]", ")")) for i, b in ours], r.train_class) for r in pairs}
    of = {}
    for m in members:
        of.setdefault(m["class"], set()).add(m.row_id)
    assert {(a, b) for r in pairs for a in copies[r.train_class] for b in of[r["class"]]} == full and full
    assert all(r.train_copies == len(copies[r.train_class]) and r.copies == len(of[r["class"]]) for r in pairs)
    assert [df.count() for df in overlap_classes(train.limit(0), other)] == [0, 0]


def test_contents_of_equal_bits_are_told_apart(spark):
    rng, sets = random.Random(10), [s for s in corpus(7, 3)]
    rows = contents(spark.createDataFrame([(i, body(s, rng)) for i, s in enumerate(sets)], "row_id long, body string"))
    keyed, records = distinct_contents(rows, "cid & 1L")
    n = len({frozenset(s) for s in sets})
    assert records.count() == n and keyed.select("cid", "content").distinct().count() == n


NAMES = [
    ("University3_Department5_module1.jsonl", None, [3]),
    ("university37_department6_Module2.owl", "None", [37]),
    ("uewip_univ-0013/dept-01/mod-3.owl", "UEWIP", [13]),
    ("UE_U13_D7_M4.ttl", "UE", [13]),
    ("Department15.University0.module5.rdf", "nan", [0]),
    ("University%2038_Department%2016_module6.owl", "", [38]),
    ("EID_UNIV_1_module_7_D1.jsonl", "EID", [1]),
    ("JOINT_univ-0005+univ-0007__module8.jsonl", None, [5, 7]),
    ("University7-University41_joint_module9.owl", None, [7, 41]),
    ("U18_U19_M10.ttl", None, [18, 19]),
    ("University19_Department1_module11.jsonl", "OILWPI (from University50)", [19, 50]),
    ("University2_Department1_module12.jsonl", "OOR<-univ-0003", [2, 3]),
    ("University4_Department1_module13.jsonl", "AIO @ U0008", [4, 8]),
    (None, "AIO", []),
    (None, "AIO @ U8", [8]),
    ("notes_module14%.jsonl", None, []),
]


def test_university_numbers_and_groups(spark):
    rows = [(i, f, p) for i, (f, p, _) in enumerate(NAMES)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows + rows[:1]], "row_id long, file_name string, injected_pattern string, key long, node long")
    keys = university_numbers(F.col("file_name"), F.col("injected_pattern"))
    assert {r.row_id: r.k for r in df.select("row_id", keys.alias("k")).collect()} == {i: k for i, (_, _, k) in enumerate(NAMES)}
    got = {r.row_id: r.group_key for r in related_groups(df, "row_id", keys).collect()}
    assert got == {0: 2, 1: 37, 2: 13, 3: 13, 4: 0, 5: 38, 6: 1, 7: 5, 8: 5, 9: 18, 10: 18, 11: 2, 12: 4, 13: None, 14: 4, 15: None}
    assert related_groups(df.limit(0), "row_id", keys).count() == 0


def test_pattern_codes(spark):
    texts = [None, "", "None", "nan", "aio ", " UE,OIL", "OILWPI (from University18)", "OOR<-univ-0006", "AIO @ U5"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "p string").select(pattern_codes(F.col("p"))).collect()]
    assert got == [["NONE"]] * 4 + [["AIO"], ["OIL", "UE"], ["OILWPI"], ["OOR"], ["AIO"]]


def test_related_splits_keep_groups_and_shares(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        u = 0 if i % 3 == 0 else rng.randrange(1, 200)  # a third of all rows in one group
        name = f"University{u}_module{i}.jsonl" if i % 50 else f"U{u}_U{rng.randrange(1, 200)}_M{i}.ttl"
        rows.append((i, name if i % 20 else None, rng.choice([None, "AIO", "ue ", "AIO,UE", "EID"])))
    df = spark.createDataFrame(rows, "row_id long, file_name string, injected_pattern string")
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    out = related_splits(df, targets, chains=4, steps=4000)
    got = out.collect()
    assert len(got) == 1500 and {r.split_name for r in got} == {"train", "validation", "test"}
    at = {}
    for r in got:
        assert r.group_key is None or at.setdefault(r.group_key, r.split_name) == r.split_name
    report = split_report(out, targets).collect()
    assert all(abs(r.share - r.target_share) < (0.01 if r.code == "ALL" else 0.04) for r in report)
    assert related_splits(df.limit(0), targets).count() == 0
    with pytest.raises(ValueError):
        related_splits(df, targets.limit(0))


def test_annealing_never_ends_worse_than_it_starts():
    units = np.random.default_rng(1).integers(0, 20, (40, 3)).astype(float)
    start = np.zeros(40, int)
    first, _ = anneal(units, start, np.array([0.5, 0.5]), 0, 1)
    last, at = anneal(units, start, np.array([0.5, 0.5]), 2000, 1)
    assert last < first / 100 and set(at) == {0, 1}


def test_a_dense_region_worked_off_in_parts_stays_one_group(spark, monkeypatch):
    from truthframe.llm import near

    monkeypatch.setattr(near, "BUFFER", 500)
    rng = random.Random(14)
    base = [(f"E{i}", "is", "C") for i in range(30)]
    rows = [(i, body(base + [(f"N{i}", "is", f"D{i}")], rng)) for i in range(25_000)] + [(30_000 + i, body([(f"X{i // 2}_{k}", "is", "C") for k in range(10)] + [(f"Y{i}", "is", "D")], rng)) for i in range(200)]
    got = near_groups(spark.createDataFrame(rows, "row_id long, body string").repartition(4)).collect()
    want = {(0, i) for i in range(25_000)} | {(30_000 + i // 2 * 2, 30_000 + i) for i in range(200)}
    assert {(r.first_row_id, r.row_id) for r in got} == want
