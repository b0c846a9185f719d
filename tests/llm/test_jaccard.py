"""Near-duplicate classes against a brute-force version."""

import random
import re

import pytest

from feedlab.llm import jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, p, q):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and q * len(a & b) >= p * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, key), key)
    return {key: (len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)}


def corpus(seed, families=6, members=25, singles=40, big=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = []
    for size in [members] * families + [big] * bool(big):
        base = text(rng.choice([8, 14, 40, 90, 150]) if size == members else 90)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[i], rng.choice(vocabulary)]])
            out.append(" ".join(w))
    common = " ".join(text(12))
    out += [" ".join(text(rng.randrange(1, 60))) + (" " + common if rng.random() < 0.5 else "") for _ in range(singles)]
    out += [out[0].upper(), "\n" + out[1] + " ", "", " \n\t ", "one", "one", "two words", None]
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed,big,k,p,q", [(1, 0, 4, 85, 100), (2, 130, 4, 85, 100), (3, 0, 5, 4, 5)])
def test_classes_equal_brute_force(spark, seed, big, k, p, q):
    rows = corpus(seed, big=big)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.cluster(df, k=k, p=p, q=q).collect()}
    assert got == brute(rows, k, p, q)


def test_long_lists_go_through_leaders(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 6)
    monkeypatch.setattr(jaccard, "PAIRS_A_SET", 0)
    rows = corpus(5, families=3, big=60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.cluster(df).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_lists_above_the_constant_are_never_expanded(spark, monkeypatch):
    assert max(jaccard._bound(0, 0), jaccard._bound(16_000_000, 1_000_000), jaccard._bound(0, 10**12)) <= 256
    for name, value in (("SHORT", 6), ("LONGEST", 12), ("PAIRS_A_SET", 10**9)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(5, families=3, big=60)
    used, inner = [], jaccard._shared_differences
    monkeypatch.setattr(jaccard, "_shared_differences", lambda *a: used.append(1) or inner(*a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 85, 100) and used


def test_empty_table_repeated_rows_and_null_keys(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, node string")
    assert jaccard.cluster(empty).count() == 0
    rows = [(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (3, "")]
    got = sorted((tuple(r) for r in jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (3, 0, 3)], key=str)


def test_entries_meet_for_all_similar_sets():
    import numpy as np

    rng = np.random.default_rng(4)
    starts, parts = jaccard.bands(85, 100, 400)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        h = int(rng.integers(0, len(a) // 5 + 2))
        drop = int(rng.integers(0, h + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[min(drop, len(a) - 1) :], rng.integers(0, 2**64, h - drop, dtype=np.uint64))))
        common = len(np.intersect1d(a, b))
        if 100 * common < 85 * (len(a) + len(b) - common) or common == len(a) == len(b):
            continue
        ka, kb = (int(np.searchsorted(starts, len(x), "right")) - 1 for x in (a, b))
        shared = [set(jaccard.entries(a, k, int(parts[k])).tolist()) & set(jaccard.entries(b, k, int(parts[k])).tolist()) for k in {ka, ka - 1} & {kb, kb - 1} if k >= 0 and parts[k] > 1]
        assert any(shared)


def test_a_large_family_ends_with_the_right_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 6)
    monkeypatch.setattr(jaccard, "LONGEST", 6)
    rows = corpus(8, families=0, singles=20, big=150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_lists_with_sets_in_common_are_one_group_and_linked_pairs_left_out(spark):
    lists = spark.createDataFrame([(a, n) for a in range(3) for n in range(a, a + 3)], "list long, node long")
    assert jaccard._grouped(lists, True).count() == 5  # lists with sets in common: one group, each set once
    label = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "node long, component long")
    assert sorted(tuple(r) for r in jaccard._unlinked_pairs(lists, label).collect()) == [(1, 3), (2, 3), (2, 4), (3, 4)]


def family(size, seed=3):
    """Texts of one base with one to eight words of their own each, so that most of the family is similar to few others."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    out = []
    for j in range(size):
        w = list(base)
        for e in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"n{j}x{e}"
        out.append((j, " ".join(w)))
    return out


def test_pairs_that_sketches_rule_out_are_no_rows(spark):
    rows = family(120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    label = spark.createDataFrame([], "node long, component long")
    lists = jaccard._nodes(df, "doc_id", "text", 5).selectExpr("0L AS list", "node")
    sets = jaccard._wanted_sets(df, "text", 5, lists.select("node").distinct())
    pairs = jaccard._unlinked_pairs(lists, label)
    got = sorted(map(tuple, jaccard._near_in_lists(lists, label, sets, 4, 5).collect()))
    assert got == sorted((min(r), max(r)) for r in map(tuple, jaccard._near(pairs, sets, 4, 5).collect()))
    assert 0 < 2 * len(got) < pairs.count() == 120 * 119 // 2


def test_next_lists_of_a_large_group_are_short(spark, monkeypatch):
    for name, value in (("SHORT", 16), ("LONGEST", 16)):
        monkeypatch.setattr(jaccard, name, value)
    rows = family(300)
    made, inner = [], jaccard._shared_differences

    def counted(groups, *rest):
        out = inner(groups, *rest)
        made.append((out.count(), groups.selectExpr("sum(size(differ))").first()[0]))
        return out

    monkeypatch.setattr(jaccard, "_shared_differences", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string"), k=5, p=4, q=5).collect()}
    assert got == brute(rows, 5, 4, 5)
    assert made and 3 * made[0][0] < made[0][1]  # of all differences, a small part is listed
