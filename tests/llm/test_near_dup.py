from collections import Counter

import pytest
from tests.llm.fixtures import documents, empty, table, words
from waypost.llm import near_dup


def brute(rows, k):
    """doc_id to (set size, smallest doc_id reachable), comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = words(t, fold=True)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("k", "few", "block"), [(2, 16, 256), (5, 0, 4), (2, 0, 3)])
def test_links_like_all_pairs(spark, k, few, block):
    rows = documents()
    got = near_dup.link(table(spark, rows), shingle_words=k, few=few, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_borderline_group_in_blocks(spark):
    """Near copies of which many are linked through others only."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randint(3, 9)):
            own[rng.randrange(100)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    got = {
        r.doc_id: (r.n_shingles, r.component_id)
        for r in near_dup.link(table(spark, rows), shingle_words=2, few=2, block=16).collect()
    }
    assert got == brute(rows, 2)


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (3, None), (3, "")]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.link(table(spark, rows)).collect())
    assert got == Counter({(5, 5, True): 2, (9, 5, False): 1, (None, None, True): 1, (3, 3, True): 2})
    assert near_dup.link(empty(spark)).count() == 0


def test_removal_keeps_columns_and_smallest_ids(spark):
    rows = documents()
    kept = near_dup.near_duplicates(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    truth = brute(rows, 5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in truth.items() if i == c)


def test_families_that_meet_in_buckets_only(spark):
    """Two large groups with passages in common, so their members meet in buckets without being alike."""
    import random

    rng = random.Random(8)
    shared = [f"s{i}" for i in range(70)]
    rows = []
    for family in range(3):
        base = [f"f{family}x{i}" for i in range(45)]
        for i in range(40):
            own = shared + base
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
            rows.append((family * 100 + i, " ".join(own)))
    want = brute(rows, 2)
    for few in (0, 1000):
        got = {
            r.doc_id: (r.n_shingles, r.component_id)
            for r in near_dup.link(table(spark, rows), shingle_words=2, few=few, block=8, bands=128, rows=1).collect()
        }
        assert got == want


def test_signatures_of_long_sets_are_the_same_in_groups(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    value, first = rng.integers(0, 2**64, 5000, dtype=np.uint64), np.array([0, 10, 10, 4000, 4001, 5000])
    whole = near_dup.super_min_hash(value, first, 128)
    monkeypatch.setattr(near_dup, "BIDDERS", 300)
    assert (near_dup.super_min_hash(value, first, 128) == whole).all()


def test_long_texts_and_extra_rows_without_id(spark):
    long = " ".join(f"w{i}" for i in range(700_000))
    rows = [
        (1, long), (2, long + " end"), (3, long[: len(long) // 2]), *[(None, "same text of a row without id")] * 300
    ]
    got = near_dup.link(table(spark, rows), shingle_words=2)
    assert got.filter("doc_id is null and kept").count() == 300
    assert {r.doc_id: r.component_id for r in got.filter("doc_id is not null").collect()} == {1: 1, 2: 1, 3: 3}
