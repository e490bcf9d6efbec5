"""Near-duplicate groups and the pipeline's stage on repeated ids, nulls, short texts and shared passages."""

import collections
import itertools

import numpy as np
import pytest

from apchecks.llm import parity_join

from .test_brute_force import split

SCHEMA = "doc_id long, text string"


def groups_of(rows, k, percent):
    """Row groups by all pairs: for each row the smallest row number reachable, and its set's size."""
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append(frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset({tuple(w)} if w else ()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            parent[root(a)] = root(b)
    return [root(i) for i in range(len(rows))], [len(s) for s in sets]


def expected(rows, k, percent):
    root, size = groups_of(rows, k, percent)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return collections.Counter((i, n, least[r]) for (i, _), n, r in zip(rows, size, root))


def check(spark, rows, k=5, percent=80):
    got = parity_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), k, percent).collect()
    assert collections.Counter(map(tuple, got)) == expected(rows, k, percent)


def words(seed, n, base=None, edits=0):
    rng = np.random.default_rng(seed)
    w = list(base) if base else [f"w{x}" for x in rng.integers(0, 10**6, n)]
    for at in rng.integers(0, len(w), edits):
        w[at] = f"e{rng.integers(0, 10**6)}"
    return w


def test_repeated_ids_nulls_and_empty_texts(spark):
    a, b = words(1, 60), words(2, 60)
    near_a, near_b = words(3, 60, a, 1), words(4, 60, b, 1)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near_a)), (3, " ".join(near_b)), (None, " ".join(words(5, 60, a, 1)))]
    rows += [(None, "only rows without an id here now"), (None, "Only rows without an ID here now"), (7, None), (7, ""), (8, " \t\n"), (None, None)]
    rows += [(9, "same row twice and twice"), (9, "same row twice and twice"), (-5, "Same Row twice and twice")]
    check(spark, rows)
    got = parity_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert parity_join.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_texts_and_a_shared_passage(spark):
    rng = np.random.default_rng(8)
    rows, common = [], words(10, 60)
    for n in range(1, 12):  # sets of one shingle and a few more, in small families
        for family in range(8):
            base = words(100 * n + family, n)
            rows += [(len(rows) + j, " ".join(words(j, n, base, j % 2))) for j in range(3)]
    for i in range(120):  # boilerplate of every share, around it texts of their own
        own = words(5000 + i, int(rng.integers(5, 120)))
        rows.append((len(rows), " ".join(own[: len(own) // 2] + common + own[len(own) // 2 :])))
    for i in range(40):
        rows.append((len(rows), " ".join(words(7000 + i, 0, common, i % 4))))
    check(spark, rows)
    check(spark, rows, 3, 90)


def test_blocks_of_disjoint_sets_hardly_meet():
    """Empty and thin blocks bring few sets together, once each leaves out its most frequent shared blocks."""
    rng = np.random.default_rng(4)
    for size in (1, 4, 10, 30, 33, 40, 60, 100, 200, 1000):
        values = np.sort(rng.integers(1, 2**63, (300, size)).astype(np.uint64), axis=1).ravel()
        for percent in (80, 90):
            bucket, row, grp = parity_join._entries_of(values, np.arange(301) * size, percent)
            assert len(row) <= 300 * max(40, 2 * size)
            count = collections.Counter(bucket.tolist())
            of = collections.defaultdict(list)
            for b, r, g in zip(bucket.tolist(), row.tolist(), grp.tolist()):
                if count[b] > 1:
                    of[r, g].append((-count[b], b))
            members = collections.Counter(b for (_, g), held in of.items() for _, b in sorted(held)[(g >> 2) - 1 :])
            assert max(members.values(), default=0) <= 12, (size, percent)


def test_keep_one_decides_row_by_row(spark):
    a, b = " ".join(words(1, 60)), " ".join(words(2, 60))
    near_b = " ".join(words(4, 60, b.split(), 1))
    rows = [(0, b, "x", 1), (1, a, "x", 2), (1, near_b, "y", 3), (2, a, None, 4), (None, None, "x", 5), (None, None, "x", 6), (None, b, "z", 7)]
    rows += [(None, "alone and without an id", "z", 8), (4, "one row three times", "q", 9), (4, "one row three times", "q", 9), (4, "one row three times", "r", 9)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, source string, row_key int").repartition(3)
    kept = parity_join.keep_one(docs).collect()
    assert sorted(r["row_key"] for r in kept) == [1, 2, 5, 6, 8, 9]
    assert kept[0].__fields__ == docs.columns
    assert parity_join.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_hot_buckets_are_dealt_without_loss(spark, percent, monkeypatch):
    monkeypatch.setattr(parity_join, "HOT_SAMPLE", 50)
    monkeypatch.setattr(parity_join, "HOT_COUNT", 3)
    monkeypatch.setattr(parity_join, "MORE_PIVOTS", 2)
    monkeypatch.setattr(parity_join, "CHUNK", 16)
    base = words(3, 150)
    rows = [(i, " ".join(words(i, 150, base, i % 14))) for i in range(200)]
    check(spark, rows, 5, percent)
