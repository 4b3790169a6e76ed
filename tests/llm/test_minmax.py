"""Near-duplicate groups against a brute-force join of all pairs."""

import random

import numpy as np
import pytest

from unblend.llm import components, minmax


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        own = set() if not w else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}
        sets.setdefault(i, []).append(own)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for k, (i, s) in enumerate(flat):
        for j, u in flat[:k]:
            both = len(s & u)
            if both and 100 * both >= percent * (len(s) + len(u) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, sets


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    base, hot = [make(rng.randint(1, 80)) for _ in range(12)], make(60)
    rows = []
    for i in range(n):
        w = list(hot if rng.random() < 0.4 else rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.1:
            w = make(30) + w[:20]
        rows.append((i, rng.choice([" ", "\n", "\t\t"]).join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, rows[3][1].upper()), (n + 4, "one"), (n + 5, "ONE"), rows[0], rows[0]]


@pytest.mark.parametrize("width,percent,seed", [(3, 85, 1), (5, 80, 2), (1, 90, 3)])
def test_groups_match_brute_force(spark, width, percent, seed):
    rows = texts(seed, 250)
    want, sets = brute(rows, width, percent)
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS key", "0 AS n")
    got = minmax.near_duplicates(table, width=width, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id]
        assert r.n_shingles == len(sets[r.doc_id][0])
        assert r.kept == (r.doc_id == r.component_id)
    kept = minmax.keep_one(table, width=width, percent=percent)
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == table.columns


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")]
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got if r.doc_id) == [(False, 1, True)]
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert minmax.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    hasher = minmax.MinMax(200, 5, 0)
    a, b = hasher.signature(pool[:2000]), hasher.signature(pool[500:2500])
    assert abs(float((a == b).mean()) - 1500 / 2500) < 0.06


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (6, 5), (None, 1)] + [(100 + k, 101 + k) for k in range(40)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    found = {r.id: r.component for r in got.collect()}
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {100 + k: 100 for k in range(41)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
