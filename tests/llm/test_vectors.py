"""Part codes and whitening against numpy on whole tables, and their odd cases."""

import random

import numpy as np
import pytest

from unblend.llm import codes, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, no string, x int, id int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "n", 1, 2) for i, v, l in rows], SCHEMA)


@pytest.fixture(scope="module")
def some():
    """Vectors of eight dimensions, a third of them one vector, and unusable ones."""
    rng = np.random.default_rng(3)
    rows = [(1000 - 3 * k, [round(float(v), 3) for v in rng.normal(0, 0.3, 8) * np.arange(1, 9)], int(k % 4) or None) for k in range(200)]
    rows += [(5000 + k, rows[7][1], 2) for k in range(100)]
    odd = [None, [], [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [float("inf")] + [0.0] * 7, [0.5] * 4]
    return rows + [(-k, v, 1) for k, v in enumerate(odd)], rows


def plain_codes(rows, scale, parts, entries, rounds):
    """The contract step by step with Python integers."""
    rows = sorted(rows, key=lambda r: r[0])
    x = [[int(np.floor(scale * np.float32(v).astype(float))) for v in r[1]] for r in rows]
    w = len(x[0]) // parts
    cut = lambda v, p: tuple(v[p * w : p * w + w])
    books = [[cut(v, p) for v in x[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    best = lambda v, p: min((far(cut(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = {}
            for v in x:
                own.setdefault(best(v, p)[1], []).append(cut(v, p))
            new.append([tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if k in own else c for k, c in enumerate(books[p])])
        books = new
    found = [[best(v, p) for p in range(parts)] for v in x]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(rows, errors):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted((r[0], [k for _, k in f], e, by[r[2]]) for r, f, e in zip(rows, found, errors)), books


def test_codes(spark, some):
    got, books = codes.compress_vectors(table(spark, some[0]).repartition(3), scale=64, parts=4, entries=10, rounds=2)
    want, plain = plain_codes(some[1], 64, 4, 10, 2)
    assert sorted((r.vec_id, r.codes, r.error, r.label_error) for r in got.collect()) == want
    assert [[tuple(e) for e in b] for b in books.tolist()] == plain


def test_codes_of_few_and_repeated_rows(spark):
    rows = [(1, [0.0, 1.0], None), (1, [0.0, 1.0], None), (None, [5.0, 5.0], 3)]
    got, books = codes.compress_vectors(table(spark, rows), scale=2, parts=2, entries=64)
    assert sorted((r.vec_id or 0, r.codes, r.error, r.label_error) for r in got.collect()) == [(0, [2, 2], 0, 0), (1, [0, 0], 0, 0), (1, [0, 0], 0, 0)]
    assert books.tolist() == [[[0], [0], [10]], [[2], [2], [10]]]


def test_empty_and_too_large(spark, some):
    none, books = codes.compress_vectors(table(spark, []))
    assert none.count() == 0 and books.size == 0 and none.columns == ["vec_id", "codes", "error", "label_error"]
    with pytest.raises(ValueError):
        codes.compress_vectors(table(spark, [(1, [1e9] * 16, 1)]))
    assert whiten.whiten(table(spark, [])).count() == 0
    assert whiten.whiten(table(spark, [(1, [1.0, 2.0], 1)])).count() == 0


def test_nearest_takes_the_lower_entry_and_works_in_pieces(monkeypatch):
    monkeypatch.setattr(codes, "AT_ONCE", 1)
    code, error = codes.nearest(np.array([[1], [3], [2]]), np.array([[0], [2], [2], [4]]))
    assert code.tolist() == [0, 1, 1] and error.tolist() == [1, 1, 0]


def dense(rows, scale, shift):
    x = np.floor(scale * np.array([r[1] for r in rows], np.float32).astype(float)) + shift
    return x, x - x.mean(0)


def test_whitening(spark, some):
    rows = some[1]
    got = whiten.whiten(table(spark, some[0]).repartition(3), components=5).collect()
    x, c = dense(rows, 1024, 100_000)
    e, u = np.linalg.eigh(c.T @ c / len(c))
    e, u = e[::-1], u[:, ::-1]
    ids = [r[0] for r in rows]
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, k) for i in ids for k in range(1, 6))
    z = {(r.vec_id, r.component): r.whitened for r in got}
    for k in range(5):
        own = np.array([z[i, k + 1] for i in ids])
        want = c @ u[:, k] / np.sqrt(e[k])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-9
    n, s = len(rows), x.sum(0).astype(int)
    far = {i: sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for i, row in zip(ids, x)}
    for r in got:
        assert r.n == n and int(r.deviation) == far[r.vec_id] and r.identity_error < 1e-10
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-10


def test_directions_without_variance_are_left_out(spark):
    rng = random.Random(1)
    rows = [(k, [a := rng.random(), 2 * a, 0.25], None) for k in range(40)]
    got = whiten.whiten(table(spark, [(i, [float(int(v[0] * 64)) / 64, float(int(v[0] * 64)) / 32, 0.25], n) for i, v, n in rows])).collect()
    assert {r.component for r in got} == {1} and len(got) == 40
    same = [(k, [1.0, 2.0], None) for k in range(5)]
    assert whiten.whiten(table(spark, same)).count() == 0


def test_exact_deviation_beyond_64_bits(spark):
    rows = [(k, [2.0**30 * (-1) ** k, 0.0], None) for k in range(9)]
    got = whiten.whiten(table(spark, rows)).collect()
    x, _ = dense(rows, 1024, 100_000)
    s = [sum(int(v) for v in col) for col in x.T]
    assert {int(r.deviation) for r in got} == {sum((9 * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x}


@pytest.mark.parametrize("dims,wanted", [(3, 3), (60, 8), (200, 5)])
def test_lobpcg_on_close_eigenvalues(dims, wanted):
    rng = np.random.default_rng(dims)
    q = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    values = np.sort(np.concatenate([[5.0, 5.0 - 1e-6, 3.0][: min(3, dims)], rng.uniform(0.1, 1.0, dims - 3)]))[::-1]
    v = (q * values) @ q.T
    e, x, vx = whiten.lobpcg(lambda c: v @ c, dims, wanted)
    assert np.abs(e - values[:wanted]).max() < 1e-11
    assert np.abs(v @ x - x * e).max() < 1e-11 and np.abs(x.T @ x - np.eye(wanted)).max() < 1e-12
