"""Exact dedup, mixing and chat formatting against plain Python, and their odd cases."""

import hashlib
import random

import pytest

from unblend.llm import chat, digest_tree, mixing

DOCS = "doc_id long, text string, source string, run string, __id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", None) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def some():
    rng = random.Random(1)
    texts = ["", None, "a b", "c" * 70_000, " a b", *(f"word{k} " * rng.randint(1, 9) for k in range(20))]
    rows = [(k, rng.choice(texts), rng.choice(["s1", "s2", "s3", None])) for k in range(300)]
    return rows + [(900 + k, "hot text", "s1") for k in range(200)] + [rows[5], rows[5]]


@pytest.mark.parametrize("keep,pick", [("smallest", min), ("largest", max)])
def test_exact_dedup(spark, some, keep, pick):
    got = digest_tree.exact_dedup(docs(spark, some), keep=keep, fan_in=4, rounds=3).collect()
    assert len(got) == len(some)
    groups = {}
    for i, t, _ in some:
        groups.setdefault(t or "", []).append(i)
    by_id = {i: t or "" for i, t, _ in some}
    for r in got:
        same = groups[by_id[r.doc_id]]
        assert (r.keep_id, r.group_size) == (pick(same), len(same))
        assert r.text_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest()
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)


def test_keep_distinct_keeps_columns_and_one_of_each(spark, some):
    got = digest_tree.keep_distinct(docs(spark, some))
    assert got.columns == ["doc_id", "text", "source", "run", "__id"]
    assert sorted(r.text or "" for r in got.collect()) == sorted({t or "" for _, t, _ in some})


def test_empty_tables(spark):
    none = docs(spark, [])
    assert digest_tree.exact_dedup(none).count() == 0
    assert digest_tree.keep_distinct(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def plain_targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Hand out by weight and reshare what is over, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left = {}, set(names)
    rest = share * sum(sizes.values())
    while left:
        unit = rest / sum(w[s] for s in left)
        over = [s for s in left if unit * w[s] > cap * sizes[s]]
        if not over:
            target |= {s: unit * w[s] for s in left}
            break
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
            left.remove(s)
    return target


def test_mix(spark, some):
    got = mixing.mix(docs(spark, some), buckets=14).collect()
    assert len(got) == len(some)
    size = lambda t: len((t or "").split())
    totals = {}
    for _, t, s in some:
        totals[s] = totals.get(s, 0) + size(t)
    want = plain_targets(totals)
    source = {i: s for i, _, s in some}
    taken, longest = {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == totals[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r.size and r.taken == r.size * r.copies
        taken[s] = taken.get(s, 0) + r.taken
        longest[s] = max(longest.get(s, 0), r.size)
    for s in totals:
        assert abs(taken[s] - want[s]) <= longest[s]
    again = mixing.mix(docs(spark, some[::-1]), buckets=14).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mixed_rows_repeat_documents(spark):
    rows = [(k, "w " * 10, "big" if k < 90 else "tiny") for k in range(100)]
    table = docs(spark, rows)
    plan = {r.doc_id: r.copies for r in mixing.mix(table).collect()}
    got = [r.doc_id for r in mixing.mixed_rows(table).collect()]
    assert sorted(got) == sorted(i for i, n in plan.items() for _ in range(n))


def test_mixed_rows_with_repeated_and_null_ids(spark):
    rows = [(k % 9 if k % 4 else None, f"w{k} " * (1 + k % 3), ["big", "big", "small", None][k % 4 - k % 2]) for k in range(120)]
    rows += [(5, "same text", "small")] * 4
    table = docs(spark, rows)
    plan, got = mixing.mix(table).collect(), mixing.mixed_rows(table)
    assert got.columns == table.columns
    got = [(r.doc_id, r.text, r.source) for r in got.collect()]
    assert len(got) == sum(r.copies for r in plan)
    count = lambda pairs: {k: sum(n for j, n in pairs if j == k) for k, _ in pairs}
    want = count([((r.doc_id, r.size), r.copies) for r in plan if r.copies])
    assert count([((i, len(t.split())), 1) for i, t, _ in got]) == want
    assert set(got) <= set(rows) and any(i is None for i, _, _ in got)
    again = mixing.mixed_rows(docs(spark, rows[::-1])).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(((r.doc_id, r.text, r.source) for r in again), key=key) == sorted(got, key=key)


CHATS = [
    (1, 0, "system", "be # kind"), (1, 1, "user", "hi \\ <b>"), (1, 2, "user", "again </turn> ok"), (1, 3, "assistant", "### x"),
    (1, 4, "assistant", ""), (1, 5, "assistant", None), (2, 0, "assistant", "only"), (3, 1, None, "\\h\\l\\b"), (3, 0, "a: </role>b", "é\n\n"),
    (None, 0, "user", "lost"), (4, None, "user", "x"), (4, 0, "user", "y"), (4, 0, "user", "y"), (5, 0, "assistant", "z" * 50_000),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").selectExpr("*", "'q' AS p", "0 AS i")
    read = chat.read_chats(chat.format_chats(turns))
    got = {r.conv_id: r for r in read.withColumn("loss", chat.loss_text(read["formatted"], read["loss_spans"])).collect()}
    want = {}
    for c, t, role, text in sorted(CHATS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, rows in want.items():
        assert [tuple(t) for t in got[c].turns] == rows
        assert got[c].loss == "".join(t for r, t in rows if r == "assistant")
    assert got[1].formatted.count("### ") == 3  # turns of one role in a row share a block
