"""Removal of repeated passages against a plain dictionary of all strings, and its parts."""

import hashlib
import random

import numpy as np
import pytest

from unblend.llm import phrases


def plain(docs, length):
    """(bytes, removed, runs, what is left) of each document: all strings of ``length`` in order of id and start."""
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        left = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, left)
    return out


def texts(seed, n):
    """Prose with shared passages of all lengths, edits inside them, copies, runs of few letters and periods."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(rng.randint(5, 120)) for _ in range(12)] + ["a" * 450, "ab" * 200, "abc" * 90 + "abd" * 60]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(shared) if rng.random() < 0.6 else prose(rng.randint(1, 80))
            if rng.random() < 0.3 and p:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice("xyz\n") + p[k + 1 :]
            cut = rng.randrange(len(p)) if p and rng.random() < 0.3 else 0
            parts.append(p[cut:])
        out.append(" ".join(parts))
    return out + out[:3] + ["", "x" * 99, "y" * 100, "y" * 101]


def run(spark, docs, length=100, **how):
    rows = spark.createDataFrame([(t, i, "n") for i, t in docs.items()], "text string, doc_id long, id string").repartition(5)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in phrases.remove_repeats(rows, length=length, **how).collect()}


@pytest.mark.parametrize("length", [100, 40])
def test_against_all_strings(spark, length):
    docs = {7 * k - 50: t for k, t in enumerate(texts(length, 60))}
    assert run(spark, docs, length) == plain(docs, length)


def test_blocks_hot_halves_and_small_rankings(spark):
    """A third of the documents hold one line among other text, so its edges are hot."""
    rng = random.Random(5)
    line = " the line that very many of the documents hold, word by word, and that is longer than a string of a hundred bytes is "
    own = lambda: "".join(rng.choice("pqrstuvw ") for _ in range(rng.randint(50, 300)))
    docs = {k: own() + line + own() for k in range(60)} | {100 + k: t for k, t in enumerate(texts(3, 30))}
    sizes = phrases.Sizes(block=700, ranked=3000, hot=(2, 4))
    assert run(spark, docs, sizes=sizes) == plain(docs, 100)


def test_parse_covers_every_string_once():
    many = [t.encode() for t in texts(1, 20)]
    f = phrases.parse(np.frombuffer(b"".join(many), np.uint8), np.cumsum([len(t) for t in many]), 100, phrases.Roll(1100), 1000)
    got = sorted((d, s + k) for d, s, n in zip(f["doc"].tolist(), f["s"].tolist(), f["n"].tolist()) for k in range(n))
    assert got == [(d, s) for d, t in enumerate(many) for s in range(len(t) - 99)]
    assert ((f["x"] & np.uint64(127)).astype(int) == f["n"]).all() and ((f["l"] != 0) | (f["r"] != 0)).all()


def test_equal_strings_trigger_alike():
    rng = random.Random(9)
    s = bytes(rng.choice(b"abcd") for _ in range(100))
    at = set()
    for _ in range(20):
        before = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 300)))
        mixed = phrases._mix(phrases._grams(np.frombuffer(before + s + before[::-1], np.uint8)))
        at.add(int(phrases.triggers(mixed, 100)[len(before)]) - len(before))
    assert len(at) == 1


def test_suffix_ranks_order_strings():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(400)) + b"c" * 150
    rank = phrases.suffix_ranks(np.frombuffer(data, np.uint8), 100)
    strings = [data[k : k + 100] for k in range(len(data) - 99)]
    place = {s: k for k, s in enumerate(sorted(set(strings)))}
    assert rank[: len(strings)].tolist() == [place[s] for s in strings]


def test_joined_ranges():
    d, s, n = (np.array(x) for x in ([2, 1, 1, 1, 2], [5, 0, 3, 9, 0], [4, 3, 2, 1, 20]))
    assert [x.tolist() for x in phrases.joined(d, s, n)] == [[1, 1, 2], [0, 9, 0], [5, 1, 20]]


def test_odd_tables(spark):
    """Repeated and null ids, null texts, an id that isn't a number, an empty table."""
    t = "one passage of more than a hundred bytes, which is what a string needs to have before it can be taken out of a text"
    rows = [("b", t), ("a", t), ("a", None), (None, "x" + t), ("b", t), ("c", "")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = [(r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in phrases.remove_repeats(df, "id", kept=False).collect()]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    n = len(t)
    want = [("a", n, n, 1, sha(b"")), ("a", 0, 0, 0, sha(b"")), ("c", 0, 0, 0, sha(b"")), (None, n + 1, 0, 0, sha(b"x" + t.encode()))]
    assert sorted(got, key=str) == sorted(want + [("b", n, n, 1, sha(b""))] * 2, key=str)
    assert phrases.remove_repeats(df.where("false"), "id").count() == 0
    with pytest.raises(ValueError):
        phrases.remove_repeats(df, "id", length=500)
