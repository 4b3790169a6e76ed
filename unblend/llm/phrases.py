"""Removal of passages that occur before, by a parse into phrases and suffix ranks.

* **Triggers.** Every gram of 8 bytes has a rolling hash. Of the grams of a 100-byte string the one
  with the least hash (the first of equal ones) is its trigger. The string alone tells which that is, so
  equal strings trigger at the same place wherever they lie, and none is without a trigger.
* **Parse.** A phrase is all consecutive strings of one trigger, from the start of the first to the end of the last, with
  the bytes of the phrases after it that its strings reach into. A document is some 40 times fewer phrases than bytes.
* **Dictionary.** Equal phrases are brought together by their hashes (at least 121 bits). The first in the
  corpus stays; every string of the others occurs before. Repetitive text has few phrases left.
* **Suffix ranks.** Two phrases of the dictionary that share a string share the 54 bytes after the trigger or the 55 around
  and before it. Of those that do, the bytes are brought together and all their suffixes ranked, 100 bytes deep, by prefix
  doubling. Ranks and places in the parse give the corpus order of strings; of equal ones all but the first occur before.

What is exchanged is phrases, not positions. Tasks put phrases into chunks, one a bucket, so that
an exchange moves arrays. Equal phrases are merged before each exchange, so a passage that a third of all documents
hold is a few entries a task. Halves of phrases that very many phrases share are ranked string by string, by hash (128 bits),
not in one task. Nothing reaches the driver but counts and the keys of such halves, at most 16 bytes for 50,000 phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, materialize
from .spread import PARTS

GRAM = 8
#: Odd multipliers of the rolling hashes (fixed values; any odd number with mixed bits does).
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@dataclass(frozen=True)
class Sizes:
    """What a task holds at a time; results don't depend on them."""

    #: Bytes of text that are hashed at a time: arrays of one block fit a processor's cache.
    block: int = 1 << 18
    #: Bytes of phrases whose suffixes are ranked at a time.
    ranked: int = 1 << 23
    #: A half is hot if more phrases share it than one in ``PARTS`` of all, but not below the first number, and always above the second.
    hot: tuple[int, int] = (1_000, 50_000)


INTERVAL, PHRASE, LEFT, RIGHT, WINDOW = 0, 1, 2, 3, 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte the highest."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Roll:
    """Hashes of any substring of a block, from prefix sums."""

    def __init__(self, most: int):
        self.powers = [(np.cumprod(np.full(most, b, np.uint64)), np.cumprod(np.full(most, pow(b, -1, 1 << 64), np.uint64))) for b in BASES]

    def sums(self, mixed: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(mixed) + 1, np.uint64)
        np.cumsum(mixed * self.powers[which][0][: len(mixed)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end - GRAM + 1] - sums[start]) * self.powers[which][1][start])


def triggers(mixed: np.ndarray, length: int) -> np.ndarray:
    """For the string of ``length`` bytes from each place on, the place of its trigger."""
    n = np.uint64(len(mixed))
    if n >= 1 << 32:
        raise ValueError("a block has too many bytes")
    packed = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    return (_least(packed, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def parse(data: np.ndarray, ends: np.ndarray, length: int, roll: Roll, block: int) -> dict[str, np.ndarray]:
    """Phrases of texts that lie one after the other in ``data``; ``ends``: where each ends.

    doc (its number), s (the first string's start in the text), n (strings), o (from there to the trigger), the
    hash x, whose last 7 bits are n, and the keys l and r, 0 where the phrase has no string that the key is for. Blocks cut phrases; what
    one loses by that in the dictionary its strings find among the suffix ranks.
    """
    half, found = length // 2 - GRAM // 2, []
    starts = np.concatenate([[0], ends[:-1]])
    for p in range(0, max(0, len(data) - length + 1), block):
        b = data[p : p + block + length - 1]
        mixed = _mix(_grams(b))
        at = triggers(mixed, length)
        ok = np.ones(len(at), bool)
        lo, hi = np.searchsorted(ends, [p, p + len(b)], "right")
        for e in ends[lo:hi].tolist():
            ok[max(0, e - p - length + 1) : max(0, e - p)] = False
        w = np.flatnonzero(ok)
        if not len(w):
            continue
        a = at[w]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1] + 1)]))
        s, a = w[new], a[new]
        n = np.diff(np.append(new, len(w)))
        last = s + n - 1
        c0, c1 = roll.sums(mixed, 0), roll.sums(mixed, 1)
        x = (roll.of(c0, 0, s, last + length) & np.uint64(0xFFFFFFFFFFFFFF80)) | n.astype(np.uint64)
        left, right = a - s > half, a - last <= half
        l = np.where(left, roll.of(c1, 1, np.maximum(a - half - 1, 0), a + GRAM) | np.uint64(1), np.uint64(0))
        r = np.where(right, roll.of(c1, 1, a, np.minimum(a + length - half, len(b))) | np.uint64(1), np.uint64(0))
        doc = np.searchsorted(ends, s + p, "right")
        found.append((doc, s + p - starts[doc], n, a - s, x, l, r))
    if not found:
        found = [tuple(np.zeros(0, t) for t in (*[np.int64] * 4, *[np.uint64] * 3))]
    return dict(zip(("doc", "s", "n", "o", "x", "l", "r"), (np.concatenate(v) for v in zip(*found))))


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks in byte order of the strings of ``length`` bytes from each place on (places too near the end are left out)."""

    def ranked(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        out = np.empty(len(k), np.uint64)
        out[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])[: len(k)]).astype(np.uint64)
        return out

    rank, depth = ranked(_grams(data)), GRAM
    while depth < length:
        step = min(depth, length - depth)
        rank = ranked((rank[:-step] << np.uint64(32)) | rank[step:])
        depth += step
    return rank


def firsts(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys and place, whether each in that order is the first of its keys)."""
    order = np.lexsort([*reversed(place), *reversed(keys)])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


def joined(doc: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts in order of document and start, with those that touch or overlap made one."""
    if not len(doc):
        return doc, s, n
    order = np.lexsort([s, doc])
    d, a = doc[order], s[order].astype(np.int64)
    e = a + n[order]
    step = np.cumsum(np.concatenate([[0], d[1:] != d[:-1]])) * (int(e.max()) + 1)  # running maxima stay within a document
    top = np.maximum.accumulate(e + step) - step
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] > top[:-1])]))
    last = np.append(new[1:], len(d)) - 1
    return d[new], a[new], top[last] - a[new]


FIELDS = {"kind": np.int8, "id": np.int64, "s": np.int32, "n": np.int8, "x": np.uint64, "l": np.uint64, "r": np.uint64}
CHUNK = "bucket int, kind array<tinyint>, id array<long>, s array<int>, n array<tinyint>, x array<long>, l array<long>, r array<long>"
MARK = "kind int, id long, s int, n int, key long"


def _chunks(entries: list[tuple[int, np.ndarray, dict[str, np.ndarray]]], buckets: int) -> pa.RecordBatch:
    """One row per bucket with its entries, given as (kind, key that names the bucket, fields); a field that a kind lacks is 0."""
    key = np.concatenate([k for _, k, _ in entries])
    bucket = ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    have, first = np.unique(bucket[order], return_index=True)
    cuts = pa.array(np.append(first, len(order)).astype(np.int32))
    lists = []
    for name, kind in FIELDS.items():
        whole = np.concatenate([np.full(len(k), n) if name == "kind" else np.asarray(f.get(name, np.zeros(len(k)))).astype(kind) for n, k, f in entries])[order]
        flat = pa.array(whole.view(np.int64) if kind is np.uint64 else whole.astype(kind))
        lists.append(pa.ListArray.from_arrays(cuts, flat))
    return pa.RecordBatch.from_arrays([pa.array(have), *lists], names=["bucket", *FIELDS])


def _of(ids: np.ndarray) -> np.ndarray:
    """Keys that deal entries out by their documents."""
    return _mix(ids.astype(np.uint64))


def _ranges(doc: np.ndarray, s: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Joined ranges, cut into pieces of at most 100 so that their lengths fit a byte."""
    d, a, k = joined(doc, s, n)
    pieces = -(-k // 100)
    at = np.repeat(np.arange(len(d)), pieces)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return {"id": d[at], "s": a[at] + 100 * nth, "n": np.minimum(100, k[at] - 100 * nth)}


def _read(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[str, np.ndarray]]:
    """All entries of a partition, by kind."""
    parts: dict[str, list[np.ndarray]] = {name: [np.zeros(0, kind)] for name, kind in FIELDS.items()}
    for batch in batches:
        for name, kind in FIELDS.items():
            flat = batch.column(name).flatten().to_numpy()
            parts[name].append(flat.view(np.uint64) if kind is np.uint64 else flat)
    whole = {name: np.concatenate(v) for name, v in parts.items()}
    kind = whole.pop("kind")
    return {k: {c: v[kind == k] for c, v in whole.items()} for k in np.unique(kind).tolist()}


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, where each ends); null is empty."""
    texts = column.fill_null("") if column.null_count else column
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _parse_texts(length: int, buckets: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roll(block + length)
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(0).to_numpy()
            f = parse(*_texts(batch.column(1)), length, roll, block)
            f["id"] = ids[f.pop("doc")]
            order, new = firsts([f["x"], f["l"], f["r"]], [f["id"], f["s"]])
            f = {c: v[order] for c, v in f.items()}
            again = _ranges(*(f[c][~new] for c in ("id", "s", "n")))
            f = {c: v[new] for c, v in f.items()}
            yield _chunks([(INTERVAL, _of(again["id"]), again), (PHRASE, f["x"], f | {"n": f["o"]})], buckets)

    return run


def _dictionary(length: int, buckets: int):
    """The first of equal phrases go on, one entry for each key; the others' strings all occur before."""
    half = length // 2 - GRAM // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, entries = _read(batches), []
        if INTERVAL in kinds:
            entries.append((INTERVAL, _of(kinds[INTERVAL]["id"]), kinds[INTERVAL]))
        if PHRASE in kinds:
            f = kinds[PHRASE]
            order, new = firsts([f["x"], f["l"], f["r"]], [f["id"], f["s"]])
            f = {c: v[order] for c, v in f.items()}
            o, n = f["n"].astype(np.int64), (f["x"] & np.uint64(127)).astype(np.int64)
            again = _ranges(f["id"][~new], f["s"][~new], n[~new])
            entries.append((INTERVAL, _of(again["id"]), again))
            late = np.clip(o - half, 0, n)  # the strings that the left key is for come first
            for kind, c, begin, num in ((LEFT, "l", f["s"], late), (RIGHT, "r", f["s"] + late, n - late)):
                has = np.flatnonzero(new & (f[c] != 0))
                key, ids, s = f[c][has], f["id"][has], begin[has]
                order, first = firsts([key], [ids, s])
                group = np.cumsum(first) - 1
                known = np.bincount(group)[group] > 1 if len(group) else first
                cols = {"id": ids[order], "s": s[order], "n": num[has][order], "x": key[order], "l": np.where(known, 2, 1)}
                # one of each key is enough to meet those of other tasks; the others are shared anyway and go by their documents
                entries.append((kind, np.where(first, cols["x"], _of(cols["id"])), cols))
        if entries:
            yield _chunks(entries, buckets)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges as they come, and the phrases that share a key with another."""
    kinds = _read(batches)
    for kind, f in kinds.items():
        if kind == INTERVAL:
            d, a, n = joined(f["id"], f["s"], f["n"].astype(np.int64))
            key = np.zeros(len(d), np.int64)
        else:
            order, first = firsts([f["x"]], [f["id"], f["s"]])
            group = np.cumsum(first) - 1
            many = np.bincount(group)[group] > 1 if len(group) else first
            at = order[many | (f["l"][order] == 2)]
            at = at[np.argsort(f["id"][at], kind="stable")]
            d, a, n, key = f["id"][at], f["s"][at], f["n"][at].astype(np.int64), f["x"][at].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(d), kind, np.int32)), pa.array(d), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key)],
            names=["kind", "id", "s", "n", "key"],
        )


SLICE = "key long, kind int, id long, s int, n int, bytes binary, more long"


def _slices(length: int):
    """Of each document the bytes of its marked halves of phrases, or of hot ones the strings' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roll(4 * length)
        for batch in batches:
            rows: list[tuple] = []
            hashes: list[tuple] = []
            for id_, z, size, marks in zip(*(batch.column(c).to_pylist() for c in ("id", "z", "size", "marks"))):
                text = _unpacked(z, size)
                for m in marks:
                    s, n = m["s"], m["n"]
                    b = text[s : s + n + length - 1]
                    if not m["hot"]:
                        rows.append((m["key"], PHRASE, id_, s, n, b, 0))
                        continue
                    at, mixed = np.arange(n), _mix(_grams(np.frombuffer(b, np.uint8)))
                    h = [roll.of(roll.sums(mixed, k), k, at, at + length).view(np.int64) for k in (0, 1)]
                    hashes.append((*h, np.full(n, id_), s + at))
            if hashes:
                h0, h1, ids, at = (np.concatenate(v) for v in zip(*hashes))
                order, new = firsts([h0, h1], [ids, at])
                again = joined(ids[order][~new], at[order][~new], np.ones(int((~new).sum()), np.int64))
                rows += [(i, INTERVAL, i, s, n, None, 0) for i, s, n in zip(*(v.tolist() for v in again))]
                one = order[new]
                rows += [(k, WINDOW, i, s, 1, None, m) for k, m, i, s in zip(h0[one].tolist(), h1[one].tolist(), ids[one].tolist(), at[one].tolist())]
            names = ["key", "kind", "id", "s", "n", "bytes", "more"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return run


def _ranked(length: int, most: int):
    """The strings that occur before, of slices with equal keys in one partition."""

    def out(d, s, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["id", "s", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = list(batches)
        if not table:
            return
        table = pa.Table.from_batches(table)
        kind = table["kind"].to_numpy()
        rows = table.filter(pa.array(kind == INTERVAL))
        yield out(*(rows[c].to_numpy() for c in ("id", "s", "n")))
        rows = table.filter(pa.array(kind == WINDOW))
        key, more, d, s = (rows[c].to_numpy() for c in ("key", "more", "id", "s"))
        order, new = firsts([key, more], [d, s])
        yield out(*joined(d[order][~new], s[order][~new].astype(np.int64), np.ones(int((~new).sum()), np.int64)))
        rows = table.filter(pa.array(kind == PHRASE)).sort_by("key")
        del table
        key, d, s, n = (rows[c].to_numpy() for c in ("key", "id", "s", "n"))
        if not len(key):
            return
        ends = np.cumsum(n.astype(np.int64) + length - 1)
        group = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) + 1  # where keys end
        lo = 0
        while lo < len(key):
            done = ends[lo - 1] if lo else 0
            k = np.searchsorted(ends[group - 1], done + most, "right")
            hi = int(group[min(len(group) - 1, max(k - 1, np.searchsorted(group, lo, "right")))])
            data = np.frombuffer(b"".join(rows["bytes"][lo:hi].to_pylist()), np.uint8)
            begin = np.concatenate([[0], ends[lo : hi - 1] - done]).astype(np.int64)
            num = n[lo:hi].astype(np.int64)
            row = np.repeat(np.arange(hi - lo), num)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(num) - num, num)
            rank = suffix_ranks(data, length)[begin[row] + nth]
            place = s[lo:hi].astype(np.int64)[row] + nth
            doc = d[lo:hi][row]
            order, new = firsts([rank], [doc, place])
            at = order[~new]
            yield out(*joined(doc[at], place[at], np.ones(len(at), np.int64)))
            lo = hi

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for an exchange: most of what is exchanged is these bytes."""
    codec = pa.Codec("zstd")
    for batch in batches:
        data, ends = _texts(batch.column(1))
        starts = np.concatenate([[0], ends[:-1]])
        z = [codec.compress(data[a:b].tobytes(), asbytes=True) if b > a else b"" for a, b in zip(starts.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary()), pa.array(ends - starts)], names=["id", "z", "size"])


def _unpacked(z: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(z, size, asbytes=True) if size else b""


def cut(text: bytes, s: np.ndarray, n: np.ndarray, length: int) -> tuple[bytes, int]:
    """(what is left of the text, removed runs): the strings from the ranges' starts on are cut out."""
    if not len(s):
        return text, 0
    zero = np.zeros(len(s), np.int64)
    _, a, k = joined(zero, s, n.astype(np.int64) + length - 1)
    ends = a + k
    left, at = [], 0
    for x, y in zip(a.tolist(), ends.tolist()):
        left.append(text[at:x])
        at = y
    return b"".join([*left, text[at:]]), len(a)


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _results(length: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, z, size, ranges in zip(*(batch.column(c).to_pylist() for c in ("id", "z", "size", "ranges"))):
                r = np.array([(x["s"], x["n"]) for x in ranges or ()], np.int64).reshape(-1, 2)
                left, spans = cut(_unpacked(z, size), r[:, 0], r[:, 1], length)
                rows.append((id_, size, size - len(left), spans, left if whole else None, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def _marks(docs: DataFrame, length: int, block: int) -> DataFrame:
    """(kind, id, s, n, key), written: ranges of starts that occur before, and halves of phrases that others share."""
    parts = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.mapInArrow(_parse_texts(length, parts, block), CHUNK).repartitionById(parts, "bucket")
    rows = rows.mapInArrow(_dictionary(length, parts), CHUNK).repartitionById(parts, "bucket")
    return materialize(rows.mapInArrow(_shared, MARK), "phrase-marks")


def _ranges_of(docs: DataFrame, length: int, sizes: Sizes) -> DataFrame:
    """(id, s, n): ranges of starts of strings that occur before."""
    marks = _marks(docs, length, sizes.block)
    halves = marks.where(F.col("kind") > INTERVAL)
    total = halves.count()
    limit = max(sizes.hot[0], min(total // PARTS, sizes.hot[1]))
    hot = halves.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > limit).select("key", F.lit(True).alias("hot"))
    # there are fewer than total / limit of them
    halves = halves.join(F.broadcast(hot) if total / limit < 100_000 else hot, "key", "left")
    per_doc = halves.groupBy("id").agg(F.collect_list(F.struct("kind", "s", "n", "key", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("marks"))
    slices = docs.mapInArrow(_packed, "id long, z binary, size long").join(per_doc, "id").mapInArrow(_slices(length), SLICE)
    parts = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = slices.repartition(parts, "key").mapInArrow(_ranked(length, sizes.ranked), "id long, s int, n int")
    found = materialize(found, "phrase-ranges")
    return marks.where(F.col("kind") == INTERVAL).select("id", "s", "n").unionByName(found)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """((id, text) with a long that orders documents, and what the ids stand for unless they are the table's own)."""
    id_, text, sha = fresh(docs, "id", "text", "sha")
    own = docs.select(F.col(id_col).alias(id_), F.coalesce(F.col(text_col), F.lit("")).alias(text))
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole:
        n, k, d = own.agg(F.count(F.lit(1)), F.count(id_), F.countDistinct(id_)).first()
        if n == k == d:
            return own.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")), None
    hashed = own.select(F.col(id_).alias("own"), F.sha2(text, 256).alias("sha"), F.col(text).alias("text"))
    pairs = materialize(hashed.select("own", "sha").distinct(), "document-pairs")
    schema = "own " + docs.schema[id_col].dataType.simpleString() + ", sha string, id long"
    names = pairs.orderBy(F.col("own").asc_nulls_first(), "sha").rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF(schema)
    names = materialize(names, "document-numbers")
    same = hashed["own"].eqNullSafe(names["own"]) & (hashed["sha"] == names["sha"])
    rows = hashed.join(names, same).select(names["id"], "text").dropDuplicates(["id"])
    return materialize(rows, "documents-numbered"), names


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, kept: bool = True, sizes: Sizes = Sizes()) -> DataFrame:
    """Per row: ``id_col``, n_bytes, n_removed, n_spans, kept (the bytes left, unless ``kept`` is false), kept_sha256.

    Each byte goes that lies in a string of ``length`` bytes which also starts earlier: in a document with a smaller id, or
    before in the same one. Strings are judged on the texts as they are, overlaps count, and none crosses documents.
    Texts are read whole, as UTF-8 bytes; null counts as empty, and texts shorter than ``length`` stay as they are. Ids may be of any type that has an order;
    null ids come first. Rows that share an id are ordered by SHA-256 of their texts; rows that share
    both are one document, and each gets its result. Other columns are ignored, whatever
    their names. An empty table gives no rows. ``docs`` is read four times, so give a table. ``length`` is 24 to 128.
    """
    if not 24 <= length <= 128:
        raise ValueError("length must be 24 to 128")
    own, names = _numbered(docs, id_col, text_col)
    ranges = _ranges_of(own, length, sizes)
    per_doc = ranges.groupBy("id").agg(F.collect_list(F.struct("s", "n")).alias("ranges"))
    packed = own.mapInArrow(_packed, "id long, z binary, size long")
    done = packed.join(per_doc, "id", "left").mapInArrow(_results(length, kept), RESULT)
    out = done.select("n_bytes", "n_removed", "n_spans", *(["kept"] if kept else []), "kept_sha256")
    if names is None:
        kind = docs.schema[id_col].dataType
        return done.select(F.col("id").cast(kind).alias(id_col), *out.columns)
    key, sha = fresh(docs, "own", "sha")
    rows = docs.select(F.col(id_col).alias(key), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias(sha))
    named = done.join(names, "id").select(F.col("own").alias("_o"), F.col("sha").alias("_s"), *out.columns)
    same = rows[key].eqNullSafe(named["_o"]) & (rows[sha] == named["_s"])
    return rows.join(named, same).select(F.col(key).alias(id_col), *out.columns)
