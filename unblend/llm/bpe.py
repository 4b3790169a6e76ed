"""Byte-level BPE by tree reduction.

An encoding is an element of a monoid: two neighbours are joined by looking at the
boundary only. A text is halved until leaves are short, leaves are encoded, and
neighbours are joined up the tree. What lies away from a boundary is kept
because it provably cannot change:

* Between matches of the split pattern. A match is settled once the text goes on
  beyond it and beyond the longest look ahead from its start. The tail of the left
  part that isn't settled is matched again on a window that grows into the right
  part until a match ends where one of the right part's matches ends too;
  from there on matching sees the same characters, so it gives the same matches.
* Inside one long match. A token sequence is the BPE encoding of its bytes exactly
  if each token is the encoding of its own bytes and each neighbouring pair is the
  encoding of the pair's bytes. The window around the boundary is encoded anew,
  and grows until its first and last token stand with the tokens outside.

Texts are whole rows of one task; Spark deals rows out, and every length is
encoded with work in proportion to it.
"""

from __future__ import annotations

import base64
import gc
import heapq
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import fresh

#: Longest match that is encoded at once, in bytes, and longest leaf of a text, in characters.
PIECE, LEAF = 64, 8192
#: Rank of a pair that doesn't merge.
NEVER = 1 << 60
#: Rows that a task encodes or decodes at a time, so a batch's results are never all in memory.
SLICE = 256
#: Known split patterns (fixed values) and how many characters they look ahead from a match's start, at most, before it is decided
#: that the match doesn't go on to the text's end.
AHEADS = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": 3}
#: In place of that number: there is none, so a text's matches are found in one piece.
UNBOUNDED = -1


def look_ahead(pattern: str, ahead: int | None) -> int:
    """The given number, or the one of a known pattern. An unknown pattern's has to be stated: with one that is too small matches near
    the boundary of two parts could come out wrong."""
    if ahead is None and pattern not in AHEADS:
        raise ValueError("state how far this pattern looks ahead (ahead), or UNBOUNDED")
    found = AHEADS[pattern] if ahead is None else ahead
    if found < 1 and found != UNBOUNDED:
        raise ValueError("ahead must be 1 or more, or UNBOUNDED")
    return found


class _Known(dict):
    """Encodings of short matches, packed as 32-bit ids; those it lacks are made on the way.
    It starts anew when full, so a worker's memory has a bound."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, match: str) -> bytes:
        got = self.make(match)
        got = pack(f"<{len(got)}i", *got)
        if len(match) <= PIECE:
            if len(self) >= self.size:
                self.clear()
            self[match] = got
        return got


class Tokenizer:
    """Ranks of byte strings and the pattern that splits text before merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 1 << 20, ahead: int | None = None):
        import regex

        self.ahead = look_ahead(pattern, ahead)

        compiled = regex.compile(pattern)
        self.ranks, self.find_all = ranks, compiled.findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.known = _Known(self.encode_match, cache)

    # ------------------------------------------------ one match

    def merge(self, data: bytes) -> tuple[int, ...]:
        """BPE of a short byte string: the pair of lowest rank, leftmost first, merges until none can."""
        get = self.ranks.get
        whole = get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        if n > PIECE:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(n)]
        pair = [get(x + y, NEVER) for x, y in zip(parts, parts[1:])]
        while pair:
            low = min(pair)
            if low == NEVER:
                break
            i = pair.index(low)
            parts[i] += parts[i + 1]
            del parts[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], NEVER)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        return tuple([self.ranks[x] for x in parts])

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a queue of pairs, for windows that have grown long."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once merged away
        before = list(range(-1, n - 1))
        queue: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(queue, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _stands(self, a: int, b: int) -> bool:
        return self.pair(self.bytes_of[a], self.bytes_of[b]) == (a, b)

    def pair(self, a: bytes, b: bytes) -> tuple[int, ...]:
        return self.merge(a + b)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encodings put together."""
        if not left or not right:
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            data = b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j]))
            middle = list(self.merge(data))
            first = i == 0 or self._stands(left[i - 1], middle[0])
            last = j == len(right) or self._stands(middle[-1], right[j])
            if first and last:
                return left[:i] + middle + right[j:]
            k *= 2

    def _halves(self, data: bytes) -> list[int]:
        """Encoding of a long byte string without a split: halves, joined."""
        if len(data) <= PIECE:
            return list(self.merge(data))
        half = len(data) // 2
        return self.join(self._halves(data[:half]), self._halves(data[half:]))

    def encode_match(self, match: str) -> tuple[int, ...]:
        data = match.encode("utf-8", "replace")
        return self.merge(data) if len(data) <= PIECE else tuple(self._halves(data))

    # ------------------------------------------------ a text

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        """Matches of a text from those of its two parts. Only what lies near the boundary is matched again."""
        keep, back = len(left), 0
        # unsettled: a match that ends at the boundary, or starts too near to it
        while keep and (not back or back + len(left[keep - 1]) < self.ahead):
            keep -= 1
            back += len(left[keep])
        tail, count = "".join(left[keep:]), 8
        while True:
            taken = right[:count]
            window, all_in = tail + "".join(taken), count >= len(right)
            ends, at = set(), len(tail)
            for m in taken:
                at += len(m)
                ends.add(at)
            begin = 0
            for k, m in enumerate(found := self.find_all(window)):
                end = begin + len(m)
                if not all_in and (end >= len(window) or begin + self.ahead > len(window)):
                    break
                if end in ends:
                    at, n = len(tail), 0
                    while at < end:
                        at += len(right[n])
                        n += 1
                    return left[:keep] + found[: k + 1] + right[n:]
                begin = end
            if all_in:
                return left[:keep] + found
            count *= 2

    def matches(self, text: str) -> list[str]:
        """Matches of the whole text, by halves."""
        if len(text) <= LEAF or self.ahead == UNBOUNDED:
            return self.find_all(text)
        half = len(text) // 2
        return self.join_matches(self.matches(text[:half]), self.matches(text[half:]))

    def packed(self, text: str) -> bytes:
        """Ids of the whole text, 32 bits each, little end first."""
        return b"".join(map(self.known.__getitem__, self.matches(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids) -> bytes:
        """Bytes of the ids: parts put together up the tree."""
        get = self.bytes_of.__getitem__
        parts = [b"".join(map(get, ids[i : i + LEAF])) for i in range(0, len(ids), LEAF)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 byte string and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(2)
def tokenizer(path: str, pattern: str, ahead: int | None = None) -> Tokenizer:
    """One for each Python worker: the vocabulary's file is read where it is used,
    its size is fixed by the vocabulary and not by the data."""
    own = Tokenizer(read_ranks(path), pattern, ahead=ahead)
    gc.freeze()  # a large cache of strings that no collection has to walk again
    return own


def _mapped(docs: DataFrame, column: str, added: dict[str, T.DataType], make) -> DataFrame:
    """Adds columns, made from ``column`` by ``make`` in small slices of Arrow batches; columns
    of those names are replaced and all others pass through untouched."""
    kept = docs.drop(*added)
    at, same = (kept.columns.index(column), False) if column in kept.columns else (len(kept.columns), True)
    rows = docs.withColumn(fresh(docs, "coded_from")[0], docs[column]).drop(*added) if same else kept
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, k) for n, k in added.items()]])
    n = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *make(part.column(at))], names=schema.names)

    return rows.mapInArrow(run, schema)


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", exact_col: str | None = None, ahead: int | None = None
) -> DataFrame:
    """Adds ``ids_col``: the token ids of the whole text, array<int>. Null and empty
    texts have no ids (an empty array). With ``exact_col`` the ids are decoded too: it says whether
    they give the text's own bytes. Columns of those names are replaced;
    all others, and repeated rows, stay. An empty table gives no rows. ``ranks_path`` must exist on every executor.
    ``ahead``: how far the pattern looks ahead, which a pattern that isn't known (``AHEADS``) needs."""
    ahead = look_ahead(pattern, ahead)

    def encode(texts: pa.Array) -> list[pa.Array]:
        own, texts = tokenizer(ranks_path, pattern, ahead), [t or "" for t in texts.to_pylist()]
        packed = list(map(own.packed, texts))
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
        out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))]
        if exact_col:
            back = (own.decode(np.frombuffer(p, "<i4").tolist()) for p in packed)
            out.append(pa.array([b == t.encode("utf-8", "replace") for b, t in zip(back, texts)], pa.bool_()))
        return out

    added = {ids_col: T.ArrayType(T.IntegerType())} | ({exact_col: T.BooleanType()} if exact_col else {})
    return _mapped(docs, text_col, added, encode)


def decode_ids(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds ``bytes_col``: the bytes that the ids stand for. Null ids count as none; a column of that name is
    replaced, all others stay; an empty table gives no rows."""

    def decode(ids: pa.Array) -> list[pa.Array]:
        own = tokenizer(ranks_path, pattern, AHEADS.get(pattern, UNBOUNDED))  # decoding splits nothing
        flat = ids.flatten().to_numpy(zero_copy_only=False).tolist()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)).tolist()
        return [pa.array([own.decode(flat[a:b]) for a, b in zip([0, *ends], ends)], pa.binary())]

    return _mapped(docs, ids_col, {bytes_col: T.BinaryType()}, decode)
