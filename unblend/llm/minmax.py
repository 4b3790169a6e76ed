"""Near-duplicate detection by min-max hashing.

A document's set is its distinct word shingles. Under each permutation both the
smallest and the largest value are kept, so half as many permutations fill a
signature; each is an unbiased estimator of the Jaccard similarity and the two
together vary less than two minima. Bands of ``rows`` values make buckets. The
number of bands follows from the threshold: a pair at the threshold shares no
bucket with probability ``miss`` at most.

From buckets to groups without ever listing the pairs of a bucket:

1. Documents with one and the same set are one class; the rest works on classes.
2. Every bucket's members are compared with its smallest member, on full sets.
   What links becomes components; a large group of near copies is one now.
3. Links still unseen join different components inside one bucket. For members
   of buckets that hold more than one component, an exact prefix filter finds
   them: ordered from rare to frequent, the sets of linked documents share one of
   their first shingles, at places that leave room for the overlap that a link
   needs. Under each such shingle, members of the largest component meet only
   the others. These pairs are confirmed on full sets too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .components import components
from .shared import fresh, materialize
from .spread import join_by_count, join_salted

#: Odd multipliers that mix 64-bit hashes (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


#: Members under one shingle that a task compares at a time, on either side.
CELL = 512


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``width`` words.

    A-Z count as a-z. A text with fewer words is one shingle, one without words none.
    """
    import xxhash

    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(found) if len(found) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(MIX[0])
        out ^= out >> np.uint64(29)
        out *= np.uint64(MIX[1])
        out ^= out >> np.uint64(32)
    return np.unique(out)


def plan_bands(percent: int, rows: int, miss: float) -> int:
    """Bands that a pair at the threshold misses with probability ``miss`` at most; even."""
    b = math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))
    return b + b % 2


class MinMax:
    """Signatures and band keys of sets of shingle hashes."""

    def __init__(self, bands: int, rows: int, seed: int):
        self.bands, self.rows = bands, rows
        k = bands // 2 * rows
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 31, k, dtype=np.uint32) * 2 + 1)[:, None].astype(np.uint32)
        self.c = rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]

    def signature(self, hashes: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """Minima of all permutations, then maxima."""
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        high = np.zeros(len(self.a), np.uint32)
        for i in range(0, len(x), chunk):
            y = self.a * x[i : i + chunk] + self.c
            low, high = np.minimum(low, y.min(1)), np.maximum(high, y.max(1))
        return np.concatenate([low, high])

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band; equal keys in different bands don't occur but by chance."""
        values = signature.reshape(self.bands, self.rows).astype(np.uint64)
        out = (np.arange(self.bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(MIX[2])
        for k in range(self.rows):
            out = (out ^ values[:, k]) * np.uint64(MIX[0])
            out ^= out >> np.uint64(29)
            out *= np.uint64(MIX[1])
            out ^= out >> np.uint64(32)
        return out.view(np.int64)


def sign(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(id, text) to (id, n, same, keys): set size, a 128-bit hash of the set, band keys."""
    schema = T.StructType(
        [
            docs.schema["id"],
            T.StructField("n", T.LongType()),
            T.StructField("same", T.BinaryType()),
            T.StructField("keys", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hasher = MinMax(bands, rows, seed)
        for batch in batches:
            n, same, keys = [], [], []
            for text in batch["text"]:
                s = shingles(text, width)
                n.append(len(s))
                same.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(hasher.keys(hasher.signature(s)) if len(s) else np.empty(0, np.int64))
            yield pd.DataFrame({"id": batch["id"], "n": n, "same": same, "keys": keys})

    return docs.mapInPandas(run, schema)


def _linked(width: int, percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        full = lru_cache(64)(lambda text: shingles(text, width))
        out = []
        for x, y in zip(a, b):
            p, q = full(x), full(y)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    return linked


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity. A document in very many pairs is several tasks' work."""
    pairs = materialize(pairs.select("a", "b"), "pairs")
    n = pairs.count()
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    full = join_salted(join_salted(pairs, side("b"), "b", F.xxhash64("a"), n), side("a"), "a", F.xxhash64("b"), n)
    return full.where(_linked(width, percent)("text_a", "text_b")).select("a", "b")


def _fit(n: Column, m: Column, percent: int) -> Column:
    """Sets of these sizes can have the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def unseen_pairs(members: DataFrame, found: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs across components that can be links, by an exact prefix filter.

    members: (key, id, n) of buckets with more than one member; found: (id, component).
    """
    placed = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("k"))
    mixed = materialize(mixed.where("x <> y").select("key", "k"), "mixed-buckets")
    active = join_by_count(placed, mixed, ["key"], "k", placed.count()).select("id", "component").distinct()

    @F.pandas_udf("array<long>")
    def tokens(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width).view(np.int64) for t in text])

    sets = texts.join(active, "id").select("id", "component", tokens("text").alias("set"))
    each = materialize(
        sets.select("id", "component", F.size("set").alias("n"), F.explode("set").alias("token")), "prefix-tokens"
    )
    common = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = materialize(common.withColumn("k", F.col("df")), "prefix-counts")
    order = Window.partitionBy("id").orderBy("df", "token")
    whole = Window.partitionBy("id")
    # shingles of one document only come first and match nothing: they are counted, not listed
    ranked = join_by_count(each, common, ["token"], "k", each.count()).select(
        "id",
        "component",
        "token",
        "n",
        (F.row_number().over(order) - 1 + F.col("n") - F.count(F.lit(1)).over(whole)).alias("pos"),
    )
    need = F.ceil(F.col("n") * percent / F.lit(100.0))
    prefix = materialize(ranked.where(F.col("pos") <= F.col("n") - need), "prefix")
    per = prefix.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    most = per.groupBy("token").agg(F.max(F.struct("k", "component")).alias("most"), F.count(F.lit(1)).alias("c"), F.sum("k").alias("k"))
    most = most.where("c > 1").select(
        "token", F.col("most.component").alias("major"), F.col("k").alias("all"), (F.col("k") - F.col("most.k")).alias("minor"), "k"
    )
    here = join_by_count(prefix, materialize(most, "prefix-shared"), ["token"], "k", prefix.count())
    # a shingle's members are dealt to a grid of cells, each with a part of either side
    sides = [F.ceil(F.col(c) / CELL).cast("int") for c in ("minor", "all")]
    own = [F.pmod(F.xxhash64("id"), n).cast("int") for n in sides]
    every = [F.explode(F.sequence(F.lit(0), n - 1)) for n in sides]
    named = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "pos", "component")]
    left = here.where("component <> major").select("token", own[0].alias("row"), every[1].alias("col"), *named(1))
    right = here.select("token", every[0].alias("row"), own[1].alias("col"), "major", *named(2))
    room = 1 + F.least(F.col("n_1") - F.col("pos_1") - 1, F.col("n_2") - F.col("pos_2") - 1)
    total = F.col("n_1") + F.col("n_2")
    both = left.join(
        right,
        (left["token"] == right["token"]) & (left["row"] == right["row"]) & (left["col"] == right["col"])
        & (F.col("component_1") != F.col("component_2"))
        & ((F.col("component_2") == F.col("major")) | (F.col("id_1") < F.col("id_2")))
        & _fit(F.col("n_1"), F.col("n_2"), percent)
        & ((100 + percent) * room >= percent * total),
    )
    return both.select(F.least("id_1", "id_2").alias("a"), F.greatest("id_1", "id_2").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    rows: int = 5,
    miss: float = 1e-8,
    seed: int = 11,
) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id (smallest id
    reachable over links, itself included) and kept (id equals component_id).

    Documents link when 100 * |A & B| >= percent * |A | B|. Null, empty and
    blank texts have empty sets and link with nothing. Rows that repeat an id
    are one document that links by each of its texts. A null id links with
    nothing, has no component and is kept. Other columns are ignored; an empty table
    gives no rows. Whole texts count; no bucket or group is capped.
    """
    bands = plan_bands(percent, rows, miss)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = materialize(sign(own, width, bands, rows, seed), "signatures")
    usable = signed.where("id is not null and n > 0")
    classes = usable.groupBy("same", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = materialize(classes.where("size > 1"), "classes")
    total = signed.count()
    marked = join_by_count(usable, classes, ["same", "n"], "size", total, "left")
    marked = materialize(marked.withColumn("rep", F.coalesce("rep", "id")).drop("same"), "marked")
    buckets = marked.where("id = rep").select("id", "n", F.explode("keys").alias("key"))
    pivots = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("pivot"), F.max("id").alias("last"), F.count(F.lit(1)).alias("k"))
    pivots = materialize(pivots.where("pivot.id <> last").select("key", "pivot", "k"), "pivots")
    members = materialize(join_by_count(buckets, pivots, ["key"], "k", total), "buckets")
    texts = own.join(members.select("id").distinct(), "id")
    texts = materialize(texts, "bucket-texts")
    stars = members.where((F.col("id") != F.col("pivot.id")) & _fit(F.col("n"), F.col("pivot.n"), percent))
    stars = stars.select(F.col("pivot.id").alias("a"), F.col("id").alias("b")).distinct()
    links = materialize(confirm(stars, texts, width, percent), "star-links")
    found = materialize(components(links), "star-components")
    pairs = unseen_pairs(members.select("key", "id", "n"), found, texts, width, percent)
    more = materialize(confirm(pairs, texts, width, percent), "prefix-links")
    found = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    same = marked.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    final = components(found.unionByName(more).unionByName(same))
    out = signed.select("id", "n").join(final, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id names its group, with all their columns."""
    (key,) = fresh(docs, "gone_id")
    marks = near_duplicates(docs, id_col, text_col, **options).where("not kept")
    marks = marks.select(F.col(id_col).alias(key)).distinct()
    return docs.join(marks, F.col(id_col) == F.col(key), "left_anti")
