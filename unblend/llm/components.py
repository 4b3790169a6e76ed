"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .spread import join_by_count


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node's larger neighbours move to the smallest of it and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")).select("u", F.least("u", "m").alias("m"), "k")
    moved = join_by_count(both.where("v > u"), least, ["u"], "k", 2 * n)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
    moved = join_by_count(edges, least, ["u"], "k", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    key = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(key)).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id reachable.

    Nulls and links of an id with itself do nothing. Rounds grow with the
    logarithm of the longest path; what a round keeps never has more
    rows than there are links. A node with very many links is joined apart from the others. Only two numbers a round reach the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    before = _mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = materialize(_large_star(edges, before[0]), "links")
        edges = materialize(_small_star(edges, before[0]), "links")
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
