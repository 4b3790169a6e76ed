"""Cell-type profiles, pseudobulk and gene scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.storage import materialize
from .normalize import KEYS, dense_signature, log1p_counts, normalize_columns


def celltype_profiles(counts: DataFrame, cells: DataFrame, by_subject: bool = True, log: bool = True, keys: list[str] = KEYS) -> DataFrame:
    """Mean expression of each gene per cell type, with equal weight per subject if asked.

    Counts are sparse: sums come from what is there, numbers of cells from ``cells``.
    Genes that a type never shows are absent from the result, as zeros are.
    """
    counts = log1p_counts(counts) if log else counts
    by = [*keys, "cell_type", *(["subject"] if by_subject else [])]
    sizes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.join(cells, [*keys, "cell_id"]).groupBy(*by, "gene").agg(F.sum("value").alias("s"))
    means = sums.join(sizes, by).withColumn("value", F.col("s") / F.col("n"))
    if not by_subject:
        return means.select(*keys, "cell_type", "gene", "value")
    subjects = sizes.groupBy(*keys, "cell_type").agg(F.count(F.lit(1)).alias("subjects"))
    total = means.groupBy(*keys, "cell_type", "gene").agg(F.sum("value").alias("s"))
    return total.join(subjects, [*keys, "cell_type"]).select(
        *keys, "cell_type", "gene", (F.col("s") / F.col("subjects")).alias("value")
    )


def aggregate_profiles_by_node(profiles: DataFrame, node_leaf: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A node's profile is the mean of its leaves'; absent values are 0."""
    leaves = node_leaf.groupBy("node").agg(F.count(F.lit(1)).alias("leaves"))
    sums = profiles.join(node_leaf.withColumnRenamed("leaf", "cell_type"), "cell_type").groupBy(*keys, "node", "gene")
    return sums.agg(F.sum("value").alias("s")).join(leaves, "node").select(*keys, "node", "gene", (F.col("s") / F.col("leaves")).alias("value"))


def gene_dispersion_score(signature: DataFrame, keys: list[str] = KEYS, epsilon: float = 1e-12) -> DataFrame:
    """Variance over mean across cell types, as a share of the tissue's largest (1 where none is above 0). Absent values are 0."""
    signature = dense_signature(signature, signature.select(*keys, "gene").distinct(), keys)
    raw = signature.groupBy(*keys, "gene").agg(
        F.greatest(F.var_pop("value") / F.greatest(F.avg("value"), F.lit(epsilon)), F.lit(0.0)).alias("raw")
    )
    top = raw.groupBy(*keys).agg(F.max("raw").alias("top"))
    score = F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(1.0)
    return raw.join(top, keys).select(*keys, "gene", score.alias("score"))


def leaf_grid(profiles: DataFrame, node_leaf: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Every gene of a tissue for every leaf of the tree, 0 where its profile has none."""
    leaves = sorted(r[0] for r in node_leaf.select("leaf").distinct().collect())  # a hierarchy's few dozen names
    grid = profiles.select(*keys, "gene").distinct().withColumn("cell_type", F.explode(F.array(*map(F.lit, leaves))))
    pick = [*keys, "gene", "cell_type"]
    return grid.join(profiles, pick, "left").select(*pick, F.coalesce("value", F.lit(0.0)).alias("value"))


def split_gene_selection(
    profiles: DataFrame, tree: DataFrame, node_leaf: DataFrame, genes: int = 150, keys: list[str] = KEYS, epsilon: float = 1e-12
) -> DataFrame:
    """For each inner node the genes that tell its children apart best: variance between
    the children's means over the mean variance among a child's own leaves. Absent values are 0."""
    profiles = leaf_grid(profiles, node_leaf, keys)
    children = tree.where("parent is not null").select("node", "parent")
    placed = profiles.join(node_leaf.withColumnRenamed("leaf", "cell_type"), "cell_type").join(children, "node")
    child = placed.groupBy(*keys, "parent", "node", "gene").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    scored = child.groupBy(*keys, "parent", "gene").agg(
        (F.var_pop("m") / (F.avg("v") + epsilon)).alias("score"), F.count(F.lit(1)).alias("children")
    )
    w = Window.partitionBy(*keys, "parent").orderBy(F.desc("score"), "gene")
    ranked = scored.where("children > 1").withColumn("place", F.row_number().over(w))
    return ranked.where(F.col("place") <= genes).select(*keys, "parent", "gene", "score", "place")


def allocate_counts(shares: DataFrame, total: int, groups: list[str], name: str, share: str) -> DataFrame:
    """Whole numbers that sum to ``total`` in each group: floors, then one more for the
    largest remainders (ties by name)."""
    exact = F.col(share) * total
    base = shares.withColumn("base", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    used = base.groupBy(*groups).agg((F.lit(total) - F.sum("base")).alias("open"))
    w = Window.partitionBy(*groups).orderBy(F.desc(F.round("rest", 9)), name)
    return base.withColumn("place", F.row_number().over(w)).join(used, groups).select(
        *groups, name, (F.col("base") + F.when(F.col("place") <= F.col("open"), 1).otherwise(0)).cast("long").alias("n")
    )


def draw_cells(plan: DataFrame, cells: DataFrame, slot: Column, keys: list[str] = KEYS) -> DataFrame:
    """Cells for a plan (keys, mixture, cell_type, draw), with replacement: the draw's
    ``slot`` modulo the number of cells of the type picks one. Counts of draws per cell.

    A plan that is made of few rows looks small to Spark however many draws it has, so both joins are told what to do:
    sizes, a row a type, are broadcast and never the plan; draws and cells meet sorted.
    """
    placed = numbered(cells.select(*keys, "cell_type", "cell_id"), [*keys, "cell_type"], ["cell_id"], "at")
    sizes = cells.groupBy(*keys, "cell_type").agg(F.count(F.lit(1)).alias("size"))
    drawn = plan.join(F.broadcast(sizes), [*keys, "cell_type"]).withColumn("at", F.pmod(slot, F.col("size")))
    counted = drawn.groupBy(*keys, "mixture", "cell_type", "at").agg(F.count(F.lit(1)).alias("times"))
    return counted.join(placed.hint("merge"), [*keys, "cell_type", "at"]).drop("at")


def drawn_shares(draws: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The truth of a pseudobulk, (keys, mixture, cell_type, truth): each type's share of the draws."""
    own = draws.groupBy(*keys, "mixture", "cell_type").agg(F.sum("times").alias("own"))
    total = own.groupBy(*keys, "mixture").agg(F.sum("own").alias("total"))
    return own.join(total, [*keys, "mixture"]).select(*keys, "mixture", "cell_type", (F.col("own") / F.col("total")).alias("truth"))


def pseudobulk(draws: DataFrame, counts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Expression of the drawn cells added up per mixture, columns summing to 1."""
    sums = draws.join(counts, [*keys, "cell_id"]).groupBy(*keys, "mixture", "gene")
    return normalize_columns(sums.agg(F.sum(F.col("times") * F.col("value")).alias("value")), "mixture", keys=keys)


def perturb_reference(signature: DataFrame, noise: Column, sigma: float, keys: list[str] = KEYS) -> DataFrame:
    """Values times exp(sigma * noise), then every column back to its old sum."""
    noisy = signature.withColumn("new", F.col("value") * F.exp(F.lit(sigma) * noise))
    sums = noisy.groupBy(*keys, "cell_type").agg((F.sum("value") / F.sum("new")).alias("scale"))
    return noisy.join(sums, [*keys, "cell_type"]).select(*keys, "gene", "cell_type", (F.col("new") * F.col("scale")).alias("value"))


def profile_correlation(profiles: DataFrame, name: str = "cell_type", keys: list[str] = KEYS) -> DataFrame:
    """Distance 1 - r of every two profiles of a tissue over all its genes, in [0, 2]; absent
    values are 0, without spread r counts as 0.

    A gene is one row with the values that are there: zeros add nothing to sums of products. Tasks add up a
    matrix of types x types a tissue over their genes, and hand on that many sums.
    """
    profiles = materialize(profiles, "correlation-profiles")
    packed = profiles.where(F.coalesce("value", F.lit(0.0)) != 0).groupBy(*keys, "gene").agg(F.collect_list(F.struct(F.col(name).alias("name"), "value")).alias("g"))
    packed = packed.select(*keys, F.col("g.name").alias("names"), F.col("g.value").alias("values"))
    kind = {f.name: f.dataType.simpleString() for f in profiles.schema}
    schema = ", ".join([f"`{k}` {kind[k]}" for k in keys] + [f"name_1 {kind[name]}", f"name_2 {kind[name]}", "xy double", "x double", "y double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[tuple, dict] = {}
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_dict("records"):
                key = tuple(row[k] for k in keys)
                own = at.setdefault(key, {})
                place = np.array([own.setdefault(n, len(own)) for n in row["names"]], int)
                have = sums.setdefault(key, np.zeros((8, 8, 3)))
                if len(own) > len(have):
                    wide = np.zeros((2 * len(own), 2 * len(own), 3))
                    wide[: len(have), : len(have)] = have
                    have = sums[key] = wide
                v = np.asarray(row["values"], float)
                have[np.ix_(place, place)] += np.stack([np.outer(v, v), *np.broadcast_arrays(v[:, None], v[None, :])], -1)
        out = []
        for key, own in at.items():
            for n, i in own.items():
                out += [(*key, n, m, *sums[key][i, j]) for m, j in own.items() if n <= m]
        yield pd.DataFrame(out, columns=[*keys, "name_1", "name_2", "xy", "x", "y"])

    pair = [*keys, "name_1", "name_2"]
    xy = packed.mapInPandas(run, schema).groupBy(*pair).agg(F.sum("xy").alias("xy"))
    xy = materialize(xy, "correlation-sums")
    every = profiles.select(*keys, F.col(name).alias("name")).distinct()
    total = profiles.groupBy(*keys, F.col(name).alias("name")).agg(F.sum("value").alias("s"))
    square = xy.where("name_1 = name_2").select(*keys, F.col("name_1").alias("name"), F.col("xy").alias("ss"))
    n = profiles.select(*keys, "gene").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    one = every.join(total, [*keys, "name"]).join(square, [*keys, "name"], "left").join(n, keys)
    mean = F.coalesce("s", F.lit(0.0)) / F.col("n")
    var = F.coalesce("ss", F.lit(0.0)) / F.col("n") - mean * mean
    # what is left of equal squares by rounding isn't spread
    one = one.select(*keys, "name", "n", mean.alias("m"), F.when(var > 1e-13 * F.coalesce("ss", F.lit(0.0)) / F.col("n"), F.sqrt(var)).alias("d"))
    one = materialize(one, "correlation-spread")
    side = lambda i: one.select(*keys, "n", F.col("name").alias(f"name_{i}"), F.col("m").alias(f"m{i}"), F.col("d").alias(f"d{i}"))
    both = side(1).join(side(2).drop("n"), keys).where("name_1 < name_2").join(xy, pair, "left")
    r = (F.coalesce("xy", F.lit(0.0)) / F.col("n") - F.col("m1") * F.col("m2")) / (F.col("d1") * F.col("d2"))
    return both.select(*pair, F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - F.coalesce(r, F.lit(0.0)))).alias("distance"))
