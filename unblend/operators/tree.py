"""Deconvolution down a hierarchy of cell types."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.learn import Config
from ..functions.linkage import linkage_tree
from ..functions.storage import materialize
from .normalize import KEYS, dense_bulk, shared_genes
from .profiles import aggregate_profiles_by_node, leaf_grid, split_gene_selection
from .weighted import weighted_deconvolve


def _at_root(mixtures: DataFrame, tree: DataFrame, name: str) -> DataFrame:
    """Each row at the root: a hierarchy is a few dozen names, so the root's is looked up once."""
    roots = [r[0] for r in tree.where("parent is null").select("node").collect()]
    return mixtures.withColumn(name, F.explode(F.array(*map(F.lit, roots)).cast("array<string>")))


def parent_local_bulk(bulk: DataFrame, masses: DataFrame, node_profiles: DataFrame, floor: float = 1e-12, keys: list[str] = KEYS) -> DataFrame:
    """For each mixture and node of a level what the node's children have to explain:
    its mass times (its profile + what the whole level leaves of the bulk), at least ``floor``."""
    level = masses.join(node_profiles.withColumnRenamed("value", "profile"), [*keys, "node"])
    fit = level.groupBy(*keys, "mixture", "gene").agg(F.sum(F.col("mass") * F.col("profile")).alias("fit"))
    rest = bulk.join(fit, [*keys, "mixture", "gene"]).withColumn("rest", F.col("value") - F.col("fit"))
    local = F.greatest(F.col("mass"), F.lit(floor)) * (F.col("profile") + F.col("rest"))
    return rest.drop("value", "fit").join(level, [*keys, "mixture", "gene"]).select(
        *keys, "mixture", "node", "gene", F.greatest(local, F.lit(floor)).alias("value")
    )


def propagate_masses(raw: DataFrame, tree: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, mixture, node, mass) of all nodes from raw shares of siblings: shares of their
    sum (equal ones where it is 0) times the parent's mass; the root has 1."""
    edges = tree.select("node", "parent", "depth")
    placed = raw.join(edges.where("parent is not null"), "node").withColumn("raw", F.greatest("raw", F.lit(0.0)))
    total = placed.groupBy(*keys, "mixture", "parent").agg(F.sum("raw").alias("t"), F.count(F.lit(1)).alias("n"))
    local = placed.join(total, [*keys, "mixture", "parent"]).withColumn(
        "local", F.when(F.col("t") > 0, F.col("raw") / F.col("t")).otherwise(1.0 / F.col("n"))
    )
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    level = _at_root(raw.select(*keys, "mixture").distinct(), tree, "node").withColumn("mass", F.lit(1.0))
    out = level
    for depth in range(1, deepest + 1):
        up = level.select(*keys, "mixture", F.col("node").alias("parent"), F.col("mass").alias("above"))
        level = local.where(F.col("depth") == depth).join(up, [*keys, "mixture", "parent"])
        level = level.select(*keys, "mixture", "node", (F.col("above") * F.col("local")).alias("mass"))
        out = out.unionByName(level)
    return out


def hierarchical_deconvolve(
    signature: DataFrame,
    bulk: DataFrame,
    tree: DataFrame,
    node_leaf: DataFrame,
    cfg: Config = Config(),
    genes: int = 150,
    keys: list[str] = KEYS,
) -> DataFrame:
    """(keys, mixture, node, parent, depth, is_leaf, raw, mass, iterations, converged, error), one Spark pass per level.

    Each node with several children is solved over its children's profiles on the genes
    that tell them apart; an only child takes its parent's mass. What is chosen per node
    (profiles, genes) is worked out once a tissue, not once a mixture. Genes are those that a
    tissue has in both tables; values that either table leaves out are 0. All nodes below one that
    can't be solved are rows with its error and without raw and mass; it counts whole in the rest.
    """
    by = [*keys, "mixture", "parent"]
    shared = materialize(shared_genes(bulk, signature, keys), "tree-shared")
    signature = materialize(leaf_grid(signature.join(shared, [*keys, "gene"], "left_semi"), node_leaf, keys), "tree-reference")
    bulk = materialize(dense_bulk(bulk, shared, keys), "tree-bulk")
    profiles = materialize(aggregate_profiles_by_node(signature, node_leaf, keys), "tree-profiles")
    picked = split_gene_selection(signature, tree, node_leaf, genes, keys).select(*keys, "parent", "gene")
    picked = materialize(picked, "tree-genes")
    edges = tree.select("node", "parent", "depth", "is_leaf")
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    local = _at_root(bulk, tree, "parent")
    mass = _at_root(bulk.select(*keys, "mixture").distinct(), tree, "parent").withColumn("above", F.lit(1.0))
    mass = mass.withColumn("failed", F.lit(None).cast("string"))
    out, stuck = None, None
    for depth in range(1, deepest + 1):
        here = edges.where(F.col("depth") == depth)
        child = profiles.join(here, "node").join(picked, [*keys, "parent", "gene"], "left_semi")
        packed = child.groupBy(*keys, "parent", "gene").agg(F.array_sort(F.collect_list(F.struct("node", "value"))).alias("s"))
        rows = local.join(packed, [*keys, "parent", "gene"]).select(*by, "gene", F.col("s.value").alias("a"), F.col("value").alias("b"))
        solved = weighted_deconvolve(rows, by, cfg).select(*by, "proportions", "iterations", "converged", "error")
        names = here.groupBy("parent").agg(F.array_sort(F.collect_list("node")).alias("names"))
        # from the masses and not from the solutions, so that no parent is lost
        each = mass.join(names, "parent").join(solved, by, "left")
        open_, single = F.col("failed").isNull(), F.size("names") == 1
        unsolved = F.coalesce("error", F.when(F.col("proportions").isNull(), F.lit("no genes to solve on")))
        each = each.select(
            *by, "above", F.coalesce("failed", F.when(~single, unsolved)).alias("error"),
            F.when(open_ & single, 0).when(open_, F.col("iterations")).alias("iterations"),
            F.when(open_ & single, True).when(open_, F.col("converged")).alias("converged"),
            F.when(open_ & single, F.array(F.lit(1.0))).when(open_, F.col("proportions")).alias("x"),
            F.posexplode("names").alias("at", "node"),
        )
        level = each.withColumn("raw", F.get("x", F.col("at"))).withColumn("mass", F.col("above") * F.col("raw")).drop("x", "at")
        level = materialize(level.join(here.select("node", "depth", "is_leaf"), "node"), "tree-level")
        out = level if out is None else out.unionByName(level)
        if depth == deepest:
            break
        # leaves that are already reached, and parents that failed, stay part of what the level explains
        failed = level.where("mass is null and above is not null")
        failed = failed.select(*keys, "mixture", F.col("parent").alias("node"), F.col("above").alias("mass")).distinct()
        stuck = failed if stuck is None else stuck.unionByName(failed)
        visible = out.where(((F.col("depth") == depth) | F.col("is_leaf")) & F.col("mass").isNotNull()).select(*keys, "mixture", "node", "mass")
        local = parent_local_bulk(bulk, visible.unionByName(stuck), profiles, cfg.weight_floor, keys).withColumnRenamed("node", "parent")
        mass = level.where(~F.col("is_leaf")).select(
            *keys, "mixture", F.col("node").alias("parent"), F.col("mass").alias("above"), F.col("error").alias("failed")
        )
        local = local.join(mass.where("failed is null").select(*by), by, "left_semi")
    return out.select(*keys, "mixture", "node", "parent", "depth", "is_leaf", "raw", "mass", "iterations", "converged", "error")


def build_hierarchy(distances: DataFrame, groups: int | None = None, method: str = "average", keys: list[str] = KEYS) -> DataFrame:
    """Trees from (keys, name_1, name_2, distance): (keys, node, parent, depth, child_pos,
    is_leaf, distance, coarse), where coarse numbers the group a leaf falls in when the highest
    merges are undone (by default into about the root of the number of leaves)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distances.schema if f.name in keys)
    schema = f"{kinds}, node string, parent string, depth int, child_pos int, is_leaf boolean, distance double, coarse int"

    def build(part: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(part["name_1"]) | set(part["name_2"]))
        at = {n: i for i, n in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        for x, y, v in zip(part["name_1"], part["name_2"], part["distance"]):
            d[at[x], at[y]] = d[at[y], at[x]] = v
        out = pd.DataFrame(linkage_tree(names, d, method, groups), columns=schema_names)
        for k in reversed(keys):
            out.insert(0, k, part[k].iloc[0])
        return out

    schema_names = ["node", "parent", "depth", "child_pos", "is_leaf", "distance", "coarse"]
    return distances.groupBy(*keys).applyInPandas(build, schema)
