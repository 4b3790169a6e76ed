"""Deconvolution with learned gene weights: one row of packed genes per mixture."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.learn import PARTS, Config, deconvolve, stack_size
from ..functions.storage import materialize
from .normalize import KEYS, shared_genes, unusable
from .packed import pack_signature, solver_grams, solver_pack
from .solve import nnls_solve

#: Mixtures of a task, at most: a stack of them goes through the loop in step.
PER_TASK = 256
STATS = ["weight_min", "weight_mean", "weight_max", "total_min", "total_mean", "total_max"]


def pack(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per mixture: genes in order with their ``a`` and ``b`` (and ``c``, a confidence, if there)."""
    fields = ["gene", "a", "b", *(["c"] if "c" in rows.columns else [])]
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("g"))
    return packed.select(*by, *[F.col(f"g.{f}").alias(f) for f in fields])


def dealt(packed: DataFrame, by: list[str], per_task: int = PER_TASK) -> DataFrame:
    """The packed rows, written once, in as many tasks as their number and size ask for.

    The number of partitions is stated, as without one small rows end up in a single task,
    however long each keeps it busy: a task gets ``per_task`` mixtures, or a stack of them where that is fewer, but all cores get some. Rows go by a hash of their
    keys, so a task that is run again gets the same ones.
    """
    packed = materialize(packed, "packed")
    n, genes, k = packed.agg(F.count(F.lit(1)), F.max(F.size("b")), F.max(F.size(F.get("a", F.lit(0))))).first()
    per_task = min(per_task, stack_size(genes or 1, k or 1))
    cores = packed.sparkSession.sparkContext.defaultParallelism
    return packed.repartition(int(min(20_000, max(1, -(-n // per_task), min(cores, n // 16)))), *by)


def _stacks(batch: pd.DataFrame) -> Iterator[list[int]]:
    """Rows of one shape (genes, cell types), as many as a stack holds."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(batch["a"], batch["b"])):
        if b is not None:
            shapes.setdefault((len(b), len(a[0]) if len(b) else 0), []).append(i)
    for (genes, k), rows in shapes.items():
        most = stack_size(genes, k)
        yield from (rows[i : i + most] for i in range(0, len(rows), most))


def _solved(batch: pd.DataFrame, at: list[int], cfg: Config) -> Iterator[tuple[int, dict | str]]:
    """(row, its solution or what is wrong with it); a stack that fails is taken apart."""
    try:
        a = np.stack([np.stack(batch["a"].iloc[i]) for i in at]).astype(float)
        b = np.stack([np.asarray(batch["b"].iloc[i], float) for i in at])
        c = np.stack([np.asarray(batch["c"].iloc[i], float) for i in at]) if "c" in batch else None
        found = deconvolve(a, b, cfg, c)
    except (ValueError, np.linalg.LinAlgError) as e:
        if len(at) == 1:
            yield at[0], f"{type(e).__name__}: {e}"
        else:
            yield from _solved(batch, at[: len(at) // 2], cfg)
            yield from _solved(batch, at[len(at) // 2 :], cfg)
        return
    for j, i in enumerate(at):
        yield i, {name: v[j] for name, v in found.items()}


def weighted_deconvolve(rows: DataFrame, by: list[str], cfg: Config = Config(), per_task: int = PER_TASK) -> DataFrame:
    """Learned weights and proportions of every mixture of solver rows (see ``prepared``), or of rows that are
    packed already (see ``solver_pack``), whose errors stay.

    by, proportions, raw_solution (what they are shares of), initial_proportions, iterations, converged, change_history, genes,
    meta_weights, the weights' extremes and means, loss, what it is made of, error. A mixture that can't be
    solved is a row with its error. Mixtures of a task with equally many genes and cell types go through the loop in step, which
    changes no bit of their results, and nothing is exchanged inside it.
    """
    packed = rows if rows.schema["b"].dataType.typeName() == "array" else pack(rows, by)
    packed = dealt(packed, by, per_task)
    vector = T.ArrayType(T.DoubleType())
    number = T.DoubleType()
    fields = {
        "proportions": vector, "raw_solution": vector, "initial_proportions": vector, "iterations": T.IntegerType(), "converged": T.BooleanType(),
        "change_history": vector, "genes": packed.schema["gene"].dataType, "meta_weights": vector,
        **dict.fromkeys(STATS, number), "loss": number, **dict.fromkeys(PARTS, number), "error": T.StringType(),
    }
    schema = T.StructType([*[packed.schema[c] for c in by], *[T.StructField(n, t) for n, t in fields.items()]])

    def line(r: dict, genes: np.ndarray) -> list:
        return [
            r["proportions"], r["raw"], r["initial_proportions"], r["iterations"], r["converged"], r["change_history"], genes, r["meta_weights"],
            *map(float, r["weight_stats"]), float(r["loss"]), *[float(r[p]) for p in PARTS], None,
        ]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wrong = batch["error"] if "error" in batch else [None] * len(batch)
            out = [[*[None] * (len(fields) - 1), e] for e in wrong]
            for at in _stacks(batch):
                for i, r in _solved(batch, at, cfg):
                    out[i] = [*[None] * (len(fields) - 1), r] if isinstance(r, str) else line(r, batch["gene"].iloc[i])
            done = pd.DataFrame(out, columns=list(fields)).astype({"iterations": "Int32", "converged": "boolean"})
            yield pd.concat([batch[by].reset_index(drop=True), done], axis=1)

    return packed.mapInPandas(run, schema)


def long_weights(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, gene, meta_weight)"""
    pairs = F.explode(F.arrays_zip("genes", "meta_weights")).alias("z")
    return results.where("error is null").select(*by, pairs).select(*by, F.col("z.genes").alias("gene"), F.col("z.meta_weights").alias("meta_weight"))


def usable_columns(signature: DataFrame, bulk: DataFrame, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(signature, bulk, genes, failed): what can be normalised, over genes of both tables, and (keys, mixture,
    error) of mixtures that can't be, or whose tissue's signature can't. Failed rows are written once."""
    by = [*keys, "mixture"]
    genes = materialize(shared_genes(bulk, signature, keys), "genes")
    own = unusable(bulk, "mixture", genes, keys)
    broken = unusable(signature, "cell_type", genes, keys).groupBy(*keys).agg(F.min("error").alias("broken"))
    every = bulk.select(*by).distinct().join(own, by, "left").join(broken, keys, "left")
    failed = every.select(*by, F.coalesce("broken", "error").alias("error"), F.col("broken").isNotNull().alias("whole"))
    failed = materialize(failed.where("error is not null"), "failed")
    whole = failed.where("whole").select(*keys).distinct()
    return signature.join(whole, keys, "left_anti"), bulk.join(failed, by, "left_anti"), genes, failed.drop("whole")


def _by_hierarchy(signature: DataFrame, bulk: DataFrame, tree: DataFrame, node_leaf: DataFrame, cfg: Config, genes: int, keys: list[str]) -> DataFrame:
    """The leaves' masses as proportions, a row a mixture: local solves' iterations are added up, and all must converge."""
    from .tree import hierarchical_deconvolve

    by = [*keys, "mixture"]
    nodes = materialize(hierarchical_deconvolve(signature, bulk, tree, node_leaf, cfg, genes, keys), "nodes")
    leaves = nodes.where("is_leaf").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("node", "mass"))).alias("z"))
    # each parent's solve once: its children repeat what it took
    solves = nodes.groupBy(*by, "parent").agg(F.max("iterations").alias("i"), F.bool_and("converged").alias("c"), F.min("error").alias("e"))
    solves = solves.groupBy(*by).agg(F.sum("i").cast("int").alias("iterations"), F.bool_and("c").alias("converged"), F.min("e").alias("error"))
    shares = F.when(F.col("error").isNull(), F.col("z.mass"))
    return leaves.join(solves, by).select(*by, shares.alias("proportions"), "iterations", "converged", "error")


def deconvolve_batch(
    signature: DataFrame,
    bulk: DataFrame,
    cfg: Config = Config(),
    keys: list[str] = KEYS,
    tree: DataFrame | None = None,
    node_leaf: DataFrame | None = None,
    genes: int = 150,
    nnls_zscore: bool = True,
) -> DataFrame:
    """Every mixture by learned weights and by NNLS: (keys, mixture, method, proportions, iterations, converged, error).

    With a hierarchy (``tree``, ``node_leaf``) the first method goes down it and is called
    ``hierarchical``. A mixture that can't be normalised is a row with its error for each method, as is
    every mixture of a tissue whose signature can't; the others aren't touched by it. ``nnls_zscore``: whether the second
    method gets joint z-scores, as the first does, or shares.
    """
    by = [*keys, "mixture"]
    none = lambda kind: F.lit(None).cast(kind)
    if tree is None:
        signed = pack_signature(signature, bulk, keys)
        name, learned = "weighted", weighted_deconvolve(solver_pack(signature, bulk, keys, packed=signed), by, cfg)
        left = None
    else:
        signature, bulk, shared, failed = usable_columns(signature, bulk, keys)
        signed = pack_signature(signature, bulk, keys, shared)
        name, learned = "hierarchical", _by_hierarchy(signature, bulk, tree, node_leaf, cfg, genes, keys)
        left = failed.withColumn("method", F.explode(F.array(F.lit(name), F.lit("nnls")))).select(
            *by, "method", none("array<double>").alias("proportions"), none("int").alias("iterations"), none("boolean").alias("converged"), "error"
        )
    learned = learned.select(*by, F.lit(name).alias("method"), "proportions", "iterations", "converged", "error")
    plain = nnls_solve(solver_grams(signature, bulk, keys, zscore=nnls_zscore, packed=signed)).select(
        *by, F.lit("nnls").alias("method"), F.when(F.col("error").isNull(), F.col("x")).alias("proportions"), none("int").alias("iterations"),
        none("boolean").alias("converged"), "error",
    )
    both = learned.unionByName(plain)
    return both if left is None else both.unionByName(left)
