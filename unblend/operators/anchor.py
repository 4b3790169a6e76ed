"""Anchor genes: those that fit well and carry weight; the rest of the signature is recovered from them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.learn import Config
from ..functions.storage import materialize
from .normalize import KEYS, by_type, dense_bulk, dense_signature, joint_zscore_all, normalize_columns, shared_genes, signature_rows, types_of
from .solve import gram_stats, named, nnls_solve, simplex_ls
from .weighted import long_weights, usable_columns, weighted_deconvolve


def fitted(signature: DataFrame, proportions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """S P as (keys, gene, mixture, fitted): proportions are one array a mixture, signatures one a gene."""
    p = by_type(proportions, [*keys, "mixture"], types_of(signature, keys), "p", "p", keys).drop("types")
    s = signature_rows(signature, keys)
    dot = F.aggregate(F.zip_with("a", "p", lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
    return s.join(p, keys).select(*keys, "gene", "mixture", dot.alias("fitted"))


def anchor_gene_metrics(
    signature: DataFrame, bulk: DataFrame, proportions: DataFrame, weights: DataFrame, keys: list[str] = KEYS, epsilon: float = 1e-8
) -> DataFrame:
    """Per gene: residual_rms, relative_residual, mean_weight, normalized_weight, score, fitted_mean.

    Genes are those of both tables; a mixture that lacks one has 0 there."""
    bulk = dense_bulk(bulk, shared_genes(bulk, signature, keys), keys)
    both = fitted(signature, proportions, keys).join(bulk.withColumnRenamed("value", "b"), [*keys, "gene", "mixture"])
    gap = F.col("b") - F.col("fitted")
    stats = both.groupBy(*keys, "gene").agg(
        F.sqrt(F.avg(gap * gap)).alias("residual_rms"),
        (F.sqrt(F.avg(F.col("b") * F.col("b"))) + F.sqrt(F.avg(F.col("fitted") * F.col("fitted")))).alias("scale"),
        F.avg("fitted").alias("fitted_mean"),
    )
    stats = stats.withColumn("relative_residual", F.col("residual_rms") / F.greatest("scale", F.lit(epsilon)))
    mean = weights.groupBy(*keys, "gene").agg(F.avg("meta_weight").alias("mean_weight"))
    stats = stats.join(mean, [*keys, "gene"])
    span = stats.groupBy(*keys).agg(F.min("mean_weight").alias("lo"), F.max("mean_weight").alias("hi"))
    share = F.when(F.col("hi") - F.col("lo") <= epsilon, 1.0).otherwise((F.col("mean_weight") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return (
        stats.join(span, keys)
        .withColumn("normalized_weight", share)
        .withColumn("score", F.col("normalized_weight") / (F.col("relative_residual") + epsilon))
        .drop("scale", "lo", "hi")
    )


def select_anchors(
    metrics: DataFrame,
    fit_quantile: float = 0.25,
    weight_quantile: float = 0.75,
    at_least: int = 10,
    most: float = 0.5,
    keys: list[str] = KEYS,
    residual: str = "relative_residual",
) -> DataFrame:
    """The metrics with is_anchor: small residual and large weight; too few: the best by score; too many: the best of them."""
    cut = metrics.groupBy(*keys).agg(
        F.percentile(residual, F.lit(fit_quantile)).alias("fit_cut"),
        F.percentile("mean_weight", F.lit(weight_quantile)).alias("weight_cut"),
        F.count(F.lit(1)).alias("n"),
    )
    marked = metrics.join(cut, keys).withColumn("passes", (F.col(residual) <= F.col("fit_cut")) & (F.col("mean_weight") >= F.col("weight_cut")))
    passed = marked.groupBy(*keys).agg(F.sum(F.col("passes").cast("int")).alias("passed"))
    all_by = Window.partitionBy(*keys).orderBy(F.desc("score"), "gene")
    own_by = Window.partitionBy(*keys, "passes").orderBy(F.desc("score"), "gene")
    low = F.least(F.lit(max(1, at_least)), F.col("n"))
    high = F.least(F.greatest(low, F.ceil(F.lit(most) * F.col("n"))), F.col("n"))
    ranked = marked.join(passed, keys).withColumn("place", F.row_number().over(all_by)).withColumn("own", F.row_number().over(own_by))
    chosen = (
        F.when(F.col("passed") < low, F.col("place") <= low)
        .when(F.col("passed") > high, F.col("passes") & (F.col("own") <= high))
        .otherwise(F.col("passes"))
    )
    return ranked.withColumn("is_anchor", chosen).drop("fit_cut", "weight_cut", "n", "passes", "passed", "place", "own")


def anchor_rows(signature: DataFrame, bulk: DataFrame, anchors: DataFrame | None, keys: list[str] = KEYS) -> DataFrame:
    """Solver rows (a, b) of the anchor genes, without further scaling; a mixture that lacks a
    gene of both tables has 0 there."""
    bulk = dense_bulk(bulk, shared_genes(bulk, signature, keys), keys)
    rows = bulk.withColumnRenamed("value", "b").join(signature_rows(signature, keys).drop("types"), [*keys, "gene"])
    if anchors is not None:
        rows = rows.join(anchors.where("is_anchor").select(*keys, "gene"), [*keys, "gene"], "left_semi")
    return rows.select(*keys, "mixture", "gene", "a", "b")


def anchor_proportions(
    signature: DataFrame, bulk: DataFrame, anchors: DataFrame | None, keys: list[str] = KEYS, nonnegative: bool = False
) -> DataFrame:
    """(keys, mixture, cell_type, p) by simplex least squares on anchor genes only, or, if
    ``nonnegative``, by non-negative least squares and shares of its result."""
    by = [*keys, "mixture"]
    solve = nnls_solve if nonnegative else simplex_ls
    return named(solve(gram_stats(anchor_rows(signature, bulk, anchors, keys), by)), signature, by, keys, value="p")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _inverse(g: pd.Series) -> pd.Series:
    def one(x):
        k = int(round(len(x) ** 0.5))
        return np.linalg.pinv(np.asarray(x, float).reshape(k, k)).ravel()

    return g.map(one)


def recover_signature(
    signature: DataFrame,
    bulk: DataFrame,
    proportions: DataFrame,
    anchors: DataFrame,
    lam: float = 0.6,
    jitter: float = 1e-8,
    clip: bool = True,
    keys: list[str] = KEYS,
) -> DataFrame:
    """(keys, gene, cell_type, value, recovered, shift): non-anchor rows by ridge regression
    of the bulk on the proportions towards the signature; anchors stay as they are."""
    packed = by_type(proportions, [*keys, "mixture"], types_of(signature, keys), "p", "a", keys).withColumn("b", F.lit(0.0))
    k = packed.agg(F.max(F.size("a"))).first()[0] or 0
    gram = gram_stats(packed, keys, k=k).select(*keys, "h", F.size("l").alias("k"))
    eye = F.transform("h", lambda v, i: v + F.when(F.pmod(i, F.col("k") + 1) == 0, lam + jitter).otherwise(0.0))
    inverse = gram.select(*keys, "k", _inverse(eye).alias("inv"))
    mixed = bulk.join(packed.drop("b", "types"), [*keys, "mixture"]).groupBy(*keys, "gene").agg(
        *[F.sum(F.col("value") * F.coalesce(F.get("a", i), F.lit(0.0))).alias(f"r{i}") for i in range(k)]
    )
    rows = signature_rows(signature, keys).join(mixed, [*keys, "gene"]).join(inverse, keys)
    own = lambda xs: F.slice(F.array(*xs), F.lit(1), F.col("k"))
    right = F.zip_with(own([F.col(f"r{i}") for i in range(k)]), "a", lambda x, s: x + lam * s)
    rows = rows.withColumn("right", right)
    column = lambda j: F.aggregate(
        F.transform("right", lambda v, i: v * F.get("inv", i * F.col("k") + j)), F.lit(0.0), lambda t, v: t + v
    )
    solved = own([column(j) for j in range(k)])
    solved = F.transform(solved, lambda v: F.greatest(v, F.lit(0.0))) if clip else solved
    flags = anchors.select(*keys, "gene", "is_anchor")
    final = F.when(F.col("is_anchor"), F.col("a")).otherwise(F.col("solved"))
    out = rows.withColumn("solved", solved).join(flags, [*keys, "gene"]).withColumn("recovered", final)
    z = F.explode(F.arrays_zip("types", "a", "recovered")).alias("z")
    return out.select(*keys, "gene", "is_anchor", z).select(
        *keys,
        "gene",
        "is_anchor",
        F.col("z.types").alias("cell_type"),
        F.col("z.a").alias("value"),
        F.col("z.recovered").alias("recovered"),
        (F.col("z.recovered") - F.col("z.a")).alias("shift"),
    )


def reconstruction_error(signature: DataFrame, bulk: DataFrame, proportions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Root of the summed squares of B - S P per tissue, over the genes of both tables; what the bulk leaves out is 0."""
    bulk = dense_bulk(bulk, shared_genes(bulk, signature, keys), keys)
    both = fitted(signature, proportions, keys).join(bulk, [*keys, "gene", "mixture"])
    gap = F.col("value") - F.col("fitted")
    return both.groupBy(*keys).agg(F.sqrt(F.sum(gap * gap)).alias("error"))


#: Rows (a, b) by mixture to (by, proportions, genes, meta_weights, error), as ``weighted_deconvolve`` gives them.
Initial = Callable[[DataFrame, list[str]], DataFrame]


def anchor_recover(
    signature: DataFrame,
    bulk: DataFrame,
    cfg: Config = Config(),
    lam: float = 0.6,
    keys: list[str] = KEYS,
    preprocess_selection: bool = True,
    preprocess_proportions: bool = True,
    initial: Initial | None = None,
    **anchors,
) -> dict[str, DataFrame]:
    """The whole chain: proportions, initial ones, signature (recovered), metrics (genes), errors before and
    after, and failed: (keys, mixture, error) of mixtures that couldn't be normalised or solved, which nothing else uses.

    The first solve and the choice of anchors run on joint z-scores of shares, unless ``preprocess_selection`` is false: then on the
    values as they are. ``preprocess_proportions``: whether the proportions on anchor genes are solved on the same, or on the values as they are. ``initial``
    takes the place of the weighted solver under ``cfg``. ``anchors``: what ``select_anchors`` takes.
    """
    for name in ("fit_quantile", "weight_quantile"):
        if not 0 <= anchors.get(name, 0.5) <= 1:
            raise ValueError(f"{name} must be 0 to 1")
    if not 0 < anchors.get("most", 0.5) <= 1:
        raise ValueError("most must be above 0 and at most 1")
    by = [*keys, "mixture"]
    if preprocess_selection:
        signature, bulk, genes, unfit = usable_columns(signature, bulk, keys)
    else:
        genes = materialize(shared_genes(bulk, signature, keys), "genes")
        unfit = bulk.select(*by, F.lit(None).cast("string").alias("error")).where("false")
    signature = materialize(dense_signature(signature, genes, keys), "anchor-reference")
    bulk = materialize(dense_bulk(bulk, genes, keys), "anchor-bulk")
    s, b = signature, bulk
    if preprocess_selection:
        shares = normalize_columns(signature, "cell_type", keys=keys), normalize_columns(bulk, "mixture", keys=keys)
        s, b = joint_zscore_all(*shares, keys, dense=True)
    # solved once, though proportions, weights and errors all read it
    solver = initial or (lambda rows, groups: weighted_deconvolve(rows, groups, cfg))
    learned = materialize(solver(anchor_rows(s, b, None, keys), by), "anchor-initial")
    failed = unfit.unionByName(learned.where("error is not null").select(*by, "error"))
    solved = learned.where("error is null")
    b, bulk = b.join(solved.select(*by), by, "left_semi"), bulk.join(solved.select(*by), by, "left_semi")
    first = named(solved, s, by, keys, "proportions", "p")
    metrics = select_anchors(anchor_gene_metrics(s, b, first, long_weights(solved, by), keys), keys=keys, **anchors)
    metrics = materialize(metrics, "anchor-genes")
    p = anchor_proportions(*((s, b) if preprocess_proportions else (signature, bulk)), metrics, keys)
    p = materialize(p, "anchor-proportions")
    recovered = materialize(recover_signature(signature, bulk, p, metrics, lam, keys=keys), "anchor-signature")
    final = recovered.select(*keys, "gene", "cell_type", F.col("recovered").alias("value"))
    errors = reconstruction_error(signature, bulk, first, keys).withColumnRenamed("error", "initial_error").join(
        reconstruction_error(final, bulk, p, keys), keys
    )
    return {"proportions": p, "initial": first, "signature": recovered, "metrics": metrics, "errors": errors, "failed": failed}
