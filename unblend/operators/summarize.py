"""Summaries, comparisons and winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .normalize import KEYS


def summarize_detail(metrics: DataFrame, by: list[str], also: list[str]) -> DataFrame:
    """Counts, means and medians per ``by`` and, in the same pass, per ``by`` with ``also``
    (null there: all). Converged is null where no row says."""
    means = ["mae", "rmse", "pearson", "rare_mae"]
    return (
        metrics.groupingSets([[F.col(c) for c in by], [F.col(c) for c in [*by, *also]]], *[F.col(c) for c in [*by, *also]])
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[f(c).alias(f"{n}_{c}") for c in ("l1", "accuracy") for n, f in (("mean", F.avg), ("median", F.median))],
            *[F.avg(c).alias(f"mean_{c}") for c in means],
            F.sum(F.col("error").isNotNull().cast("long")).alias("errors"),
            F.sum(F.col("converged").cast("long")).alias("converged"),
            F.avg("iterations").alias("mean_iterations"),
        )
        .select(*by, *also, "n", "mean_l1", "median_l1", "mean_accuracy", "median_accuracy", *[f"mean_{c}" for c in means], "errors", "converged", "mean_iterations")
    )


def method_summaries(metrics: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows without error, by method, method and dataset, and method, dataset and tissue at
    once; a null stands for all."""
    sets = [["method"], ["method", "dataset"], ["method", "dataset", *keys]]
    cols = sets[-1]
    out = metrics.where("error is null").groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    return out.agg(
        F.countDistinct("dataset").alias("datasets"),
        F.countDistinct("dataset", *keys).alias("cases"),
        F.count(F.lit(1)).alias("n"),
        F.avg("l1").alias("mean_l1"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.median("l1").alias("median_l1"),
    )


def compare_methods(metrics: DataFrame, one: str, other: str, keys: list[str] = KEYS) -> DataFrame:
    """Two methods side by side per tissue and over all (null tissue), with what the first gains."""
    pick = lambda m, c: F.avg(F.when(F.col("method") == m, F.col(c)))
    sets = metrics.where(F.col("method").isin(one, other)).groupingSets([[], [F.col(k) for k in keys]], *[F.col(k) for k in keys])
    out = sets.agg(
        pick(one, "accuracy").alias("accuracy_1"), pick(other, "accuracy").alias("accuracy_2"),
        pick(one, "l1").alias("l1_1"), pick(other, "l1").alias("l1_2"),
    )
    return out.select(
        *keys, "accuracy_1", "accuracy_2", "l1_1", "l1_2",
        (F.col("accuracy_1") - F.col("accuracy_2")).alias("delta_accuracy"), (F.col("l1_1") - F.col("l1_2")).alias("delta_l1"),
    )


def _place(methods: list[str]) -> Column:
    """A method's place in the given order; ties between methods go by it."""
    return F.array_position(F.array(*[F.lit(m) for m in methods]), F.col("method"))


def l1_pivot_rank(metrics: DataFrame, methods: list[str], ranked: str, keys: list[str] = KEYS) -> DataFrame:
    """Per tissue each method's mean L1, the best method and its value, and one method's rank (ties share the better)."""
    mean = metrics.groupBy(*keys, "method").agg(F.avg("l1").alias("l1"))
    wide = mean.groupBy(*keys).pivot("method", methods).agg(F.first("l1"))
    w = Window.partitionBy(*keys)
    best = mean.withColumn("rank", F.rank().over(w.orderBy(F.round("l1", 12)))).withColumn("place", _place(methods))
    best = best.groupBy(*keys).agg(
        F.min_by("method", F.struct(F.round("l1", 12), "place")).alias("best_method"),
        F.min("l1").alias("best_l1"),
        F.max(F.when(F.col("method") == ranked, F.col("rank"))).alias("rank"),
    )
    return wide.join(best, keys)


def celltype_summary(detail: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per cell type and method: truth and errors, over all rows and over rare ones, in one pass."""
    rare = F.col("is_rare")
    return detail.groupBy(*keys, "cell_type", "method").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("truth").alias("mean_truth"),
        F.median("truth").alias("median_truth"),
        F.avg("abs_error").alias("mae"),
        F.median("abs_error").alias("median_ae"),
        F.sum(rare.cast("long")).alias("n_rare"),
        F.avg(F.when(rare, F.col("truth"))).alias("rare_mean_truth"),
        F.avg(F.when(rare, F.col("abs_error"))).alias("rare_mae"),
        F.median(F.when(rare, F.col("abs_error"))).alias("rare_median_ae"),
    )


def winners(summary: DataFrame, error: str, methods: list[str], ranked: str, keys: list[str] = KEYS) -> DataFrame:
    """Per cell type the best and second best method, their margin, and how one method does.

    Methods without a value come last; equal values go by the order of ``methods``.
    """
    by = [*keys, "cell_type"]
    grid = summary.select(*by).distinct().withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    full = grid.join(summary.select(*by, "method", F.round(error, 12).alias("e")), [*by, "method"], "left").withColumn("place", _place(methods))
    w = Window.partitionBy(*by)
    full = full.withColumn("nth", F.row_number().over(w.orderBy(F.col("e").asc_nulls_last(), "place")))
    full = full.withColumn("rank", F.when(F.col("e").isNotNull(), F.rank().over(w.orderBy(F.col("e").asc_nulls_last()))))
    at = lambda n, c: F.max(F.when(F.col("nth") == n, F.col(c)))
    out = full.groupBy(*by).agg(
        at(1, "method").alias("best_method"),
        at(2, "method").alias("second_method"),
        at(1, "e").alias("best_error"),
        at(2, "e").alias("second_error"),
        F.max(F.when(F.col("method") == ranked, F.col("rank"))).alias("rank"),
    )
    margin = F.col("second_error") - F.col("best_error")
    return out.withColumn("margin", margin).withColumn(
        "relative_margin", F.when(F.col("second_error") > 0, margin / F.col("second_error"))
    ).withColumn("is_best", F.col("best_method") == ranked)


def rare_winners(detail: DataFrame, methods: list[str], ranked: str, at_least: int = 5, keys: list[str] = KEYS) -> DataFrame:
    """Winners on rare rows where every method that has the type has ``at_least`` of them."""
    summary = celltype_summary(detail, keys)
    enough = summary.groupBy(*keys, "cell_type").agg(F.max("n_rare").alias("n_rare"), F.avg("rare_mean_truth").alias("rare_mean_truth"))
    enough = enough.where(F.col("n_rare") >= at_least)
    return winners(summary.join(enough.select(*keys, "cell_type"), [*keys, "cell_type"], "left_semi"), "rare_mae", methods, ranked, keys).join(
        enough, [*keys, "cell_type"]
    )


def low_mean_winners(detail: DataFrame, methods: list[str], ranked: str, below: float = 0.05, keys: list[str] = KEYS) -> DataFrame:
    """Winners over all mixtures for cell types whose mean truth is below a bound."""
    summary = celltype_summary(detail, keys)
    low = summary.groupBy(*keys, "cell_type").agg(F.avg("mean_truth").alias("mean_truth")).where(F.col("mean_truth") < below)
    return winners(summary.join(low, [*keys, "cell_type"], "left_semi"), "mae", methods, ranked, keys).join(low, [*keys, "cell_type"])


def rare_method_summary(detail: DataFrame) -> DataFrame:
    return detail.where("is_rare").groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"), F.median("abs_error").alias("median_ae")
    )


def cumulative_windows(metrics: DataFrame, bounds: list[int], value: str, passing: float, by: list[str], idx: str = "mixture_idx") -> DataFrame:
    """Metrics over the mixtures up to each bound. Each row goes to the first bound that
    holds it once, and bounds above it are reached by exploding that short list."""
    up = metrics.withColumn("upto", F.explode(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col(idx) <= b)))
    v = F.col(value)
    return up.groupBy(*by, "upto").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"),
        F.avg((v >= passing).cast("double")).alias("pass_rate"), F.min(v).alias("min"),
    )


def numeric_summary(table: DataFrame, by: list[str], metrics: list[str], against: str | None = None) -> DataFrame:
    """Mean, deviation (n - 1), range and quantiles of several columns, one row a metric; with
    ``against``, a column, also the mean difference from it and the mean size of that."""
    kept = [*by, *([against] if against else [])]
    long = table.select(*kept, *[F.col(m).cast("double") for m in metrics]).unpivot(kept, metrics, "metric", "value").where("value is not null")
    q = F.percentile("value", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    gap = [] if against is None else [F.col("value") - F.col(against)]
    out = long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), q.alias("q"),
        *[F.avg(g).alias("mean_delta") for g in gap], *[F.avg(F.abs(g)).alias("mean_abs_delta") for g in gap],
    )
    names = ("q05", "q25", "median", "q75", "q95")
    deltas = ["mean_delta", "mean_abs_delta"] if against else []
    return out.select(*by, "metric", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(names)], "max", *deltas)


def _blocks(gene: str, blocks: list[tuple[str, int, int]]) -> Column:
    """The names of the blocks of gene places [start, end) that hold a gene."""
    inside = F.array(*[F.when((F.col(gene) >= a) & (F.col(gene) < b), F.lit(n)) for n, a, b in blocks])
    return F.filter(inside, lambda x: x.isNotNull())


def weight_block_summary(weights: DataFrame, blocks: list[tuple[str, int, int]], keys: list[str] = KEYS) -> DataFrame:
    """Weights per block of gene places [start, end): genes, mean, median and 90 % quantile."""
    placed = weights.withColumn("block", F.explode(_blocks("gene", blocks)))
    return placed.groupBy(*keys, "block").agg(
        F.countDistinct("gene").alias("genes"), F.avg("meta_weight").alias("mean_weight"),
        F.median("meta_weight").alias("median_weight"), F.percentile("meta_weight", F.lit(0.9)).alias("p90_weight"),
    )


def signature_block_means(signature: DataFrame, blocks: list[tuple[str, int, int]], keys: list[str] = KEYS) -> DataFrame:
    """(keys, block, cell_type, genes, mean_value): each type's mean over the genes of a block; absent values are 0."""
    placed = signature.withColumn("block", F.explode(_blocks("gene", blocks)))
    genes = placed.groupBy(*keys, "block").agg(F.countDistinct("gene").alias("genes"))
    sums = placed.groupBy(*keys, "block", "cell_type").agg(F.sum("value").alias("total"))
    return sums.join(genes, [*keys, "block"]).select(*keys, "block", "cell_type", "genes", (F.col("total") / F.col("genes")).alias("mean_value"))


def gene_weight_stats(weights: DataFrame, floor: float = 1.0, keys: list[str] = KEYS) -> DataFrame:
    """Per gene over mixtures: mean, median and deviation, share above 1, and whether all are at the floor."""
    w = F.col("meta_weight")
    return weights.groupBy(*keys, "gene").agg(
        F.avg(w).alias("mean_weight"), F.median(w).alias("median_weight"), F.stddev_samp(w).alias("std_weight"),
        F.avg((w > 1).cast("double")).alias("share_above_1"), (F.max(w) <= floor + 1e-9).alias("at_floor"),
    )
