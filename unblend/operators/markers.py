"""Marker genes from single cells, and markers against learned weights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pvalues
from ..functions.columns import guarded_corr, mid_rank
from .normalize import KEYS


def value_counts(counts: DataFrame, cells: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """How many cells of a type show a gene at each value; what the tests need of the cells.

    The rows of a gene shrink to its distinct values before anything is sorted,
    so a gene that every cell shows is no larger than its values are many. Zeros
    that aren't stored are added as a row of their own.
    """
    seen = counts.where("value > 0").join(cells.select(*keys, "cell_id", "cell_type"), [*keys, "cell_id"])
    seen = seen.groupBy(*keys, "gene", "value", "cell_type").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy(*keys, "cell_type").agg(F.count(F.lit(1)).alias("size"))
    grid = counts.select(*keys, "gene").distinct().join(sizes, keys)
    shown = seen.groupBy(*keys, "gene", "cell_type").agg(F.sum("n").alias("shown"))
    zeros = grid.join(shown, [*keys, "gene", "cell_type"], "left").select(
        *keys, "gene", F.lit(0.0).alias("value"), "cell_type", (F.col("size") - F.coalesce("shown", F.lit(0))).alias("n")
    )
    return seen.unionByName(zeros)


def detection_and_fold_change(dist: DataFrame, pseudo: float = 0.1, keys: list[str] = KEYS) -> DataFrame:
    """Each type against the rest: means, shares of cells that show the gene, log2 fold change."""
    own = dist.groupBy(*keys, "gene", "cell_type").agg(
        F.sum(F.col("n") * F.col("value")).alias("s"), F.sum(F.when(F.col("value") > 0, F.col("n")).otherwise(0)).alias("d"), F.sum("n").alias("c")
    )
    total = own.groupBy(*keys, "gene").agg(F.sum("s").alias("ts"), F.sum("d").alias("td"), F.sum("c").alias("tc"))
    both = own.join(total, [*keys, "gene"])
    rest = lambda x: F.when(F.col("tc") > F.col("c"), x / (F.col("tc") - F.col("c")))
    out = both.select(
        *keys, "gene", "cell_type",
        F.col("c").alias("n_in"), (F.col("tc") - F.col("c")).alias("n_out"),
        (F.col("s") / F.col("c")).alias("mean_in"), rest(F.col("ts") - F.col("s")).alias("mean_out"),
        (F.col("d") / F.col("c")).alias("pct_in"), rest(F.col("td") - F.col("d")).alias("pct_out"),
    )
    fold = F.log2((F.col("mean_in") + pseudo) / (F.col("mean_out") + pseudo))
    return out.withColumn("log2fc", fold).withColumn("pct_diff", F.col("pct_in") - F.col("pct_out"))


def rank_sum_test(dist: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Each type against the rest per gene: U, its tie-corrected variance, z with
    continuity correction and the one-sided p (1 where nothing varies).

    Ranks come from counts: a value's mean rank is the number of cells below it plus half
    of those at it, so windows run over distinct values and not over cells.
    """
    gene = [*keys, "gene"]
    at = dist.groupBy(*gene, "value").agg(F.sum("n").alias("t"))
    before = Window.partitionBy(*gene).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranks = at.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2.0)
    cube = F.col("t").cast("double")
    ties = at.groupBy(*gene).agg(F.sum(cube * cube * cube - cube).alias("ties"), F.sum("t").alias("total"))
    own = dist.join(ranks.drop("t"), [*gene, "value"]).groupBy(*gene, "cell_type").agg(
        F.sum(F.col("n") * F.col("rank")).alias("rank_sum"), F.sum("n").alias("n_in")
    )
    both = own.join(ties, gene).withColumn("n_out", F.col("total") - F.col("n_in"))
    n, m, t = F.col("n_in").cast("double"), F.col("n_out").cast("double"), F.col("total").cast("double")
    var = F.when(t > 1, n * m / 12.0 * ((t + 1) - F.col("ties") / (t * (t - 1)))).otherwise(0.0)
    out = both.select(*gene, "cell_type", (F.col("rank_sum") - n * (n + 1) / 2).alias("u"), var.alias("u_variance"), (n * m / 2).alias("mean"))
    z = F.when(F.col("u_variance") > 0, (F.col("u") - F.col("mean") - 0.5) / F.sqrt("u_variance")).otherwise(0.0)
    out = out.withColumn("z", z).drop("mean")
    return out.withColumn("p", F.when(F.col("u_variance") > 0, pvalues.normal_sf_column("z")).otherwise(1.0))


def bh_fdr(tests: DataFrame, p: str, by: list[str], order: list[str | Column]) -> DataFrame:
    """Adds fdr: p * n / rank made monotone from the largest p down, in [0, 1], per ``by``. Tests
    without a p don't count and have none."""
    w = Window.partitionBy(*by)
    first = [F.col(p).asc_nulls_last(), *order]
    ranked = tests.withColumn("_r", F.row_number().over(w.orderBy(*first))).withColumn("_n", F.count(p).over(w))
    down = w.orderBy("_r").rowsBetween(0, Window.unboundedFollowing)
    fdr = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(down)))
    return ranked.withColumn("fdr", F.when(F.col(p).isNotNull(), fdr)).drop("_r", "_n")


def call_markers(de: DataFrame, known: DataFrame, fdr: float = 0.05, log2fc: float = 1.0, pct: float = 0.1, keys: list[str] = KEYS) -> DataFrame:
    """Adds is_marker and in_list, whether a known list (keys, cell_type, gene) has it."""
    listed = known.select(*keys, "cell_type", "gene").distinct().withColumn("_in", F.lit(True))
    hit = (F.col("fdr") < fdr) & (F.col("log2fc") > log2fc) & (F.col("pct_in") >= pct)
    return de.join(listed, [*keys, "cell_type", "gene"], "left").withColumn("is_marker", F.coalesce(hit, F.lit(False))).withColumn(
        "in_list", F.coalesce("_in", F.lit(False))
    ).drop("_in")


def primary_marker(called: DataFrame, genes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """For every gene the type it marks most (fold change, then difference of shares), or null."""
    w = Window.partitionBy(*keys, "gene").orderBy(F.desc(F.round("log2fc", 9)), F.desc(F.round("pct_diff", 9)), "cell_type")
    top = called.where("is_marker").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    top = top.select(*keys, "gene", F.col("cell_type").alias("primary_type"), "log2fc", "pct_diff")
    return genes.select(*keys, "gene").distinct().join(top, [*keys, "gene"], "left")


def marker_composition(primary: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Genes per primary type, ``Unassigned`` among them, and their share of the tissue's."""
    n = primary.groupBy(*keys, F.coalesce("primary_type", F.lit("Unassigned")).alias("primary_type")).agg(F.count(F.lit(1)).alias("genes"))
    total = n.groupBy(*keys).agg(F.sum("genes").alias("total"))
    return n.join(total, keys).select(*keys, "primary_type", "genes", (F.col("genes") / F.col("total")).alias("share"))


def marker_weight_table(called: DataFrame, stats: DataFrame, top: float = 0.9, keys: list[str] = KEYS) -> DataFrame:
    """Markers beside the genes' mean weights: above 1, and in the top part of their target's genes."""
    both = called.join(stats.select(*keys, "gene", "mean_weight"), [*keys, "gene"])
    cut = both.groupBy(*keys, "cell_type").agg(F.percentile("mean_weight", F.lit(top)).alias("cut"))
    return both.join(cut, [*keys, "cell_type"]).withColumn("above_1", F.col("mean_weight") > 1).withColumn(
        "in_top", F.col("mean_weight") >= F.col("cut")
    ).drop("cut")


def marker_weight_by_mixture(weights: DataFrame, markers: DataFrame, truth: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per target and mixture the mean weight of its markers and of other genes, and its true share.

    Sums of all genes come once per mixture; a target's other genes are what its markers leave."""
    all_ = weights.groupBy(*keys, "mixture").agg(F.sum("meta_weight").alias("s"), F.count(F.lit(1)).alias("c"))
    own = weights.join(markers.select(*keys, "cell_type", "gene").distinct(), [*keys, "gene"]).groupBy(*keys, "cell_type", "mixture")
    own = own.agg(F.sum("meta_weight").alias("ms"), F.count(F.lit(1)).alias("mc"))
    out = own.join(all_, [*keys, "mixture"]).join(truth, [*keys, "mixture", "cell_type"], "left")
    return out.select(
        *keys, "cell_type", "mixture", (F.col("ms") / F.col("mc")).alias("marker_weight"),
        F.when(F.col("c") > F.col("mc"), (F.col("s") - F.col("ms")) / (F.col("c") - F.col("mc"))).alias("other_weight"), "truth",
    )


def marker_weight_enrichment(table: DataFrame, by_mixture: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per target: what weights its markers have against other genes.

    Means, the 2 x 2 table of the top part with its odds ratio, Mann-Whitney's U, the
    signed-rank sum over mixtures and the correlations with the truth.
    """
    by = [*keys, "cell_type"]
    m = F.col("is_marker")
    ranked = table.withColumn("rank", mid_rank("mean_weight", by))
    same = table.groupBy(*by, "mean_weight").agg(F.count(F.lit(1)).cast("double").alias("t"))
    ties = same.groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    stats = ranked.groupBy(*by).agg(
        count(m).alias("n_markers"), F.count(F.lit(1)).alias("n_genes"),
        F.avg(F.when(m, F.col("mean_weight"))).alias("marker_mean"), F.avg(F.when(~m, F.col("mean_weight"))).alias("other_mean"),
        F.median(F.when(m, F.col("mean_weight"))).alias("marker_median"),
        count(m & F.col("in_top")).alias("top_markers"), count(~m & F.col("in_top")).alias("top_others"),
        count(m & F.col("above_1")).alias("markers_above_1"), F.sum(F.when(m, F.col("rank"))).alias("rank_sum"),
    )
    n = F.col("n_markers").cast("double")
    a, c = F.col("top_markers"), F.col("top_others")
    b, d = F.col("n_markers") - a, F.col("n_genes") - F.col("n_markers") - c
    stats = stats.join(ties, by).withColumn("u", F.col("rank_sum") - n * (n + 1) / 2).withColumn("ratio", F.col("marker_mean") / F.col("other_mean"))
    stats = stats.withColumn("odds_ratio", F.when(b * c > 0, a * d / (b * c).cast("double"))).drop("rank_sum")
    gaps = by_mixture.withColumn("gap", F.col("marker_weight") - F.col("other_weight")).where("gap is not null")
    some = gaps.where("gap <> 0").withColumn("size", F.round(F.abs("gap"), 12)).withColumn("r", mid_rank("size", by))
    pairs = some.groupBy(*by).agg(F.sum(F.when(F.col("gap") > 0, F.col("r")).otherwise(0.0)).alias("w"), F.count(F.lit(1)).alias("n_pairs"))
    equal = some.groupBy(*by, "size").agg(F.count(F.lit(1)).cast("double").alias("t"))
    equal = equal.groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("pair_ties"))
    both = gaps.where("truth is not null").withColumn("rt", mid_rank("truth", by)).withColumn("rw", mid_rank("marker_weight", by))
    corr = both.groupBy(*by).agg(
        guarded_corr("truth", "marker_weight").alias("pearson"), guarded_corr("rt", "rw").alias("spearman"),
        F.count(F.lit(1)).alias("n_mixtures"), F.avg("gap").alias("mean_gap"),
    )
    return stats.join(pairs, by, "left").join(equal, by, "left").join(corr, by, "left")


def enrichment_p(stats: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Adds the p-values of ``marker_weight_enrichment``'s statistics and their FDR over targets."""

    def whole(f, *cols):
        @F.pandas_udf("double")
        def p(*columns: pd.Series) -> pd.Series:
            return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*columns)], dtype=float)

        return p(*[F.col(c) if isinstance(c, str) else c for c in cols])

    other = F.col("n_genes") - F.col("n_markers")
    out = stats.withColumn("mann_whitney_p", whole(pvalues.mann_whitney_greater, "u", "n_markers", other, "ties"))
    fisher = whole(
        lambda a, b, c, d: pvalues.fisher_greater(int(a), int(b), int(c), int(d)),
        "top_markers", F.col("n_markers") - F.col("top_markers"), "top_others", other - F.col("top_others"),
    )
    out = out.withColumn("fisher_p", fisher)
    out = out.withColumn("wilcoxon_p", whole(lambda w, n, t: pvalues.wilcoxon_greater(w, int(n), t), "w", "n_pairs", "pair_ties"))
    for name in ("pearson", "spearman"):
        out = out.withColumn(f"{name}_p", pvalues.corr_p_column(name, "n_mixtures"))
    for name in ("mann_whitney", "fisher", "wilcoxon"):
        out = bh_fdr(out, f"{name}_p", keys, ["cell_type"]).withColumnRenamed("fdr", f"{name}_fdr")
    return out


def top_markers(table: DataFrame, n: int = 30, keys: list[str] = KEYS) -> DataFrame:
    """The markers of each target with the largest mean weights."""
    w = Window.partitionBy(*keys, "cell_type").orderBy(F.desc(F.round("mean_weight", 9)), "gene")
    return table.where("is_marker").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(
        *keys, "cell_type", "gene", "mean_weight", "place"
    )
