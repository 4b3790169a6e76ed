"""Aligning predictions with the truth, and scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import guarded_corr, mid_rank, number_or_zero
from ..functions.numbering import numbered
from ..functions.pvalues import corr_p_column as corr_p
from ..functions.storage import materialize
from .normalize import KEYS, normalize_nonnegative


def orient(cells: DataFrame, types: DataFrame, keys: list[str], columns_first: bool) -> DataFrame:
    """Raw matrix entries (keys, method, r, r_idx, c, c_idx, v) with rows as mixtures and columns as cell types; entries of
    other types go.

    One decision per matrix: turned where more row names than column names are cell types
    (``columns_first``: only where no column name is one). The entries are read once and written with what they may be; a
    matrix's decision is one aggregate over that, which gathers no more names than the tissue has types.
    """
    own = [*keys, "method"]
    known = types.groupBy(*keys).agg(F.collect_set("cell_type").alias("_types"))  # a taxonomy's few dozen names
    own_type = lambda side: F.coalesce(F.array_contains("_types", F.col(side)), F.lit(False))
    seen = cells.join(F.broadcast(known), keys, "left").withColumns({"_r": own_type("r"), "_c": own_type("c")}).where("_r or _c").drop("_types")
    seen = materialize(seen, "matrix-entries")
    hits = lambda side: F.size(F.collect_set(F.when(F.col(f"_{side}"), F.col(side))))
    flags = seen.groupBy(*own).agg(hits("r").alias("r_hits"), hits("c").alias("c_hits"))
    turn = (F.col("c_hits") == 0) & (F.col("r_hits") > 0) if columns_first else F.col("r_hits") > F.col("c_hits")
    turned = seen.join(flags.select(*own, turn.alias("_turned")), own)
    swap = lambda a, b: F.when(F.col("_turned"), F.col(b)).otherwise(F.col(a))
    return turned.where(swap("_c", "_r")).select(
        *own, swap("r", "c").alias("row"), swap("r_idx", "c_idx").alias("row_idx"), swap("c", "r").alias("cell_type"), "v"
    )


def align_predictions(cells: DataFrame, truth: DataFrame, keys: list[str] = KEYS, lenient: bool = False) -> DataFrame:
    """(keys, method, mixture, cell_type, prediction), renormalised per mixture.

    truth: (keys, mixture, mixture_idx from 1, cell_type). Mixtures match by name if any
    name matches, else by the number that a row's name ends with, else by place. The lenient
    rule keeps the common cell types; it matches by name only if all names are there, else
    takes the first rows by place. The strict rule drops matrices that lack a cell type or have
    rows to spare that nothing names. Places come from counts of stretches of rows, so no task sees a whole matrix.
    """
    own = [*keys, "method"]
    wanted = truth.select(*keys, "mixture", "mixture_idx").distinct()
    types = truth.select(*keys, "cell_type").distinct()
    kept = materialize(orient(cells, types, keys, lenient), "oriented")
    n_types = types.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_types"))
    n_want = wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_want"))
    digits = F.regexp_extract("row", r"(\d+)$", 1)
    rows = kept.select(*own, "row", "row_idx").distinct().withColumn("number", F.when(digits != "", digits.cast("long")))
    # of rows that end with one number the last one counts
    last = rows.where("number is not null").groupBy(*own, "number").agg(F.max("row_idx").alias("row_idx"), F.lit(True).alias("last"))
    rows = numbered(rows, own, ["row_idx", "row"], "place").withColumn("place", F.col("place") + 1)
    rows = rows.join(last, [*own, "number", "row_idx"], "left").withColumn("number", F.when(F.col("last"), F.col("number"))).drop("last")
    by_name = rows.join(wanted.select(*keys, F.col("mixture").cast("string").alias("row"), F.col("mixture").alias("m_name")), [*keys, "row"], "left")
    spots = wanted.select(*keys, F.col("mixture_idx").cast("long").alias("spot"), F.col("mixture").alias("m_spot"))
    by_number = by_name.join(spots.withColumnRenamed("spot", "number").withColumnRenamed("m_spot", "m_number"), [*keys, "number"], "left")
    matched = by_number.join(spots.withColumnRenamed("spot", "place").withColumnRenamed("m_spot", "m_place"), [*keys, "place"], "left")
    matched = materialize(matched, "matched-rows")
    found = matched.groupBy(*own).agg(
        F.count("m_name").alias("names"), F.count("m_number").alias("numbers"), F.count(F.lit(1)).alias("n_rows")
    )
    have = kept.select(*own, "cell_type").distinct().groupBy(*own).agg(F.count(F.lit(1)).alias("have"))
    rule = found.join(have, own).join(n_types, keys).join(n_want, keys)
    if lenient:
        rule = rule.where((F.col("names") == F.col("n_want")) | (F.col("n_rows") >= F.col("n_want")))
        pick = F.when(F.col("names") == F.col("n_want"), F.col("m_name")).otherwise(F.col("m_place"))
    else:
        fine = (F.col("names") > 0) | (F.col("numbers") > 0) | (F.col("n_rows") <= F.col("n_want"))
        rule = rule.where((F.col("have") == F.col("n_types")) & fine)
        pick = F.when(F.col("names") > 0, F.col("m_name")).when(F.col("numbers") > 0, F.col("m_number")).otherwise(F.col("m_place"))
    assigned = matched.join(rule.drop("have", "n_types", "n_rows"), own).withColumn("mixture", pick).where("mixture is not null")
    values = kept.select(*own, "row", "row_idx", "cell_type", "v")
    out = values.join(assigned.select(*own, "row", "row_idx", "mixture"), [*own, "row", "row_idx"])
    out = out.select(*own, "mixture", "cell_type", F.col("v").alias("prediction"))
    if lenient:
        return out.withColumn("prediction", number_or_zero(F.col("prediction")))
    return normalize_nonnegative(out, "prediction", [*own, "mixture"])


def method_coverage(predictions: DataFrame, methods: DataFrame, cases: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mixtures that each method has for each case; methods without any are ``missing``."""
    have = predictions.groupBy(*keys, "method").agg(F.countDistinct("mixture").alias("n"))
    names = sorted(r[0] for r in methods.select("method").distinct().collect())  # as many as methods are compared
    grid = cases.select(*keys).distinct().withColumn("method", F.explode(F.array(*map(F.lit, names))))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return grid.join(have, [*keys, "method"], "left").select(
        *keys, "method", n.alias("mixtures"), F.when(n > 0, "ok").otherwise("missing").alias("status")
    )


def common_mixtures(predictions: DataFrame, n_methods: int, keys: list[str] = KEYS) -> DataFrame:
    """Mixtures that every method has."""
    n = predictions.groupBy(*keys, "mixture").agg(F.countDistinct("method").alias("n"))
    return n.where(F.col("n") == n_methods).select(*keys, "mixture")


def prediction_detail(predictions: DataFrame, truth: DataFrame, rare: float = 0.05, keys: list[str] = KEYS) -> DataFrame:
    """Predictions beside the truth, one row each: errors and whether the type is rare (0 < truth < ``rare``).
    A key that occurs twice on either side (a method's predictions, the truth) stops the job."""
    by = [*keys, "mixture", "cell_type"]

    def once(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
        one = rows.groupBy(*groups).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("_n"))
        fail = F.raise_error(F.lit(f"{value} isn't one to one")).cast("double")
        return one.select(*groups, F.when(F.col("_n") == 1, F.col(value)).otherwise(fail).alias(value))

    both = once(predictions, ["method", *by], "prediction").join(once(truth, by, "truth"), by)
    gap = F.col("prediction") - F.col("truth")
    return both.select(
        "method", *by, "truth", "prediction", F.abs(gap).alias("abs_error"), gap.alias("signed_error"),
        ((F.col("truth") > 0) & (F.col("truth") < rare)).alias("is_rare"),
    )


def mixture_metrics(detail: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """L1, accuracy, MAE, RMSE, Pearson and rare MAE of each method's mixtures."""
    e, d = F.col("abs_error"), F.col("signed_error")
    return detail.groupBy("method", *keys, "mixture").agg(
        F.sum(e).alias("l1"),
        (1 - F.sum(e) / 2).alias("accuracy"),
        F.avg(e).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        guarded_corr("truth", "prediction").alias("pearson"),
        F.avg(F.when(F.col("is_rare"), e)).alias("rare_mae"),
    )


def subset_l1(detail: DataFrame, types: list, keys: list[str] = KEYS) -> DataFrame:
    """L1 over chosen cell types."""
    return detail.where(F.col("cell_type").isin(types)).groupBy("method", *keys, "mixture").agg(F.sum("abs_error").alias("l1"))


def method_correlations(detail: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Truth against prediction per cell type and method: means, Pearson and Spearman with their
    two-sided p by the t distribution (null under three rows), MAE, RMSE."""
    by = [*keys, "cell_type", "method"]
    ranked = detail.withColumn("rt", mid_rank("truth", by)).withColumn("rp", mid_rank("prediction", by))
    out = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("truth").alias("mean_truth"),
        F.avg("prediction").alias("mean_prediction"),
        guarded_corr("truth", "prediction").alias("pearson"),
        guarded_corr("rt", "rp").alias("spearman"),
        F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg(F.col("signed_error") * F.col("signed_error"))).alias("rmse"),
    )
    return out.withColumn("pearson_p", corr_p("pearson", "n")).withColumn("spearman_p", corr_p("spearman", "n"))


def mid_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at the mean of theirs."""
    order = np.argsort(x, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], x[order][1:] != x[order][:-1]]))
    size = np.diff(np.append(new, len(x)))
    out = np.empty(len(x))
    out[order] = np.repeat(new + (size + 1) / 2.0, size)
    return out


@F.pandas_udf(T.DoubleType())
def _rank_corr(values: pd.Series, ranks: pd.Series, whole: pd.Series) -> pd.Series:
    """Spearman of values and the other side's ranks; ranks over more than these rows are ranked again."""

    def one(x: np.ndarray, r: np.ndarray, n: int) -> float | None:
        x, r = mid_ranks(np.asarray(x, float)), np.asarray(r, float)
        r = r if len(r) == n else mid_ranks(r)
        dx, dr = x - x.mean(), r - r.mean()
        size = np.sqrt((dx @ dx) * (dr @ dr))
        return float(dx @ dr / size) if size > 0 else None

    return pd.Series([one(*z) for z in zip(values, ranks, whole)], dtype="float64")


def spearman_by_group(recovered: DataFrame, true_profiles: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Spearman over genes of recovered and true profiles per mixture and cell type, ties at mean
    ranks; null for one gene or without spread.

    True profiles are ranked once a tissue and type. A mixture that has all genes takes those ranks, one that lacks some ranks them
    again among its own. A mixture's type is gathered in one row; no window runs over the recovered values.
    """
    by, profile = [*keys, "mixture", "cell_type"], [*keys, "cell_type"]
    true = true_profiles.select(*profile, "gene", mid_rank("value", profile).alias("rt"), F.count(F.lit(1)).over(Window.partitionBy(*profile)).alias("n"))
    both = recovered.join(true, [*keys, "gene", "cell_type"]).groupBy(*by)
    packed = both.agg(F.sort_array(F.collect_list(F.struct("gene", "recovered", "rt"))).alias("g"), F.max("n").alias("n"))
    rank = _rank_corr(F.col("g.recovered"), F.col("g.rt"), F.col("n"))
    return packed.select(*by, rank.alias("spearman")).withColumn("spearman", F.when(~F.isnan("spearman"), F.col("spearman")))


def recovery_summary(spearman: DataFrame, passing: float = 0.8, keys: list[str] = KEYS) -> DataFrame:
    """Per mixture mean and smallest Spearman, and whether the mean and all reach ``passing``."""
    s = F.col("spearman")
    return spearman.groupBy(*keys, "mixture").agg(
        F.avg(s).alias("mean_spearman"),
        F.min(s).alias("min_spearman"),
        (F.avg(s) >= passing).alias("mean_pass"),
        F.coalesce(F.bool_and(s >= passing), F.lit(False)).alias("all_pass"),
    )


def max_abs_difference(one: DataFrame, other: DataFrame, by: list[str], value: str) -> DataFrame:
    """Largest difference of a rerun from saved values, and how many rows met."""
    both = one.select(*by, F.col(value).alias("x")).join(other.select(*by, F.col(value).alias("y")), by)
    return both.agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("max_difference"), F.count(F.lit(1)).alias("n_rows"))
