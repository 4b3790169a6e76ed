"""Every operator as a query over the tables of a folder, in the roles of ``sources.roles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.learn import Config
from ..functions.storage import materialize, new_dir
from ..operators import anchor, evaluate, markers, normalize, packed, profiles, solve, summarize, tree, weighted
from ..sources import files
from ..sources.roles import PRIORITIES, Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
METHODS = ["m0", "m1", "m2", "m3"]
#: True shares in these tables are near a third, so "rare" starts there.
RARE = 0.33


def query(f: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
    """Register a query; counts and places come out as long and doubles rounded."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = f(Roles(spark, folder))
        whole = {c for c, t in df.dtypes if t == "int" and c not in ("gene", "mixture")}
        return rounded(df.select(*[F.col(c).cast("long").alias(c) if c in whole else F.col(c) for c in df.columns]))

    QUERIES[f.__name__] = run
    return f


def predictions(r: Roles) -> DataFrame:
    raw = r.predictions().withColumnRenamed("raw", "prediction")
    return normalize.normalize_nonnegative(raw, "prediction", ["method", "tissue", "mixture"])


def detail(r: Roles) -> DataFrame:
    return evaluate.prediction_detail(predictions(r), r.truth(), RARE)


def metrics(r: Roles) -> DataFrame:
    """Scores with the columns that a run's log adds, made from the mixture's number."""
    m = evaluate.mixture_metrics(detail(r))
    return m.withColumns(
        {
            "dataset": F.concat(F.lit("d"), F.pmod("mixture", F.lit(2)).cast("string")),
            "error": F.when(F.pmod("mixture", F.lit(7)) == 3, "failed"),
            "converged": F.when(F.col("method") != "m3", F.pmod("mixture", F.lit(3)) == 0),
            "iterations": F.pmod("mixture", F.lit(11)),
        }
    )


# ---------------------------------------------------------------- selection, normalisation


@query
def shared_genes(r: Roles) -> DataFrame:
    return normalize.shared_genes(r.bulk(), r.signature())


@query
def shared_cell_types(r: Roles) -> DataFrame:
    return normalize.shared_cell_types(r.signature(), r.truth())


@query
def select_mixtures(r: Roles) -> DataFrame:
    return normalize.select_mixtures(r.bulk(), 10)


@query
def pick_mixtures(r: Roles) -> DataFrame:
    wanted = r.table("supplier").select(F.explode(F.array(F.lit("F"), F.lit("X"))).alias("tissue"), F.col("s_suppkey").alias("mixture"))
    return normalize.pick_mixtures(r.bulk(), wanted)


@query
def normalize_columns(r: Roles) -> DataFrame:
    bulk = r.bulk()
    return normalize.normalize_columns(bulk, "mixture", normalize.shared_genes(bulk, r.signature()))


@query
def joint_zscore(r: Roles) -> DataFrame:
    rows = normalize.prepared(r.signature(), r.bulk())
    return rows.select("tissue", "mixture", "gene", "b", *[F.col("a")[i].alias(f"a{i}") for i in range(3)])


@query
def joint_zscore_all(r: Roles) -> DataFrame:
    s, b = normalize.joint_zscore_all(r.signature(), r.bulk())
    return s.select("tissue", "gene", F.col("cell_type").alias("name"), "value").unionByName(
        b.select("tissue", "gene", F.col("mixture").cast("string").alias("name"), "value")
    )


@query
def normalize_nonnegative(r: Roles) -> DataFrame:
    raw = r.predictions().withColumn("raw", F.when(F.pmod("mixture", F.lit(9)) == 4, F.lit(-1.0)).otherwise(F.col("raw") - 20))
    return normalize.normalize_nonnegative(raw, "raw", ["method", "tissue", "mixture"])


@query
def log1p_counts(r: Roles) -> DataFrame:
    return normalize.log1p_counts(r.counts().withColumn("value", F.col("value") - 10))


@query
def normalize_labels(r: Roles) -> DataFrame:
    label = F.concat(F.lit(' "'), F.when(F.pmod("l_orderkey", F.lit(2)) == 0, "Bulk_").otherwise("Sample"), F.col("l_suppkey").cast("string"), F.lit('" '))
    name, number = normalize.normalize_label(label)
    return r.table("lineitem").select(name.alias("label"), number.alias("number")).groupBy("label", "number").agg(F.count(F.lit(1)).alias("n"))


@query
def discover_cases(r: Roles) -> DataFrame:
    lines = r.table("lineitem").join(r.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    by = lambda flag: lines.where(F.col("l_returnflag") == flag).select(
        F.col("l_suppkey").alias("dataset"), F.col("p_brand").alias("tissue")
    )
    return normalize.discover_cases(by("A"), by("N"), by("R"), ["dataset", "tissue"])


@query
def long_to_matrix(r: Roles) -> DataFrame:
    return normalize.long_to_matrix(r.truth(), ["tissue", "mixture"], "cell_type", ["A", "N", "R"], "truth")


@query
def matrix_to_long(r: Roles) -> DataFrame:
    wide = normalize.long_to_matrix(r.truth(), ["tissue", "mixture"], "cell_type", ["A", "N", "R"], "truth")
    return normalize.matrix_to_long(wide, ["tissue", "mixture"], "cell_type", "truth")


# ---------------------------------------------------------------- profiles


@query
def celltype_profiles(r: Roles) -> DataFrame:
    return profiles.celltype_profiles(r.counts(), r.cells())


@query
def celltype_profiles_pooled(r: Roles) -> DataFrame:
    return profiles.celltype_profiles(r.counts(), r.cells(), by_subject=False, log=False)


def _profiles(r: Roles) -> DataFrame:
    return profiles.celltype_profiles(r.counts(), r.cells(), by_subject=False)


@query
def aggregate_profiles_by_node(r: Roles) -> DataFrame:
    return profiles.aggregate_profiles_by_node(_profiles(r), r.node_leaf())


@query
def gene_dispersion_score(r: Roles) -> DataFrame:
    return profiles.gene_dispersion_score(r.signature())


@query
def split_gene_selection(r: Roles) -> DataFrame:
    # single leaves have no variance of their own, so scores are huge: compare their logarithms
    picked = profiles.split_gene_selection(_profiles(r), r.tree(), r.node_leaf(), 20)
    return picked.withColumn("score", F.log10("score"))


@query
def allocate_counts(r: Roles) -> DataFrame:
    return profiles.allocate_counts(r.truth(), 1000, ["tissue", "mixture"], "cell_type", "truth")


def _draws(r: Roles) -> DataFrame:
    """Ten draws per cell type for as many mixtures as there are suppliers."""
    types = r.cells().select("tissue", "cell_type").distinct().collect()  # a taxonomy's few dozen names
    each = F.array(*[F.struct(*[F.lit(t[c]).alias(c) for c in ("tissue", "cell_type")]) for t in types])
    # a file of suppliers is small and one task's, their draws aren't: the number of tasks is stated
    tasks = int(r.spark.conf.get("spark.sql.shuffle.partitions"))
    plan = r.table("supplier").select(F.col("s_suppkey").alias("mixture")).repartition(tasks, "mixture").select("mixture", F.inline(each))
    plan = plan.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return profiles.draw_cells(plan, r.cells(), F.col("mixture") * 7919 + F.col("draw") * 104729)


@query
def draw_cells(r: Roles) -> DataFrame:
    return _draws(r)


@query
def pseudobulk(r: Roles) -> DataFrame:
    return profiles.pseudobulk(_draws(r), r.counts())


@query
def drawn_shares(r: Roles) -> DataFrame:
    return profiles.drawn_shares(_draws(r))


@query
def perturb_reference(r: Roles) -> DataFrame:
    return profiles.perturb_reference(r.signature(), F.pmod(F.col("gene") * 37 + F.ascii("cell_type"), F.lit(19)) / 10.0 - 0.9, 0.05)


@query
def profile_correlation(r: Roles) -> DataFrame:
    return profiles.profile_correlation(_profiles(r))


@query
def build_hierarchy(r: Roles) -> DataFrame:
    return tree.build_hierarchy(profiles.profile_correlation(_profiles(r)))


@query
def build_hierarchy_ties(r: Roles) -> DataFrame:
    """Over distances in steps of a tenth, many of which are equal, by single linkage."""
    d = profiles.profile_correlation(_profiles(r)).withColumn("distance", F.floor(F.col("distance") * 10) / 10)
    return tree.build_hierarchy(d, groups=2, method="single")


# ---------------------------------------------------------------- solvers


@query
def gram_stats(r: Roles) -> DataFrame:
    g = solve.gram_stats(_three_rows(r), ["tissue", "mixture"])
    return g.select("tissue", "mixture", *[F.col("h")[i].alias(f"h{i}") for i in (0, 1, 2, 4, 5, 8)], *[F.col("l")[i].alias(f"l{i}") for i in range(3)], "bb", "n_genes")


def _two(r: Roles) -> tuple[DataFrame, DataFrame]:
    """Two cell types (the line status) in three tissues (the return flag)."""
    return r.signature("l_returnflag", "l_linestatus"), r.bulk("l_returnflag")


def _two_rows(r: Roles) -> DataFrame:
    return materialize(normalize.prepared(*_two(r)), "prepared")


def _three_rows(r: Roles) -> DataFrame:
    """Solver rows, written once: the solves read them several times."""
    return materialize(normalize.prepared(r.signature(), r.bulk()), "prepared")


@query
def simplex_ls(r: Roles) -> DataFrame:
    s, _ = _two(r)
    by = ["tissue", "mixture"]
    return solve.named(solve.simplex_ls(solve.gram_stats(_two_rows(r), by)), s, by)


@query
def simplex_ls_weighted(r: Roles) -> DataFrame:
    s, _ = _two(r)
    by = ["tissue", "mixture"]
    return solve.named(solve.simplex_ls(solve.gram_stats(_two_rows(r), by, 1.0 + F.col("gene") / 10.0)), s, by)


@query
def simplex_ls_three(r: Roles) -> DataFrame:
    by = ["tissue", "mixture"]
    return solve.named(solve.simplex_ls(solve.gram_stats(_three_rows(r), by)), r.signature(), by)


@query
def nnls_solve(r: Roles) -> DataFrame:
    """Over shares: joint z-scores of these tables have b = -sum of a, whose best fit is 0 everywhere."""
    by = ["tissue", "mixture"]
    rows = materialize(normalize.prepared(*_two(r), zscore=False), "shares")
    solved = solve.nnls_solve(solve.gram_stats(rows, by))
    return solved.select(*by, F.col("raw")[0].alias("raw0"), F.col("raw")[1].alias("raw1"), F.col("x")[0].alias("x0"), "residual")


@query
def weighted_deconvolve(r: Roles) -> DataFrame:
    by = ["tissue", "mixture"]
    return weighted.weighted_deconvolve(packed.solver_pack(r.signature(), r.bulk()), by).drop("genes", "meta_weights", "change_history")


@query
def learn_gene_weights(r: Roles) -> DataFrame:
    by = ["tissue", "mixture"]
    return weighted.long_weights(weighted.weighted_deconvolve(packed.solver_pack(r.signature(), r.bulk()), by), by)


@query
def deconvolve_batch(r: Roles) -> DataFrame:
    return weighted.deconvolve_batch(r.signature(), r.bulk())


#: Weights stay at the baseline, so what the loop around them does is a closed form.
GIVEN = Config(rounds=0)
#: Without curvature and saturation the weights' objective is a parabola.
PARABOLA = Config(lambda_hessian=0.0, lambda_residual=1.0, lambda3=0.0, lambda4=1.0, max_iter=1)


@query
def weighted_deconvolve_given(r: Roles) -> DataFrame:
    """The loop of solves, averages and its stop under given weights, the genes' confidences."""
    by = ["tissue", "mixture"]
    rows = _two_rows(r).withColumn("c", 1.0 + F.col("gene") / 10.0)
    out = weighted.weighted_deconvolve(rows, by, GIVEN)
    x = {f"{n}0": F.col(n)[0] for n in ("proportions", "initial_proportions")}
    return out.withColumns(x).select(*by, *x, "iterations", "converged", F.size("change_history").cast("long").alias("steps"), "total_min", "total_mean", "total_max", "error")


@query
def learn_gene_weights_parabola(r: Roles) -> DataFrame:
    by = ["tissue", "mixture"]
    weights = weighted.long_weights(weighted.weighted_deconvolve(_two_rows(r), by, PARABOLA), by)
    return weights.withColumn("meta_weight", F.round("meta_weight", 4))


@query
def deconvolve_batch_given(r: Roles) -> DataFrame:
    """Non-negative least squares on shares; every seventh mixture has nothing and is a row with its error."""
    return _three_shares(weighted.deconvolve_batch(r.signature(), _some_empty(r.bulk()), GIVEN, nnls_zscore=False))


def _some_empty(bulk: DataFrame) -> DataFrame:
    return bulk.withColumn("value", F.when(F.pmod("mixture", F.lit(7)) == 3, 0.0).otherwise(F.col("value")))


def _three_shares(out: DataFrame) -> DataFrame:
    return out.select("tissue", "mixture", "method", *[F.get("proportions", F.lit(i)).alias(f"p{i}") for i in range(3)], "iterations", "converged", "error")


@query
def deconvolve_batch_tree_given(r: Roles) -> DataFrame:
    """The same down a tree of one cell type and the other two."""
    rows = [("root", None, 0, 0, False), ("A", "root", 1, 0, True), ("rest", "root", 1, 1, False), ("N", "rest", 2, 0, True), ("R", "rest", 2, 1, True)]
    edges = r.spark.createDataFrame(rows, "node string, parent string, depth int, child_pos int, is_leaf boolean")
    leaves = r.spark.createDataFrame([(n, n) for n in "ANR"] + [("rest", "N"), ("rest", "R"), *[("root", n) for n in "ANR"]], "node string, leaf string")
    signature, bulk = normalize.normalize_columns(r.signature(), "cell_type"), normalize.normalize_columns(r.bulk(), "mixture")
    return _three_shares(weighted.deconvolve_batch(signature, _some_empty(bulk), GIVEN, tree=edges, node_leaf=leaves, genes=30, nnls_zscore=False))


@query
def deconvolve_batch_tree(r: Roles) -> DataFrame:
    return weighted.deconvolve_batch(_shares(r), _tissue_bulk(r), tree=r.tree(), node_leaf=r.node_leaf(), genes=30)


def _tissue_bulk(r: Roles) -> DataFrame:
    """Pseudobulk of the single cells, for the hierarchy of their types; written once, as it is read at every step."""
    return r.once("tissue-bulk", lambda: profiles.pseudobulk(_draws(r), r.counts()))


def _shares(r: Roles) -> DataFrame:
    return r.once("shares", lambda: normalize.normalize_columns(_profiles(r), "cell_type"))


@query
def hierarchical_deconvolve(r: Roles) -> DataFrame:
    return tree.hierarchical_deconvolve(_shares(r), _tissue_bulk(r), r.tree(), r.node_leaf(), genes=30)


@query
def hierarchical_deconvolve_given(r: Roles) -> DataFrame:
    """Down a tree with two children a node under given weights, so that each solve is a closed form. Every seventh mixture
    has no finite value for one gene: nodes that are solved on it fail, and all below them."""
    odd = (F.pmod("mixture", F.lit(7)) == 3) & (F.col("gene") == 17)
    bulk = _tissue_bulk(r).withColumn("value", F.when(odd, float("inf")).otherwise(F.col("value")))
    return tree.hierarchical_deconvolve(_shares(r), bulk, *r.pairs_tree(), GIVEN, genes=30)


@query
def parent_local_bulk(r: Roles) -> DataFrame:
    level = r.tree().where("depth = 1").select("node").collect()  # a hierarchy's few dozen names
    each = F.array(*[F.struct(F.lit(n).alias("node"), F.lit(0.4 if n == "high" else 0.6).alias("mass")) for (n,) in level])
    masses = _tissue_bulk(r).select("tissue", "mixture").distinct().select("tissue", "mixture", F.inline(each))
    nodes = profiles.aggregate_profiles_by_node(_shares(r), r.node_leaf())
    return tree.parent_local_bulk(_tissue_bulk(r), masses, nodes)


@query
def propagate_masses(r: Roles) -> DataFrame:
    leaf = r.cells().groupBy("tissue", F.pmod("cell_id", F.lit(50)).alias("mixture"), F.col("cell_type").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("raw"))
    up = r.tree().where("depth = 2").select("node", "parent")
    inner = leaf.join(up, "node").groupBy("tissue", "mixture", F.col("parent").alias("node")).agg(F.sqrt(F.sum("raw")).alias("raw"))
    return tree.propagate_masses(leaf.unionByName(inner), r.tree())


def _p(r: Roles) -> DataFrame:
    return r.truth().withColumnRenamed("truth", "p")


@query
def anchor_gene_metrics(r: Roles) -> DataFrame:
    return anchor.anchor_gene_metrics(r.signature(), r.bulk(), _p(r), r.weights())


def _anchors(r: Roles) -> DataFrame:
    m = r.signature().groupBy("tissue", "gene").agg(F.round(F.stddev_pop("value"), 9).alias("relative_residual"), F.round(F.avg("value"), 9).alias("mean_weight"))
    return m.withColumn("score", F.round(F.col("mean_weight") / (F.col("relative_residual") + 1e-8), 6))


@query
def select_anchors(r: Roles) -> DataFrame:
    return anchor.select_anchors(_anchors(r))


@query
def select_anchors_capped(r: Roles) -> DataFrame:
    return anchor.select_anchors(_anchors(r), 0.9, 0.1, 2, 0.3)


def _flags(r: Roles) -> DataFrame:
    return r.signature("l_returnflag", "l_linestatus").select("tissue", "gene").distinct().withColumn("is_anchor", F.pmod("gene", F.lit(3)) == 0)


@query
def anchor_proportions(r: Roles) -> DataFrame:
    s, b = _two(r)
    return anchor.anchor_proportions(normalize.normalize_columns(s, "cell_type"), normalize.normalize_columns(b, "mixture"), _flags(r))


@query
def anchor_proportions_nonnegative(r: Roles) -> DataFrame:
    s, b = _two(r)
    s, b = normalize.normalize_columns(s, "cell_type"), normalize.normalize_columns(b, "mixture")
    return anchor.anchor_proportions(s, b, _flags(r), nonnegative=True)


@query
def recover_signature(r: Roles) -> DataFrame:
    s, b = _two(r)
    p = r.truth("l_returnflag", "l_linestatus").withColumnRenamed("truth", "p")
    return anchor.recover_signature(s, b, p, _flags(r))


@query
def reconstruction_error(r: Roles) -> DataFrame:
    return anchor.reconstruction_error(r.signature(), r.bulk(), _p(r))


@query
def anchor_recover(r: Roles) -> DataFrame:
    return anchor.anchor_recover(r.signature(), r.bulk())["signature"]


@query
def anchor_recover_given(r: Roles) -> DataFrame:
    """The chain under given weights, with two cell types: each solve is a closed form."""
    return anchor.anchor_recover(*_two(r), GIVEN)["signature"]


@query
def anchor_recover_plain(r: Roles) -> DataFrame:
    """The same on the values as they are, at both places where they could be scored."""
    return anchor.anchor_recover(*_two(r), GIVEN, preprocess_selection=False, preprocess_proportions=False)["signature"]


@query
def anchor_recover_mixed(r: Roles) -> DataFrame:
    """Anchors chosen on scores, proportions solved on the values as they are, and a given first solver: plain least squares, all weights 1."""

    def first(rows: DataFrame, by: list[str]) -> DataFrame:
        genes = rows.groupBy(*by).agg(F.array_sort(F.collect_list("gene")).alias("genes"))
        ones = F.transform("genes", lambda _: F.lit(1.0)).alias("meta_weights")
        solved = solve.simplex_ls(solve.gram_stats(rows, by, k=2)).select(*by, F.col("x").alias("proportions"))
        return solved.join(genes, by).select(*by, "proportions", "genes", ones, F.lit(None).cast("string").alias("error"))

    return anchor.anchor_recover(*_two(r), preprocess_proportions=False, initial=first)["signature"]


@query
def recover_reference_rank1(r: Roles) -> DataFrame:
    return solve.recover_rank1(r.signature(), r.bulk(), _p(r), 0.6)


def _order(repeat: Column) -> Column:
    return F.pmod(F.col("gene") * 7919 + repeat * 104729 + F.col("mixture") * 31, F.lit(1009))


@query
def subsample_genes(r: Roles) -> DataFrame:
    flags = solve.subsample_genes(_two_rows(r), 5, 0.7, _order, ["tissue", "mixture"])
    return flags.select("tissue", "mixture", "gene", F.posexplode("in_repeats").alias("repeat", "has")).where("has").drop("has")


@query
def stability_solve(r: Roles) -> DataFrame:
    by = ["tissue", "mixture"]
    rows = _two_rows(r).withColumn("w", 1.0 + F.col("gene") / 10.0)
    full = solve.simplex_ls(solve.gram_stats(rows, by, F.col("w"))).select(*by, F.col("x").alias("full_x"))
    return solve.stability_solve(rows, full, 5, 0.7, _order, by).withColumn("x0", F.col("x")[0]).drop("x")


# ---------------------------------------------------------------- evaluation


def _matrices(r: Roles) -> DataFrame:
    """Raw prediction matrices: m0 by names, m1 turned, m2 by the numbers of its labels, m3 by place."""
    own = predictions(r).withColumn("place", F.dense_rank().over(_by("tissue", "method").orderBy("mixture")))
    m = F.col("method")
    row = F.when(m.isin("m0", "m1"), F.col("mixture").cast("string")).when(m == "m2", F.concat(F.lit("Bulk_"), F.col("place").cast("string"))).otherwise(
        F.concat(F.lit("row"), F.chr(F.lit(97) + F.pmod("place", F.lit(20))), F.lit("x"))
    )
    row = F.when(m == "m3", F.concat(row, F.translate(F.col("place").cast("string"), "0123456789", "abcdefghij"))).otherwise(row)
    flipped = m == "m1"
    at = F.ascii("cell_type")
    return own.select(
        "tissue", "method",
        F.when(flipped, F.col("cell_type")).otherwise(row).alias("r"), F.when(flipped, at).otherwise(F.col("place")).alias("r_idx"),
        F.when(flipped, row).otherwise(F.col("cell_type")).alias("c"), F.when(flipped, F.col("place")).otherwise(at).alias("c_idx"),
        F.col("prediction").alias("v"),
    )


def _by(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def _wanted(r: Roles) -> DataFrame:
    return r.truth().select("tissue", "mixture", F.dense_rank().over(_by("tissue").orderBy("mixture")).alias("mixture_idx"), "cell_type")


@query
def align_predictions(r: Roles) -> DataFrame:
    return evaluate.align_predictions(_matrices(r), _wanted(r))


@query
def align_predictions_lenient(r: Roles) -> DataFrame:
    return evaluate.align_predictions(_matrices(r), _wanted(r), lenient=True)


@query
def method_coverage(r: Roles) -> DataFrame:
    methods = r.spark.createDataFrame([(m,) for m in [*METHODS, "m9"]], "method string")
    return evaluate.method_coverage(predictions(r), methods, r.truth())


@query
def common_mixtures(r: Roles) -> DataFrame:
    return evaluate.common_mixtures(r.predictions(), 4)


@query
def prediction_detail(r: Roles) -> DataFrame:
    return detail(r)


@query
def mixture_metrics(r: Roles) -> DataFrame:
    return evaluate.mixture_metrics(detail(r))


@query
def subset_l1(r: Roles) -> DataFrame:
    return evaluate.subset_l1(detail(r), ["A", "R"])


@query
def method_correlations(r: Roles) -> DataFrame:
    return evaluate.method_correlations(detail(r))


def _spearman(r: Roles) -> DataFrame:
    recovered = solve.recover_rank1(r.signature(), r.bulk(), _p(r), 0.6).withColumn("recovered", F.round("recovered", 9))
    return evaluate.spearman_by_group(recovered, r.signature().withColumn("value", F.round("value", 9)))


@query
def spearman_by_group(r: Roles) -> DataFrame:
    return _spearman(r)


@query
def recovery_summary(r: Roles) -> DataFrame:
    return evaluate.recovery_summary(_spearman(r), 0.2)


@query
def max_abs_difference(r: Roles) -> DataFrame:
    p = predictions(r)
    one, other = (p.where(F.col("method") == m).drop("method") for m in ("m0", "m1"))
    return evaluate.max_abs_difference(one, other, ["tissue", "mixture", "cell_type"], "prediction")


# ---------------------------------------------------------------- summaries


@query
def summarize_detail(r: Roles) -> DataFrame:
    return summarize.summarize_detail(metrics(r), ["method"], ["tissue"])


@query
def method_summaries(r: Roles) -> DataFrame:
    return summarize.method_summaries(metrics(r))


@query
def compare_methods(r: Roles) -> DataFrame:
    return summarize.compare_methods(metrics(r), "m0", "m1")


@query
def l1_pivot_rank(r: Roles) -> DataFrame:
    return summarize.l1_pivot_rank(metrics(r), METHODS, "m2")


@query
def celltype_summary(r: Roles) -> DataFrame:
    return summarize.celltype_summary(detail(r))


@query
def winners(r: Roles) -> DataFrame:
    return summarize.winners(summarize.celltype_summary(detail(r)), "mae", METHODS, "m1")


@query
def rare_winners(r: Roles) -> DataFrame:
    return summarize.rare_winners(detail(r), METHODS, "m1")


@query
def low_mean_winners(r: Roles) -> DataFrame:
    return summarize.low_mean_winners(detail(r), METHODS, "m1", 0.3335)


@query
def rare_method_summary(r: Roles) -> DataFrame:
    return summarize.rare_method_summary(detail(r))


@query
def cumulative_windows(r: Roles) -> DataFrame:
    return summarize.cumulative_windows(metrics(r), [20, 40, 60, 80, 100], "accuracy", 0.9, ["method", "tissue"], "mixture")


@query
def numeric_summary(r: Roles) -> DataFrame:
    return summarize.numeric_summary(metrics(r), ["method"], ["l1", "accuracy", "rmse", "pearson"])


@query
def numeric_summary_delta(r: Roles) -> DataFrame:
    return summarize.numeric_summary(detail(r), ["method", "tissue", "cell_type"], ["prediction"], "truth")


@query
def signature_block_means(r: Roles) -> DataFrame:
    return summarize.signature_block_means(r.signature(), [("head", 0, 10), ("mid", 10, 40), ("all", 0, 60)])


@query
def weight_block_summary(r: Roles) -> DataFrame:
    return summarize.weight_block_summary(r.weights(), [("head", 0, 10), ("mid", 10, 40), ("all", 0, 60)])


@query
def gene_weight_stats(r: Roles) -> DataFrame:
    return summarize.gene_weight_stats(r.weights())


# ---------------------------------------------------------------- markers


def _dist(r: Roles) -> DataFrame:
    return r.once("value-counts", lambda: markers.value_counts(r.counts(), r.cells()))


@query
def value_counts(r: Roles) -> DataFrame:
    return _dist(r)


@query
def detection_and_fold_change(r: Roles) -> DataFrame:
    return markers.detection_and_fold_change(_dist(r))


@query
def rank_sum_test(r: Roles) -> DataFrame:
    return markers.rank_sum_test(_dist(r)).withColumn("u_sd", F.sqrt("u_variance")).drop("p", "u_variance")


def _tests(r: Roles) -> DataFrame:
    return r.once("tests", lambda: markers.bh_fdr(markers.rank_sum_test(_dist(r)), "p", ["tissue", "cell_type"], ["gene"]))


@query
def rank_sum_p(r: Roles) -> DataFrame:
    return _tests(r).withColumn("u_sd", F.sqrt("u_variance")).drop("u_variance")


@query
def bh_fdr(r: Roles) -> DataFrame:
    return _tests(r).select("tissue", "cell_type", "gene", "p", "fdr")


def _called(r: Roles) -> DataFrame:
    return r.once("called", lambda: _calls(r))


def _calls(r: Roles) -> DataFrame:
    tests = _tests(r).select("tissue", "cell_type", "gene", F.round("fdr", 6).alias("fdr"))
    de = markers.detection_and_fold_change(_dist(r)).join(tests, ["tissue", "cell_type", "gene"])
    known = r.cells().select("tissue", "cell_type", (F.pmod("cell_id", F.lit(10)) * 5 + 1).cast("int").alias("gene"))
    return markers.call_markers(de, known, fdr=0.97, log2fc=0.02, pct=0.05)


@query
def call_markers(r: Roles) -> DataFrame:
    return _called(r).select("tissue", "cell_type", "gene", "is_marker", "in_list")


def _primary(r: Roles) -> DataFrame:
    return markers.primary_marker(_called(r), r.counts())


@query
def primary_marker(r: Roles) -> DataFrame:
    return _primary(r)


@query
def marker_composition(r: Roles) -> DataFrame:
    return markers.marker_composition(_primary(r))


def _weights_by_segment(r: Roles) -> DataFrame:
    """(tissue, mixture, gene, meta_weight) over the single cells' tissues; mixtures are nations."""
    cells = r.cells().select("tissue", "cell_id", F.col("subject").alias("mixture"))
    both = r.lines().join(cells, F.col("l_orderkey") == F.col("cell_id"))
    return both.groupBy("tissue", "mixture", F.col("p_size").alias("gene")).agg(F.round(1 + F.avg("l_discount") * 10, 9).alias("meta_weight"))


def _segment_truth(r: Roles) -> DataFrame:
    by = ["tissue", F.col("subject").alias("mixture")]
    n = r.cells().groupBy(*by, "cell_type").agg(F.count(F.lit(1)).alias("n"))
    total = r.cells().groupBy(*by).agg(F.count(F.lit(1)).alias("t"))
    return n.join(total, ["tissue", "mixture"]).select("tissue", "mixture", "cell_type", (F.col("n") / F.col("t")).alias("truth"))


def _table(r: Roles) -> DataFrame:
    stats = summarize.gene_weight_stats(_weights_by_segment(r)).withColumn("mean_weight", F.round("mean_weight", 9))
    return markers.marker_weight_table(_called(r), stats)


@query
def marker_weight_table(r: Roles) -> DataFrame:
    return _table(r).select("tissue", "cell_type", "gene", "is_marker", "mean_weight", "above_1", "in_top")


def _by_mixture(r: Roles) -> DataFrame:
    return markers.marker_weight_by_mixture(_weights_by_segment(r), _called(r).where("is_marker"), _segment_truth(r))


@query
def marker_weight_by_mixture(r: Roles) -> DataFrame:
    return _by_mixture(r)


@query
def marker_weight_enrichment(r: Roles) -> DataFrame:
    return markers.marker_weight_enrichment(_table(r), _by_mixture(r))


@query
def enrichment_p(r: Roles) -> DataFrame:
    return markers.enrichment_p(markers.marker_weight_enrichment(_table(r), _by_mixture(r)))


@query
def top_markers(r: Roles) -> DataFrame:
    return markers.top_markers(_table(r), 5)


@query
def batch_evaluation(r: Roles) -> DataFrame:
    """Prepare, solve by two methods, score against the truth, sum up."""
    by = ["tissue", "mixture"]
    signature, bulk = r.once("signature", r.signature), r.once("bulk", r.bulk)
    signed = packed.pack_signature(signature, bulk)
    scored = solve.simplex_ls(packed.solver_grams(signature, bulk, packed=signed))
    # non-negative least squares take shares as they are: on joint z-scores of these tables their best fit is 0
    plain = solve.nnls_solve(packed.solver_grams(signature, bulk, zscore=False, packed=signed))
    solved = [solve.named(x, signature, by).withColumn("method", F.lit(n)) for n, x in (("simplex", scored), ("nnls", plain))]
    scored = evaluate.mixture_metrics(evaluate.prediction_detail(solved[0].unionByName(solved[1]), r.truth(), RARE))
    log = scored.withColumns({"error": F.lit(None).cast("string"), "converged": F.lit(True), "iterations": F.lit(1)})
    return summarize.summarize_detail(log, ["method"], ["tissue"])


# ---------------------------------------------------------------- files


@query
def read_matrix_tsv(r: Roles) -> DataFrame:
    """Signatures through their file layout and back."""
    folder = new_dir(r.spark, "matrices")
    files.write_matrix_tsv(r.signature(), folder)
    return files.read_matrix_tsv(r.spark, f"{folder}/*/*.txt").withColumn("gene", F.col("gene").cast("int"))


@query
def read_labels(r: Roles) -> DataFrame:
    """Cells and their types through two files of one column each, paired by place."""
    ids, types = new_dir(r.spark, "cells"), new_dir(r.spark, "types")
    files.write_labels(r.cells(), ids, "cell_id", "cell_id")
    files.write_labels(r.cells(), types, "cell_type", "cell_id")
    cells = files.read_labels(r.spark, f"{ids}/*/*.txt", "cell_id")
    return files.pair_labels(cells, files.read_labels(r.spark, f"{types}/*/*.txt", "cell_type"), "cell_type")


@query
def read_hierarchy_json(r: Roles) -> DataFrame:
    """Hierarchies through their files: edges, and how many cell types each node has."""
    folder = new_dir(r.spark, "hierarchies")
    r.hierarchy().repartition("tissue").write.partitionBy("tissue").text(folder)
    edges, leaves = files.read_hierarchy_json(r.spark, f"{folder}/*/*.txt", PRIORITIES)
    n = leaves.groupBy("tissue", "node").agg(F.count(F.lit(1)).alias("n_leaves"))
    return edges.join(n, ["tissue", "node"])


@query
def write_results(r: Roles) -> DataFrame:
    """Scored predictions written as results are and read back."""
    folder, own = new_dir(r.spark, "results"), detail(r)
    files.write_results({"detail": own}, folder, {"rare": RARE})
    return r.spark.read.schema(own.schema).csv(f"{folder}/detail", header=True)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["batch_evaluation"](spark, folder)


__all__ = ["QUERIES", "PRIORITIES"]
