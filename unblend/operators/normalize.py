"""Selection and normalisation of long tables (keys, gene, column, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_positive, number_or_zero, positive_or_fail

KEYS = ["tissue"]


def shared_genes(bulk: DataFrame, signature: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Genes that a tissue has in both tables."""
    pick = [*keys, "gene"]
    return bulk.select(*pick).distinct().join(signature.select(*pick).distinct(), pick, "left_semi")


def shared_cell_types(signature: DataFrame, truth: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The signature's cell types; ``in_truth`` is false for those that the truth lacks."""
    pick = [*keys, "cell_type"]
    known = truth.select(*pick).distinct().withColumn("known", F.lit(True))
    return signature.select(*pick).distinct().join(known, pick, "left").select(
        *pick, F.coalesce("known", F.lit(False)).alias("in_truth")
    )


def select_mixtures(bulk: DataFrame, first: int, keys: list[str] = KEYS, order: str = "mixture") -> DataFrame:
    """The first mixtures of each tissue in column order."""
    names = bulk.select(*keys, "mixture", *([order] if order != "mixture" else [])).distinct()
    w = Window.partitionBy(*keys).orderBy(order)
    return names.withColumn("place", F.dense_rank().over(w)).where(F.col("place") <= first).select(*keys, "mixture", "place")


def pick_mixtures(bulk: DataFrame, wanted: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Asked-for mixtures (keys, mixture) with ``found``, false for those that are missing."""
    have = bulk.select(*keys, "mixture").distinct().withColumn("f", F.lit(True))
    return wanted.join(have, [*keys, "mixture"], "left").select(*keys, "mixture", F.coalesce("f", F.lit(False)).alias("found"))


def normalize_columns(long: DataFrame, column: str, genes: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Values as shares of their column's sum over the shared genes.

    A column is gathered once and added up in gene order, so a share's bits don't depend on how rows arrive.
    """
    if genes is not None:
        long = long.join(genes, [*keys, "gene"], "left_semi")
    packed = long.groupBy(*keys, column).agg(F.array_sort(F.collect_list(F.struct("gene", "value"))).alias("g"))
    total = F.aggregate("g.value", F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))
    packed = packed.withColumn("total", positive_or_fail(total, column))
    return packed.select(*keys, column, "total", F.inline("g")).select(*keys, column, "gene", (F.col("value") / F.col("total")).alias("value"))


def unusable(long: DataFrame, column: str, genes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, column, error): columns that ``normalize_columns`` would stop at, or that have none of the genes."""
    names = long.select(*keys, column).distinct()
    total = long.join(genes, [*keys, "gene"], "left_semi").groupBy(*keys, column).agg(F.sum("value").alias("total"))
    error = F.lit(f"{column}: the column sum isn't finite and positive").alias("error")
    return names.join(total, [*keys, column], "left").where(~F.coalesce(is_positive(F.col("total")), F.lit(False))).select(*keys, column, error)


def types_of(signature: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A tissue's cell types in order, one array a tissue."""
    return signature.groupBy(*keys).agg(F.array_sort(F.collect_set("cell_type")).alias("types"))


def by_type(long: DataFrame, groups: list[str], types: DataFrame, value: str, name: str, keys: list[str] = KEYS) -> DataFrame:
    """A row per group with an array in the order of its tissue's cell types, 0 for what is absent."""
    entries = F.map_from_entries(F.collect_list(F.struct("cell_type", value)))
    packed = long.groupBy(*groups).agg(entries.alias("_m")).join(types, keys)
    at = F.transform("types", lambda t: F.coalesce(F.try_element_at("_m", t), F.lit(0.0)))
    return packed.select(*groups, at.alias(name), "types")


def signature_rows(signature: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A row per gene with its values (``a``) in cell-type order (``types``)."""
    return by_type(signature, [*keys, "gene"], types_of(signature, keys), "value", "a", keys)


def _filled(long: DataFrame, column: str, genes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``long`` on the given genes, with 0 for each of them that a column leaves out.

    Only what is missing is made: a column's own genes are gathered and taken from its tissue's, which are one row a tissue.
    That row is small enough to be broadcast; where it isn't, the skewed side of the join is the one that can be split.
    """
    every = genes.groupBy(*keys).agg(F.collect_set("gene").alias("_every"))
    own = long.groupBy(*keys, column).agg(F.collect_set("gene").alias("_own")).join(every, keys)
    missing = own.select(*keys, column, F.explode(F.array_except("_every", "_own")).alias("gene")).select(*order, F.lit(0.0).alias("value"))
    have = long.join(genes, [*keys, "gene"], "left_semi")
    return have.select(*order, F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")).unionByName(missing)


def dense_bulk(bulk: DataFrame, genes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Every mixture of a tissue with each of its ``genes``, 0 where the bulk leaves one out."""
    return _filled(bulk, "mixture", genes, keys, [*keys, "mixture", "gene"])


def dense_signature(signature: DataFrame, genes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Every cell type of a tissue with each of its ``genes``, 0 where the signature leaves one out."""
    return _filled(signature, "cell_type", genes, keys, [*keys, "gene", "cell_type"])


def prepared(signature: DataFrame, bulk: DataFrame, keys: list[str] = KEYS, zscore: bool = True, genes: DataFrame | None = None) -> DataFrame:
    """Solver rows (keys, mixture, gene, a, b): shared genes, columns summing to 1 and, unless
    ``zscore`` is false, each gene z-scored over the signature's values and the one
    mixture's (population deviation, 0 counts as 1).

    Rows number mixtures x genes. Mixtures that lack a gene of their tissue have 0 there. A column that can't be made
    shares stops the job. ``genes``: those of both tables, if they are known. See ``packed``, whose rows these are.
    """
    from .packed import solver_pack

    rows = solver_pack(signature, bulk, keys, zscore, genes)
    fine = F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).cast("boolean"))
    return rows.where(fine).select(*keys, "mixture", F.inline(F.arrays_zip("gene", "a", "b")))


def joint_zscore_all(signature: DataFrame, bulk: DataFrame, keys: list[str] = KEYS, dense: bool = False) -> tuple[DataFrame, DataFrame]:
    """Signature and bulk, each gene of both z-scored over all columns of both (population deviation,
    0 counts as 1). What either leaves out is 0 and z-scored too; ``dense``: neither leaves anything out."""
    if not dense:
        genes = shared_genes(bulk, signature, keys)
        signature, bulk = dense_signature(signature, genes, keys), dense_bulk(bulk, genes, keys)
    both = signature.select(*keys, "gene", "value").unionByName(bulk.select(*keys, "gene", "value"))
    stats = both.groupBy(*keys, "gene").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))

    def scaled(long: DataFrame) -> DataFrame:
        z = (F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
        return long.join(stats, [*keys, "gene"]).withColumn("value", z).drop("mean", "sd")

    return scaled(signature), scaled(bulk)


def normalize_nonnegative(long: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Values that aren't numbers become 0, negative ones too; then shares of their group,
    equal ones where nothing is left."""
    clean = long.withColumn(value, F.greatest(number_or_zero(F.col(value)), F.lit(0.0)))
    total = clean.groupBy(*groups).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    share = F.when((F.col("total") > 0) & (F.col("total") < float("inf")), F.col(value) / F.col("total")).otherwise(1.0 / F.col("n"))
    return clean.join(total, groups).withColumn(value, share).drop("total", "n")


def log1p_counts(long: DataFrame) -> DataFrame:
    return long.withColumn("value", F.log1p(F.greatest(F.col("value"), F.lit(0.0))))


def normalize_label(label: Column) -> tuple[Column, Column]:
    """(label without blanks and quotes around it, ``Bulk_k`` as ``Mixturek``; its trailing number or null)."""
    bare = F.trim(F.regexp_replace(F.trim(label), '^["\']+|["\']+$', ""))
    name = F.regexp_replace(bare, r"^Bulk_(\d+)$", "Mixture$1")
    digits = F.regexp_extract(name, r"(\d+)$", 1)
    return name, F.when(digits != "", digits.cast("int"))


def discover_cases(signature: DataFrame, bulk: DataFrame, truth: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Tissues that have all three tables."""
    have = signature.select(*keys).distinct()
    return have.join(bulk.select(*keys).distinct(), keys, "left_semi").join(truth.select(*keys).distinct(), keys, "left_semi")


def long_to_matrix(long: DataFrame, rows: list[str], column: str, names: list, value: str) -> DataFrame:
    """A column per name; names are given, so no pass over the data has to find them."""
    return long.groupBy(*rows).pivot(column, names).agg(F.first(value))


def matrix_to_long(matrix: DataFrame, rows: list[str], column: str, value: str) -> DataFrame:
    return matrix.unpivot(rows, [c for c in matrix.columns if c not in rows], column, value).where(F.col(value).isNotNull())
