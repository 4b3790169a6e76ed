"""One small constrained solve per mixture, all mixtures at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import qp
from .normalize import KEYS, dense_bulk, dense_signature, shared_genes, types_of


def gram_stats(rows: DataFrame, by: list[str], weight: Column | None = None, k: int | None = None) -> DataFrame:
    """Normal equations per group: h (K x K, by rows), l (K), bb and the number of genes.

    ``rows`` has ``a`` (array of K) and ``b``; groups may differ in K, and sums run to the
    largest one. Each product is a sum of its own, so genes
    are aggregated where they lie (map side first) and only K * (K + 3) / 2 numbers a
    group are shuffled. K is looked up once if it isn't given.
    """
    if k is None:
        k = rows.agg(F.max(F.size("a"))).first()[0] or 0
    w = F.lit(1.0) if weight is None else weight
    a = [F.coalesce(F.get("a", i), F.lit(0.0)) for i in range(k)]
    sums = [F.sum(w * a[i] * a[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(w * a[i] * F.col("b")).alias(f"l{i}") for i in range(k)]
    sums += [F.max(F.size("a")).alias("_k"), F.sum(w * F.col("b") * F.col("b")).alias("bb"), F.count(F.lit(1)).alias("n_genes")]
    out = rows.groupBy(*by).agg(*sums)
    own = lambda xs: F.slice(F.array(*xs), F.lit(1), F.col("_k"))
    h = F.flatten(own([own([F.col(f"h{min(i, j)}_{max(i, j)}") for j in range(k)]) for i in range(k)])) if k else F.array().cast("array<double>")
    l = own([F.col(f"l{i}") for i in range(k)]) if k else F.array().cast("array<double>")
    return out.select(*by, h.alias("h"), l.alias("l"), "bb", "n_genes")


def _stacked(solver):
    @F.pandas_udf("array<double>")
    def solve(h: pd.Series, l: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(l), dtype=object)
        sizes = l.map(lambda x: -1 if x is None else len(x))  # rows with an error have no equations
        for k in sizes[sizes >= 0].unique():
            at = np.flatnonzero(sizes == k)
            left = np.stack(h.iloc[at].to_list()).reshape(len(at), k, k)
            got = solver(left, np.stack(l.iloc[at].to_list()))
            for i, x in zip(at, got):
                out.iloc[i] = x
        return out

    return solve


def simplex_ls(gram: DataFrame) -> DataFrame:
    """Adds x: least squares with x >= 0 and sum 1."""
    return gram.withColumn("x", _stacked(qp.simplex_ls)("h", "l"))


def nnls_solve(gram: DataFrame) -> DataFrame:
    """Adds raw (x >= 0), residual (its norm) and x, raw as shares (equal ones if all 0)."""
    solved = gram.withColumn("raw", _stacked(qp.nnls)("h", "l"))
    k = F.size("raw")
    quad = F.aggregate(
        F.sequence(F.lit(0), k * k - 1),
        F.lit(0.0),
        lambda s, i: s + F.get("h", i) * F.get("raw", F.floor(i / k).cast("int")) * F.get("raw", F.pmod(i, k)),
    )
    line = F.aggregate(F.zip_with("l", "raw", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    total = F.aggregate("raw", F.lit(0.0), lambda s, v: s + v)
    return solved.withColumn("residual", F.sqrt(F.greatest(F.lit(0.0), quad - 2 * line + F.col("bb")))).withColumn(
        "x", F.when(total > 0, F.transform("raw", lambda v: v / total)).otherwise(F.transform("raw", lambda v: 1.0 / k))
    )


def named(solved: DataFrame, signature: DataFrame, by: list[str], keys: list[str] = KEYS, array: str = "x", value: str = "prediction") -> DataFrame:
    """Long predictions: the array's places as the tissue's cell types in order."""
    return solved.join(types_of(signature, keys), keys).select(*by, F.posexplode(array).alias("at", value), "types").select(
        *by, F.get("types", F.col("at")).alias("cell_type"), value
    )


def recover_rank1(signature: DataFrame, bulk: DataFrame, proportions: DataFrame, lam: float, keys: list[str] = KEYS) -> DataFrame:
    """Each mixture's own correction of the signature, S + (b - S p) p' / (lam + |p|^2), at least 0.

    Genes are those of both tables; values that either leaves out are 0."""
    genes = shared_genes(bulk, signature, keys)
    bulk = dense_bulk(bulk, genes, keys)
    signature = dense_signature(signature, genes, keys)
    joined = signature.join(proportions, [*keys, "cell_type"])
    fit = joined.groupBy(*keys, "mixture", "gene").agg(F.sum(F.col("value") * F.col("p")).alias("fitted"))
    size = proportions.groupBy(*keys, "mixture").agg(F.sum(F.col("p") * F.col("p")).alias("pp"))
    gap = bulk.select(*keys, "mixture", "gene", F.col("value").alias("b")).join(fit, [*keys, "mixture", "gene"])
    gap = gap.join(size, [*keys, "mixture"]).select(*keys, "mixture", "gene", ((F.col("b") - F.col("fitted")) / (lam + F.col("pp"))).alias("gap"))
    both = gap.join(signature, [*keys, "gene"]).join(proportions, [*keys, "mixture", "cell_type"])
    return both.select(
        *keys, "mixture", "gene", "cell_type", F.greatest(F.lit(0.0), F.col("value") + F.col("gap") * F.col("p")).alias("recovered")
    )


#: For the number of a repeat, what its sample's genes are ordered by; may use the rows' columns.
Order = Callable[[Column], Column]


def _packed_orders(rows: DataFrame, repeats: int, order: Order, by: list[str]) -> DataFrame:
    """A group's rows as one, genes in order, each with what every repeat orders it by."""
    orders = F.array(*[order(F.lit(r)).cast("double") for r in range(repeats)])
    fields = ["gene", *[c for c in ("a", "b", "w") if c in rows.columns]]
    packed = rows.select(*by, *fields, orders.alias("orders")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields, "orders"))).alias("g"))
    return packed.select(*by, *[F.col(f"g.{c}").alias(c) for c in (*fields, "orders")])


def _masks(orders: np.ndarray, fraction: float) -> np.ndarray:
    """For each repeat whether it has the gene (repeats, genes), from (genes, repeats) orders; ties go to the earlier gene."""
    n = len(orders)
    size = max(1, round(n * fraction))  # halves to even
    out = np.zeros((orders.shape[1], n), bool)
    np.put_along_axis(out, np.argsort(orders.T, 1, kind="stable")[:, :size], True, 1)
    return out


def subsample_genes(rows: DataFrame, repeats: int, fraction: float, order: Order, by: list[str]) -> DataFrame:
    """(by, gene, in_repeats): in which of the ``repeats`` samples without replacement of round(fraction * n) genes (at
    least 1) of its group each gene is, as one array of flags a gene. A sample takes the genes that are first in its ``order``."""
    packed = _packed_orders(rows.select(*by, *[c for c in rows.columns if c not in ("a", "b", *by)]), repeats, order, by).select(*by, "gene", "orders")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{k}` {kind[k]}" for k in by] + [f"gene array<{kind['gene']}>", "in_repeats array<array<boolean>>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["in_repeats"] = [list(_masks(np.stack(o), fraction).T) for o in batch["orders"]]
            yield batch.drop(columns="orders")

    return packed.mapInPandas(run, schema).select(*by, F.inline(F.arrays_zip("gene", "in_repeats")))


def stability_solve(rows: DataFrame, full: DataFrame, repeats: int, fraction: float, order: Order, by: list[str]) -> DataFrame:
    """Weighted solves of gene samples (``w``: fixed weights) against the solution over all genes (by, full_x):
    (by, repeat, x, n_genes, distances l1 and l2, and what the sample's weights were).

    A group's rows are packed once, whatever the number of repeats: each repeat is a mask of genes, and one product of a
    stack gives the normal equations of all.
    """
    packed = _packed_orders(rows, repeats, order, by)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{k}` {kind[k]}" for k in by] + ["repeat int, h array<double>, l array<double>, n_genes long, w_min double, w_mean double, w_max double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                a, b, w = np.stack(row["a"]).astype(float), np.asarray(row["b"], float), np.asarray(row["w"], float)
                for r, mask in enumerate(_masks(np.stack(row["orders"]), fraction)):
                    own, x = w[mask], a[mask]
                    left = x.T * own
                    out.append([*[row[k] for k in by], r, (left @ x).ravel(), left @ b[mask], int(mask.sum()), own.min(), own.mean(), own.max()])
            yield pd.DataFrame(out, columns=[*by, "repeat", "h", "l", "n_genes", "w_min", "w_mean", "w_max"])

    solved = simplex_ls(packed.mapInPandas(run, schema)).join(full, by)
    gaps = F.zip_with("x", "full_x", lambda p, q: p - q)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    return solved.select(
        *by,
        "repeat",
        "x",
        "n_genes",
        total(F.transform(gaps, F.abs)).alias("l1"),
        F.sqrt(total(F.transform(gaps, lambda v: v * v))).alias("l2"),
        "w_min",
        "w_mean",
        "w_max",
    )
