"""Solver rows a mixture at a time: its genes packed once, next to its tissue's signature.

A mixture's values are gathered in one row (the one shuffle of the bulk) and put in
the order of its tissue's genes, absent ones as 0. The signature is one row a tissue: small ones are broadcast, larger ones
joined by (tissue, part), with a tissue's mixtures dealt to parts, so none meets one task with all of them. All sums run
over arrays in gene order, so their bits depend neither on partitions nor on the order in which blocks arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize
from .normalize import KEYS, shared_genes

#: Numbers up to which a whole signature is broadcast (32 MB), and parts that a tissue's mixtures are dealt to beyond it.
SMALL, PARTS = 4_000_000, 64
#: What is said of columns that can't be made shares.
UNUSABLE = "{}: the column sum isn't finite and positive"


def shares(x: np.ndarray, what: str) -> np.ndarray:
    """Columns (the last axis but one is genes) over their sums, which have to be finite and positive."""
    total = x.sum(0)
    if not (np.isfinite(total) & (total > 0)).all():
        raise ValueError(UNUSABLE.format(what))
    return x / total


def scored(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each gene z-scored over the signature's values and the mixture's (population deviation, 0 counts as 1)."""
    n = a.shape[1] + 1
    mean = (a.sum(1) + b) / n
    da, db = a - mean[:, None], b - mean
    var = ((da * da).sum(1) + db * db) / n
    sd = np.where(var > 0, np.sqrt(np.where(var > 0, var, 1.0)), 1.0)
    return da / sd[:, None], db / sd


def _number(value: str) -> Column:
    return F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value)


def pack_signature(signature: DataFrame, bulk: DataFrame, keys: list[str] = KEYS, genes: DataFrame | None = None) -> DataFrame:
    """(keys, genes, types, shares by gene and type one after the other, sig_error), a row a tissue, written.

    Genes are those of both tables, in order. What a cell type leaves out is 0; a value that is there
    twice counts twice. A column that can't be made shares leaves an error in place of all.
    """
    genes = shared_genes(bulk, signature, keys) if genes is None else genes
    own = signature.join(genes, [*keys, "gene"], "left_semi")
    each = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("gene", "cell_type", _number("value")))).alias("g"))
    each = each.select(*keys, *[F.col(f"g.{c}").alias(c) for c in ("gene", "cell_type", "value")])
    kind = {f.name: f.dataType.simpleString() for f in signature.schema}
    schema = ", ".join([f"`{k}` {kind[k]}" for k in keys] + [f"genes array<{kind['gene']}>", f"types array<{kind['cell_type']}>", "shares array<double>", "sig_error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                at, names = pd.factorize(np.asarray(row["gene"]), sort=True)
                of, types = pd.factorize(np.asarray(row["cell_type"]), sort=True)
                x = np.zeros((len(names), len(types)))
                np.add.at(x, (at, of), np.asarray(row["value"], float))
                error = None
                try:
                    x = shares(x, "cell_type")
                except ValueError as e:
                    error = str(e)
                out.append([*[row[k] for k in keys], names, types, None if error else x.ravel(), error])
            yield pd.DataFrame(out, columns=[*keys, "genes", "types", "shares", "sig_error"])

    return materialize(each.mapInPandas(run, schema), "packed-signature")


def _joined(bulk: DataFrame, packed: DataFrame, keys: list[str]) -> DataFrame:
    """Mixtures, packed, each with its tissue's signature."""
    by = [*keys, "mixture"]
    mixtures = bulk.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("gene", _number("value")))).alias("g"))
    mixtures = mixtures.select(*by, F.col("g.gene").alias("gene"), F.col("g.value").alias("value"))
    size = packed.agg(F.sum(F.size("genes") * (F.size("types") + 1))).first()[0] or 0
    if size <= SMALL:
        return mixtures.join(F.broadcast(packed), keys)
    part = F.pmod(F.xxhash64("mixture"), F.lit(PARTS))
    copies = packed.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return mixtures.withColumn("_part", part).join(copies, [*keys, "_part"]).drop("_part")


#: For the arrays of one mixture (genes, a, b): what becomes of them, in the order of the schema.
Each = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple]


def solver_pass(
    signature: DataFrame, bulk: DataFrame, each: Each, columns: str, keys: list[str] = KEYS, zscore: bool = True, genes: DataFrame | None = None, packed: DataFrame | None = None
) -> DataFrame:
    """(keys, mixture, ``columns``, error): ``each`` of every mixture's solver rows, in the pass that makes them.

    Rows are the tissue's shared genes in order, columns as shares and, unless ``zscore`` is false, joint z-scores. A
    mixture that can't be made shares, and every mixture of a tissue whose signature can't, is a row with its error.
    Tissues without shared genes have no rows.
    """
    packed = pack_signature(signature, bulk, keys, genes) if packed is None else packed
    rows = _joined(bulk, packed, keys)
    names = [c.split(" ")[0].strip("`") for c in columns.split(", ")]
    kind = {f.name: f.dataType.simpleString() for f in bulk.schema}
    schema = ", ".join([f"`{k}` {kind[k]}" for k in (*keys, "mixture")] + [columns, "error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, at = [], {}
            for row in batch.to_dict("records"):
                key = tuple(row[k] for k in keys)
                try:
                    if row["sig_error"] is not None:
                        raise ValueError(row["sig_error"])
                    if key not in at:
                        order = pd.Index(row["genes"])
                        at = {key: (order, np.asarray(row["shares"], float).reshape(len(order), -1))}
                    order, a = at[key]
                    place = order.get_indexer(pd.Index(row["gene"]))
                    b = np.zeros(len(order))
                    np.add.at(b, place[place >= 0], np.asarray(row["value"], float)[place >= 0])
                    b = shares(b, "mixture")
                    out.append([*key, row["mixture"], *each(order.to_numpy(), *(scored(a, b) if zscore else (a, b))), None])
                except ValueError as e:
                    out.append([*key, row["mixture"], *[None] * len(names), str(e)])
            yield pd.DataFrame(out, columns=[*keys, "mixture", *names, "error"])

    return rows.mapInPandas(run, schema)


def _gene_kind(bulk: DataFrame) -> str:
    return bulk.schema["gene"].dataType.simpleString()


def solver_pack(signature: DataFrame, bulk: DataFrame, keys: list[str] = KEYS, zscore: bool = True, genes: DataFrame | None = None, packed: DataFrame | None = None) -> DataFrame:
    """(keys, mixture, gene, a, b, error): a mixture's solver rows as one row of arrays, a by genes and in them by cell type."""
    columns = f"gene array<{_gene_kind(bulk)}>, a array<array<double>>, b array<double>"
    return solver_pass(signature, bulk, lambda g, a, b: (g, list(a), b), columns, keys, zscore, genes, packed)


def solver_grams(signature: DataFrame, bulk: DataFrame, keys: list[str] = KEYS, zscore: bool = True, genes: DataFrame | None = None, packed: DataFrame | None = None) -> DataFrame:
    """(keys, mixture, h, l, bb, n_genes, error): the normal equations of ``gram_stats``, without rows in between."""

    def gram(_, a: np.ndarray, b: np.ndarray) -> tuple:
        return (a.T @ a).ravel(), a.T @ b, float(b @ b), len(b)

    return solver_pass(signature, bulk, gram, "h array<double>, l array<double>, bb double, n_genes long", keys, zscore, genes, packed)
