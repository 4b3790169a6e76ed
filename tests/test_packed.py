"""Packed solver rows: their values, their bits, and columns that can't be made shares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from unblend.operators import normalize, packed, solve, weighted

SIG = "tissue string, gene int, cell_type string, value double"
BULK = "tissue string, mixture string, gene int, value double"
BY = ["tissue", "mixture"]


@pytest.fixture(scope="module")
def some(spark):
    """Two tissues of different sizes, values whose sums depend on their order, gaps in both tables and genes of one only."""
    rng = np.random.default_rng(4)
    sig = [(t, g, c, float(v)) for t, k in (("u", 40), ("v", 25)) for g in range(k) for c, v in zip("abc", rng.lognormal(0, 9, 3)) if (g + ord(c)) % 7]
    bulk = [(t, f"{t}{m}", g, float(rng.lognormal(0, 9))) for t, k in (("u", 44), ("v", 25)) for m in range(9) for g in range(2, k) if (g * 5 + m) % 6]
    return spark.createDataFrame(sig, SIG), spark.createDataFrame(bulk, BULK)


def plain(sig, bulk, zscore):
    """{(tissue, mixture): (genes, a, b)} from the definition."""
    sig, bulk = sig.toPandas(), bulk.toPandas()
    out = {}
    for t, s in sig.groupby("tissue"):
        own = bulk[bulk.tissue == t]
        genes = sorted(set(s.gene) & set(own.gene))
        a = s.pivot(index="gene", columns="cell_type", values="value").reindex(genes).fillna(0.0).to_numpy()
        a = a / a.sum(0)
        for m, x in own.groupby("mixture"):
            b = x.set_index("gene").value.reindex(genes).fillna(0.0).to_numpy()
            b = b / b.sum()
            c = np.column_stack([a, b])
            z = (c - c.mean(1, keepdims=True)) / np.where(c.std(1) > 0, c.std(1), 1.0)[:, None]
            out[t, m] = (genes, z[:, :-1], z[:, -1]) if zscore else (genes, a, b)
    return out


@pytest.mark.parametrize("zscore", [True, False])
@pytest.mark.parametrize("small", [True, False])
def test_packed_rows(monkeypatch, some, zscore, small):
    if not small:
        monkeypatch.setattr(packed, "SMALL", 0)
        monkeypatch.setattr(packed, "PARTS", 3)
    got = {(r.tissue, r.mixture): r for r in packed.solver_pack(*some, zscore=zscore).collect()}
    want = plain(*some, zscore)
    assert set(got) == set(want)
    for k, (genes, a, b) in want.items():
        assert got[k].error is None and got[k].gene == genes
        assert np.allclose(got[k].a, a, atol=1e-12) and np.allclose(got[k].b, b, atol=1e-12)
    grams = {(r.tissue, r.mixture): r for r in packed.solver_grams(*some, zscore=zscore).collect()}
    for k, (_, a, b) in want.items():
        r = grams[k]
        assert np.allclose(r.h, (a.T @ a).ravel()) and np.allclose(r.l, a.T @ b) and r.bb == pytest.approx(b @ b) and r.n_genes == len(b)
    long = normalize.prepared(*some, zscore=zscore)
    assert long.columns == ["tissue", "mixture", "gene", "a", "b"] and long.count() == sum(len(g) for g, _, _ in want.values())


def test_bits_do_not_depend_on_the_order_of_rows(spark, some):
    """Inputs are worked out anew each time, in other partitions and orders."""
    runs = []
    for seed, parts in ((1, 2), (2, 5), (3, 9)):
        sig, bulk = (t.withColumn("_r", F.rand(seed)).repartition(parts, "_r").sortWithinPartitions("_r").drop("_r") for t in some)
        rows = sorted(map(tuple, normalize.prepared(sig, bulk).collect()))
        shares = sorted(map(tuple, normalize.normalize_columns(bulk, "mixture", normalize.shared_genes(bulk, sig)).collect()))
        x = sorted((r.tissue, r.mixture, *r.x) for r in solve.simplex_ls(packed.solver_grams(sig, bulk)).collect())
        learned = sorted((r.tissue, r.mixture, r.loss, *r.proportions) for r in weighted.weighted_deconvolve(packed.solver_pack(sig, bulk), BY, per_task=seed).collect())
        runs.append((rows, shares, x, learned))
    assert runs[0] == runs[1] == runs[2]


def test_errors_are_rows(spark, some):
    sig, bulk = some
    extra = [("u", "none", 3, 0.0), ("u", "odd", 3, float("nan")), ("u", "null", 3, None), ("u", "other", 999, 1.0), ("w", "x", 1, 1.0)]
    more = bulk.unionByName(spark.createDataFrame(extra, BULK))
    broken = sig.withColumn("value", F.when((F.col("tissue") == "v") & (F.col("cell_type") == "b"), 0.0).otherwise(F.col("value")))
    got = {(r.tissue, r.mixture): r for r in packed.solver_grams(broken, more).collect()}
    wrong = {k for k, r in got.items() if r.error is not None}
    assert wrong == {("u", m) for m in ("none", "odd", "null", "other")} | {("v", f"v{m}") for m in range(9)}
    assert {got[k].error for k in wrong} == {packed.UNUSABLE.format("mixture"), packed.UNUSABLE.format("cell_type")}
    assert ("w", "x") not in got
    both = weighted.deconvolve_batch(broken, more, nnls_zscore=False).collect()
    for name in ("weighted", "nnls"):
        own = {(r.tissue, r.mixture): r for r in both if r.method == name}
        assert set(own) == set(got) and {k for k, r in own.items() if r.error is not None} == wrong
        assert all(sum(r.proportions) == pytest.approx(1) for k, r in own.items() if k not in wrong)
    with pytest.raises(Exception, match="finite and positive"):
        normalize.prepared(broken, bulk).count()


def test_loss_parts_add_up(some):
    for r in weighted.weighted_deconvolve(packed.solver_pack(*some), BY).collect():
        assert r.loss == pytest.approx(r.hessian_loss + r.avg_gradient_loss + r.residual_penalty + r.importance_loss + r.reg_loss, abs=1e-9)
        assert r.proportions == pytest.approx([x / sum(r.raw_solution) for x in r.raw_solution]) and r.min_eig <= r.mean_eig <= r.max_eig


def test_one_shuffle_and_no_join_by_tissue_alone(spark, some):
    """The bulk is exchanged once, by mixture; a signature too large to broadcast is joined in parts."""
    sig, bulk = (t.write.mode("overwrite").saveAsTable(n) or spark.table(n) for t, n in zip(some, ("packed_sig", "packed_bulk")))
    try:
        signed = packed.pack_signature(sig, bulk)
        plan = packed.solver_grams(sig, bulk, packed=signed)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(tissue#" in plan and "mixture#" in plan
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    finally:
        spark.sql("DROP TABLE packed_sig")
        spark.sql("DROP TABLE packed_bulk")
