"""Operators on small invented frames: odd inputs and known answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from unblend.operators import anchor, evaluate, markers, normalize, profiles, solve, summarize, tree, weighted
from unblend.sources import files

SIG = "tissue string, gene int, cell_type string, value double"
BULK = "tissue string, mixture string, gene int, value double"


@pytest.fixture(scope="module")
def known(spark):
    """A signature and exact mixtures of it, with the shares that made them."""
    rng = np.random.default_rng(3)
    s = np.abs(rng.normal(size=(30, 3))) + 0.1
    s /= s.sum(0)
    shares = {f"x{k}": rng.dirichlet(np.ones(3)) for k in range(6)}
    sig = [("t", g, c, float(s[g, j])) for g in range(30) for j, c in enumerate("abc")]
    bulk = [("t", m, g, float(s[g] @ p)) for m, p in shares.items() for g in range(30)]
    return spark.createDataFrame(sig, SIG), spark.createDataFrame(bulk, BULK), shares


def long(df, value):
    out = {}
    for r in df.collect():
        out.setdefault(r["mixture"], {})[r["cell_type"]] = r[value]
    return {m: [v[c] for c in "abc"] for m, v in out.items()}


def test_known_shares_come_back(known):
    sig, bulk, shares = known
    by = ["tissue", "mixture"]
    rows = normalize.prepared(sig, bulk)
    # z-scored rows of an exact mixture tie the columns together, so only shares that sum to 1 are unique there
    plain = solve.gram_stats(normalize.prepared(sig, bulk, zscore=False), by)
    for solved in (solve.simplex_ls(solve.gram_stats(rows, by)), solve.simplex_ls(plain), solve.nnls_solve(plain)):
        got = long(solve.named(solved, sig, by), "prediction")
        for m, p in shares.items():
            assert np.allclose(got[m], p, atol=1e-6)
    learned = weighted.weighted_deconvolve(rows, by).collect()
    for r in learned:
        assert r.error is None and np.allclose(r.proportions, shares[r.mixture], atol=1e-4)
    again = weighted.weighted_deconvolve(rows.repartition(7), by, per_task=2).collect()
    assert {r.mixture: r.proportions for r in again} == {r.mixture: r.proportions for r in learned}


def test_a_failing_mixture_is_a_row(spark, known):
    sig, bulk, _ = known
    rows = normalize.prepared(sig, bulk)
    broken = rows.withColumn("b", F.when(F.col("mixture") == "x1", float("nan")).otherwise(F.col("b")))
    got = {r.mixture: r.error for r in weighted.weighted_deconvolve(broken, ["tissue", "mixture"]).collect()}
    assert got.pop("x1") is not None and set(got.values()) == {None}


def test_mixtures_are_dealt_to_tasks(spark):
    rows = spark.range(2000).selectExpr("'t' AS tissue", "id AS mixture", "array(1, 2) AS gene", "array(array(1.0D)) AS a", "array(1.0D) AS b")
    dealt = weighted.dealt(rows, ["tissue", "mixture"], 32)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 63 and sum(sizes) == 2000 and max(sizes) < 80
    assert weighted.dealt(rows.limit(0), ["tissue", "mixture"]).count() == 0
    # by default a task gets a stack, or less where that leaves cores without one
    assert weighted.dealt(rows, ["tissue", "mixture"]).rdd.getNumPartitions() == 8
    assert weighted.dealt(rows.limit(64), ["tissue", "mixture"]).rdd.getNumPartitions() == 4
    wide = rows.limit(40).withColumn("b", F.array_repeat(F.lit(1.0), 20_000))
    assert weighted.dealt(wide, ["tissue", "mixture"]).rdd.getNumPartitions() == 7


def test_columns_that_cannot_be_normalised_are_error_rows(spark, known):
    sig, bulk, shares = known
    zero = spark.createDataFrame([("t", "zero", g, 0.0) for g in range(30)] + [("t", "elsewhere", 99, 1.0), ("u", "x0", 1, 1.0), ("u", "x0", 2, 2.0)], BULK)
    broken = spark.createDataFrame([("u", g, c, float(c == "a")) for g in (1, 2) for c in "ab"], SIG)
    got = {(r.tissue, r.mixture, r.method): r for r in weighted.deconvolve_batch(sig.unionByName(broken), bulk.unionByName(zero)).collect()}
    assert len(got) == 2 * (len(shares) + 3)
    for (tissue, mixture, _), r in got.items():
        bad = tissue == "u" or mixture in ("zero", "elsewhere")
        assert (r.error is not None) == bad and (r.proportions is None) == bad
    for m, p in shares.items():
        assert np.allclose(got["t", m, "weighted"].proportions, p, atol=1e-4)
    out = anchor.anchor_recover(sig.unionByName(broken), bulk.unionByName(zero), at_least=5)
    assert {(r.tissue, r.mixture) for r in out["failed"].collect()} == {("t", "zero"), ("t", "elsewhere"), ("u", "x0")}
    assert {r.mixture for r in out["proportions"].collect()} == set(shares)


def test_zero_columns_stop_and_constant_genes_do_not(spark):
    sig = spark.createDataFrame([("t", 1, "a", 0.0), ("t", 2, "a", 0.0)], SIG)
    with pytest.raises(Exception, match="column sum"):
        normalize.normalize_columns(sig, "cell_type").collect()
    sig = spark.createDataFrame([("t", g, c, 1.0) for g in (1, 2) for c in "ab"], SIG)
    bulk = spark.createDataFrame([("t", "m", 1, 2.0), ("t", "m", 2, 2.0)], BULK)
    assert all(r.b == 0 and list(r.a) == [0, 0] for r in normalize.prepared(sig, bulk).collect())


def test_nonnegative_shares(spark):
    rows = [("g", "1"), ("g", "x"), ("g", None), ("g", "3"), ("h", "-1"), ("h", "NaN")]
    got = normalize.normalize_nonnegative(spark.createDataFrame(rows, "k string, v string"), "v", ["k"]).collect()
    assert sorted((r.k, r.v) for r in got) == [("g", 0.0), ("g", 0.0), ("g", 0.25), ("g", 0.75), ("h", 0.5), ("h", 0.5)]


def test_hierarchy_masses_add_up(spark, known):
    sig, bulk, shares = known
    edges = [("root", None, 0, 0, False), ("ab", "root", 1, 0, False), ("c", "root", 1, 1, True), ("a", "ab", 2, 0, True), ("b", "ab", 2, 1, True)]
    t = spark.createDataFrame(edges, "node string, parent string, depth int, child_pos int, is_leaf boolean")
    leaf = spark.createDataFrame([(n, x) for n, own in (("root", "abc"), ("ab", "ab"), ("a", "a"), ("b", "b"), ("c", "c")) for x in own], "node string, leaf string")
    got = {}
    for r in tree.hierarchical_deconvolve(sig, bulk, t, leaf).collect():
        got.setdefault(r.mixture, {})[r.node] = r.mass
    assert set(got) == set(shares)
    for m in got.values():
        assert m["ab"] + m["c"] == pytest.approx(1) and m["a"] + m["b"] == pytest.approx(m["ab"])
    batch = {(r.mixture, r.method): r for r in weighted.deconvolve_batch(sig, bulk, tree=t, node_leaf=leaf).collect()}
    assert set(batch) == {(m, n) for m in shares for n in ("hierarchical", "nnls")}
    for m in shares:
        r = batch[m, "hierarchical"]
        assert r.error is None and r.iterations > 0 and r.proportions == pytest.approx([got[m][c] for c in "abc"])
    raw = spark.createDataFrame([("t", "m", "ab", 2.0), ("t", "m", "c", 2.0), ("t", "m", "a", 0.0), ("t", "m", "b", 0.0)], "tissue string, mixture string, node string, raw double")
    assert {r.node: r.mass for r in tree.propagate_masses(raw, t).collect()} == {"root": 1.0, "ab": 0.5, "c": 0.5, "a": 0.25, "b": 0.25}


def test_tissues_with_different_numbers_of_types(spark):
    rng = np.random.default_rng(4)
    by, sig, bulk, truth = ["tissue", "mixture"], [], [], {}
    for tissue, types in (("t", "abcd"), ("u", "ab"), ("v", "xyz")):
        s = np.abs(rng.normal(size=(20, len(types)))) + 0.1
        s /= s.sum(0)
        sig += [(tissue, g, c, float(s[g, j])) for g in range(20) for j, c in enumerate(types)]
        for m in ("m0", "m1", "m2"):
            p = rng.dirichlet(np.ones(len(types)))
            truth |= {(tissue, m, c): float(x) for c, x in zip(types, p)}
            bulk += [(tissue, m, g, float(s[g] @ p)) for g in range(20)]
    sig, bulk = spark.createDataFrame(sig, SIG), spark.createDataFrame(bulk, BULK)
    gram = solve.gram_stats(normalize.prepared(sig, bulk, zscore=False), by)
    assert {r.tissue: (len(r.h), len(r.l)) for r in gram.collect()} == {"t": (16, 4), "u": (4, 2), "v": (9, 3)}
    for solved in (solve.simplex_ls(gram), solve.nnls_solve(gram)):
        got = {(r.tissue, r.mixture, r.cell_type): r.prediction for r in solve.named(solved, sig, by).collect()}
        assert got == pytest.approx(truth, abs=1e-6)
    batch = weighted.deconvolve_batch(sig, bulk).collect()
    assert len(batch) == 18 and all(r.error is None for r in batch)
    p = spark.createDataFrame([(*k, v) for k, v in truth.items()], "tissue string, mixture string, cell_type string, p double")
    flags = sig.select("tissue", "gene").distinct().withColumn("is_anchor", F.col("gene") < 5)
    rows = anchor.recover_signature(sig, bulk, p, flags).collect()
    # exact mixtures leave nothing to shift
    assert len(rows) == 20 * 9 and all(abs(r.shift) < 1e-6 for r in rows)
    got = {(r.tissue, r.mixture, r.cell_type): r.p for r in anchor.anchor_proportions(sig, bulk, flags).collect()}
    assert got == pytest.approx(truth, abs=1e-4)


def test_absent_genes_are_zeros_down_the_tree(spark):
    rng = np.random.default_rng(8)
    s = np.abs(rng.normal(size=(24, 4))) + 0.1
    s[:4] = np.diag([5.0, 5.0, 5.0, 5.0])  # markers, each stored for one type only
    s /= s.sum(0)
    edges = [("root", None, 0, 0, False), *[(c, "root", 1, k, True) for k, c in enumerate("abc")], ("de", "root", 1, 3, False), ("d", "de", 2, 0, True)]
    t = spark.createDataFrame(edges, "node string, parent string, depth int, child_pos int, is_leaf boolean")
    leaf = spark.createDataFrame([*[("root", c) for c in "abcd"], *[(c, c) for c in "abcd"], ("de", "d")], "node string, leaf string")
    shares = {"x0": [0.4, 0.3, 0.2, 0.1], "x1": [0.5, 0.0, 0.25, 0.25], "bad": [0.25] * 4}
    sig = [("t", g, c, float(s[g, j])) for g in range(24) for j, c in enumerate("abcd") if s[g, j]]
    bulk = [("t", m, g, float(s[g] @ p)) for m, p in shares.items() for g in range(24) if s[g] @ p]
    bulk = [(*r[:3], float("nan")) if r[1:3] == ("bad", 9) else r for r in bulk]
    sig, bulk = spark.createDataFrame(sig, SIG), spark.createDataFrame(bulk, BULK)
    chosen = profiles.split_gene_selection(sig, t, leaf, 4).where("parent = 'root'").collect()
    assert {r.gene for r in chosen} == {0, 1, 2, 3}
    got = {}
    for r in tree.hierarchical_deconvolve(sig, bulk, t, leaf).collect():
        got.setdefault(r.mixture, {})[r.node] = r
    assert set(got) == set(shares) and all(set(v) == {"a", "b", "c", "de", "d"} for v in got.values())
    for m in ("x0", "x1"):
        assert [got[m][c].mass for c in "abcd"] == pytest.approx(shares[m], abs=1e-3) and got[m]["d"].error is None
    assert all(r.mass is None and "finite" in r.error for r in got["bad"].values())


def test_correlations_count_absent_genes_as_zeros(spark):
    s = np.array([[3.0, 2.5, 0.0], [1.0, 2.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 4.0], [2.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    sig = [("t", g, c, float(s[g, j])) for g in range(6) for j, c in enumerate("abc") if s[g, j]]
    d = profiles.profile_correlation(spark.createDataFrame(sig, SIG))
    want = 1 - np.corrcoef(s.T)
    got = {(r.name_1, r.name_2): r.distance for r in d.collect()}
    assert got == pytest.approx({("a", "b"): want[0, 1], ("a", "c"): want[0, 2], ("b", "c"): want[1, 2]})
    parents = {r.node: r.parent for r in tree.build_hierarchy(d).collect()}
    assert parents["a"] == parents["b"] != parents["c"]


def test_anchor_queries_count_absent_genes_as_zeros(spark):
    s = np.array([[3.0, 1.0], [0.0, 2.0], [4.0, 0.0], [1.0, 1.0]])
    b = np.array([[2.0, 0.0], [0.0, 3.0], [1.0, 0.0], [1.0, 2.0]])
    share = np.array([[0.6, 0.3], [0.4, 0.7]])
    sig = spark.createDataFrame([("t", g, c, float(s[g, j])) for g in range(4) for j, c in enumerate("ab") if s[g, j]], SIG)
    bulk = spark.createDataFrame([("t", f"m{m}", g, float(b[g, m])) for g in range(4) for m in range(2) if b[g, m]], BULK)
    p = spark.createDataFrame([("t", f"m{m}", c, float(share[j, m])) for m in range(2) for j, c in enumerate("ab")], "tissue string, mixture string, cell_type string, p double")
    weights = spark.createDataFrame([("t", f"m{m}", g, 1.0 + g) for g in range(4) for m in range(2)], "tissue string, mixture string, gene int, meta_weight double")
    gap = b - s @ share
    got = {r.gene: r.residual_rms for r in anchor.anchor_gene_metrics(sig, bulk, p, weights).collect()}
    assert got == pytest.approx({g: np.sqrt((gap[g] ** 2).mean()) for g in range(4)})
    found = {(r.mixture, r.cell_type): r.p for r in anchor.anchor_proportions(sig, bulk, None).collect()}
    for m in range(2):
        d = s[:, 0] - s[:, 1]
        want = np.clip(d @ (b[:, m] - s[:, 1]) / (d @ d), 0, 1)
        assert found[f"m{m}", "a"] == pytest.approx(want, abs=1e-6) and found[f"m{m}", "b"] == pytest.approx(1 - want, abs=1e-6)
    rank1 = {(r.mixture, r.gene, r.cell_type): r.recovered for r in solve.recover_rank1(sig, bulk, p, 0.6).collect()}
    size = (share**2).sum(0) + 0.6
    assert rank1 == pytest.approx({(f"m{m}", g, c): max(0.0, s[g, j] + gap[g, m] * share[j, m] / size[m]) for m in range(2) for g in range(4) for j, c in enumerate("ab")})


def test_hierarchies_match_plain_average_linkage(spark):
    rng, rows, want = np.random.default_rng(11), [], {}
    for tissue, names in (("t", "abcdefg"), ("u", "xyz"), ("v", "pq")):
        d = rng.uniform(0.1, 2.0, (len(names), len(names)))
        d = (d + d.T) / 2
        rows += [(tissue, a, b, float(d[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
        groups, merges = [[k] for k in range(len(names))], set()
        while len(groups) > 1:
            gap = lambda p: float(np.mean([d[i, j] for i in groups[p[0]] for j in groups[p[1]]]))  # noqa: E731, B023
            i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=gap)
            merges.add((frozenset(names[k] for k in groups[i] + groups[j]), round(gap((i, j)), 9)))
            groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
        want[tissue] = merges
    table = spark.createDataFrame(rows, "tissue string, name_1 string, name_2 string, distance double")
    nodes = tree.build_hierarchy(table).collect()
    for tissue, merges in want.items():
        own = [r for r in nodes if r.tissue == tissue]
        up = {r.node: r.parent for r in own}
        leaves = {r.node: set() for r in own if not r.is_leaf}
        for r in own:
            at = r.parent if r.is_leaf else None
            while at is not None:
                leaves[at].add(r.node)
                at = up[at]
        assert {(frozenset(leaves[r.node]), round(r.distance, 9)) for r in own if not r.is_leaf} == merges


def test_nonnegative_solutions_of_every_kind(spark):
    a = np.array([[1.0, 0.2], [0.3, 1.0], [0.5, 0.5]])
    right = {"inside": a @ [2.0, 3.0], "side": a @ [2.0, 0.0] - [0, 0.5, 0], "none": -a.sum(1)}
    rows = spark.createDataFrame([("t", m, g, a[g].tolist(), float(b[g])) for m, b in right.items() for g in range(3)], "tissue string, mixture string, gene int, a array<double>, b double")
    got = {r.mixture: r for r in solve.nnls_solve(solve.gram_stats(rows, ["tissue", "mixture"])).collect()}
    assert got["inside"].raw == pytest.approx([2, 3]) and got["inside"].residual == pytest.approx(0, abs=1e-6)
    assert got["side"].raw[0] > 1 and got["side"].raw[1] == 0 and got["side"].x == [1.0, 0.0]
    assert got["none"].raw == [0.0, 0.0] and got["none"].x == [0.5, 0.5]


def test_anchors_stay_and_the_rest_moves(known):
    sig, bulk, shares = known
    out = anchor.anchor_recover(sig, bulk, at_least=5)
    rows = out["signature"].collect()
    assert all(r.shift == 0 for r in rows if r.is_anchor) and sum(r.is_anchor for r in rows) >= 15
    assert all(r.recovered >= 0 for r in rows)
    got = long(out["proportions"], "p")
    for m in shares:
        assert sum(got[m]) == pytest.approx(1)


def test_alignment_rules(spark):
    truth = spark.createDataFrame([("t", f"Mix{k}", k, c) for k in (1, 2) for c in "ab"], "tissue string, mixture string, mixture_idx int, cell_type string")
    cells, cols = [], "tissue string, method string, r string, r_idx int, c string, c_idx int, v string"
    for k in (1, 2):
        for j, c in enumerate("ab"):
            v = str(k + 10 * j)
            cells += [("t", "named", f"Mix{k}", k, c, j, v), ("t", "turned", c, j, f"Mix{k}", k, v), ("t", "numbered", f"Bulk_{k}", 9 - k, c, j, v), ("t", "placed", "xy"[k - 1], k, c, j, v)]
    cells += [("t", "short", "Mix1", 1, "a", 0, "3"), ("t", "odd", "Mix1", 1, "a", 0, "x"), ("t", "odd", "Mix1", 1, "b", 1, "2")]
    got = {}
    for r in evaluate.align_predictions(spark.createDataFrame(cells, cols), truth).collect():
        got.setdefault(r.method, {})[r.mixture, r.cell_type] = r.prediction
    want = {(f"Mix{k}", c): (k + 10 * j) / (2 * k + 10) for k in (1, 2) for j, c in enumerate("ab")}
    for m in ("named", "turned", "numbered", "placed"):
        assert got[m] == pytest.approx(want), m
    assert "short" not in got and got["odd"] == {("Mix1", "a"): 0.0, ("Mix1", "b"): 1.0}
    lenient = evaluate.align_predictions(spark.createDataFrame(cells, cols), truth, lenient=True)
    assert {r.method for r in lenient.select("method").distinct().collect()} == {"named", "turned", "numbered", "placed"}


def test_duplicate_truth_stops(spark):
    p = spark.createDataFrame([("m", "t", "x", "a", 0.5)], "method string, tissue string, mixture string, cell_type string, prediction double")
    t = spark.createDataFrame([("t", "x", "a", 0.5), ("t", "x", "a", 0.4)], "tissue string, mixture string, cell_type string, truth double")
    with pytest.raises(Exception, match="one to one"):
        evaluate.prediction_detail(p, t).collect()


def test_winners_with_ties_and_gaps(spark):
    s = spark.createDataFrame([("t", "a", "p", 0.2), ("t", "a", "q", 0.2), ("t", "b", "q", 0.0)], "tissue string, cell_type string, method string, mae double")
    got = {r.cell_type: r for r in summarize.winners(s, "mae", ["q", "p"], "p").collect()}
    assert got["a"].best_method == "q" and got["a"].rank == 1 and not got["a"].is_best and got["a"].margin == 0
    assert got["b"].best_method == "q" and got["b"].second_error is None and got["b"].rank is None


def test_rank_sums_match_a_direct_count(spark):
    rng = np.random.default_rng(5)
    types, values = ["a"] * 7 + ["b"] * 9, rng.integers(0, 4, 16)
    cells = spark.createDataFrame([("t", k, c, 0) for k, c in enumerate(types)], "tissue string, cell_id int, cell_type string, subject int")
    counts = spark.createDataFrame([("t", k, 1, float(v)) for k, v in enumerate(values) if v], "tissue string, cell_id int, gene int, value double")
    got = {r.cell_type: r for r in markers.rank_sum_test(markers.value_counts(counts, cells)).collect()}
    u = sum(float(x > y) + 0.5 * float(x == y) for x in values[:7] for y in values[7:])
    assert got["a"].u == pytest.approx(u) and got["b"].u == pytest.approx(63 - u)
    assert 0 <= got["a"].p <= 1
    fold = {r.cell_type: r for r in markers.detection_and_fold_change(markers.value_counts(counts, cells)).collect()}
    assert fold["a"].mean_in == pytest.approx(values[:7].mean()) and fold["a"].pct_out == pytest.approx((values[7:] > 0).mean())


def test_equal_subject_weight_and_counts(spark):
    cells = spark.createDataFrame([("t", 1, "a", 1), ("t", 2, "a", 1), ("t", 3, "a", 2)], "tissue string, cell_id int, cell_type string, subject int")
    counts = spark.createDataFrame([("t", 1, 5, 4.0), ("t", 3, 5, 6.0)], "tissue string, cell_id int, gene int, value double")
    assert profiles.celltype_profiles(counts, cells, log=False).first().value == pytest.approx((2 + 6) / 2)
    assert profiles.celltype_profiles(counts, cells, by_subject=False, log=False).first().value == pytest.approx(10 / 3)
    shares = spark.createDataFrame([("t", "m", c, 1 / 3) for c in "abc"], "tissue string, mixture string, cell_type string, truth double")
    assert sorted(r.n for r in profiles.allocate_counts(shares, 100, ["tissue", "mixture"], "cell_type", "truth").collect()) == [33, 33, 34]


def test_adjusted_p_values_leave_out_missing_ones(spark):
    tests = spark.createDataFrame([("t", k, p) for k, p in enumerate([0.01, 0.04, None, 0.03, 0.5])], "tissue string, gene int, p double")
    got = {r.gene: r.fdr for r in markers.bh_fdr(tests, "p", ["tissue"], ["gene"]).collect()}
    assert got.pop(2) is None and got == pytest.approx({0: 0.04, 1: 0.04 * 4 / 3, 3: 0.04 * 4 / 3, 4: 0.5})


def test_results_and_jobs_leave_no_steps(spark, tmp_path):
    from pathlib import Path

    from unblend.functions import storage

    with storage.job(spark, "own"):
        path = storage.new_dir(spark, "step").removeprefix("file:").replace("//", "/")
        assert storage.materialize(spark.range(5), "step").count() == 5
        own = Path(path).parent
        assert own.is_dir() and list(own.iterdir())
    assert not own.exists()


def test_files(spark, tmp_path):
    sig = spark.createDataFrame([("Fat", "g2", "b", 0.1), ("Fat", "g10", "a", 2.5), ("B/x", "g1", "c", 1.0)], "tissue string, gene string, cell_type string, value double")
    files.write_matrix_tsv(sig, str(tmp_path / "matrices"))
    back = files.read_matrix_tsv(spark, str(tmp_path / "matrices/*/*.txt"))
    assert sorted((r.tissue, r.gene, r.gene_idx, r.cell_type, r.value) for r in back.collect()) == [
        ("B/x", "g1", 0, "c", 1.0), ("Fat", "g10", 0, "a", 2.5), ("Fat", "g10", 0, "b", 0.0), ("Fat", "g2", 1, "a", 0.0), ("Fat", "g2", 1, "b", 0.1)]
    (tmp_path / "Fat").mkdir()
    (tmp_path / "Fat/signature.txt").write_text("a\tb\ng1\t1\t2.5\n\ng2\tx\t4\n")
    got = files.read_matrix_tsv(spark, str(tmp_path / "*/signature.txt")).collect()
    assert sorted((r.tissue, r.gene, r.gene_idx, r.cell_type, r.cell_type_idx, r.value) for r in got if r.value) == [
        ("Fat", "g1", 0, "a", 0, 1.0), ("Fat", "g1", 0, "b", 1, 2.5), ("Fat", "g2", 1, "b", 1, 4.0)]
    (tmp_path / "Fat/labels.txt").write_text("value\nT\nB\n")
    labels = files.read_labels(spark, str(tmp_path / "*/labels.txt"), "cell_type")
    assert sorted((r.pos, r.cell_type) for r in labels.collect()) == [(0, "T"), (1, "B")]
    cells = spark.createDataFrame([("Fat", 0, "c1")], "tissue string, pos int, cell_id string")
    with pytest.raises(Exception, match="not as many"):
        files.pair_labels(cells, labels, "cell_type").collect()
    top = {"name": "root", "children": [{"name": "a", "children": []}, {"name": "bc", "children": [{"name": "b"}, {"name": "c"}], "distance": 0.4}]}
    (tmp_path / "Fat_hierarchy.json").write_text(json.dumps(top))
    edges, leaves = files.read_hierarchy_json(spark, str(tmp_path / "*.json"), ["a", "b", "c"])
    assert edges.count() == 5 and {r.leaf for r in leaves.where("node = 'bc'").collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        files.read_hierarchy_json(spark, str(tmp_path / "*.json"), ["a", "b"])
    files.write_results({"labels": labels}, str(tmp_path / "out"), {"k": 1})
    assert spark.read.csv(str(tmp_path / "out/labels"), header=True).count() == 2
    with pytest.raises(Exception):
        files.write_results({"labels": labels}, str(tmp_path / "out"))


def test_scores_of_a_stream(spark, tmp_path):
    from unblend.streaming.scores import score_stream

    schema = "method string, tissue string, mixture string, cell_type string, prediction double"
    rows = spark.createDataFrame([("m", "t", "x", "a", 0.4), ("m", "t", "x", "b", 0.6)], schema)
    rows.write.parquet(str(tmp_path / "in"))
    truth = spark.createDataFrame([("t", "x", "a", 0.5), ("t", "x", "b", 0.5)], "tissue string, mixture string, cell_type string, truth double")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    score_stream(stream, truth, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().l1 == pytest.approx(0.2)


def test_entry_imports_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "unblend", tmp_path / "unblend", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'winners' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
