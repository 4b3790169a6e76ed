"""Numbering, ranks, samples and sums that replace windows over whole groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from unblend.functions import learn
from unblend.functions.linkage import linkage_tree
from unblend.functions.numbering import numbered
from unblend.operators import anchor, evaluate, normalize, profiles, solve, summarize, weighted


def test_numbers_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaaabc") if rng.random() < 0.9 else None, k) for k in rng.sample(range(10_000), 3000)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(7)
    got = {(r.g, r.v): r.n for r in numbered(df, ["g"], ["v"], "n", 16).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        want |= {(g, v): k for k, v in enumerate(sorted(v for h, v in rows if h == g))}
    assert got == want
    assert numbered(df.where("false"), ["g"], ["v"], "n").count() == 0


def test_no_task_numbers_a_whole_group(spark):
    df = spark.range(4000).selectExpr("'one' as g", "id as v")
    plan = numbered(df, ["g"], ["v"], "n", 16)
    window = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in window and all("_part" in line for line in window.splitlines() if "row_number()" in line)
    assert sorted(r.n for r in plan.collect()) == list(range(4000))


def ranks(x):
    return [sum(y < v for y in x) + (sum(y == v for y in x) + 1) / 2 for v in x]


def test_spearman_where_a_mixture_lacks_genes(spark):
    rng = random.Random(6)
    true = [("t", g, c, float(rng.randint(0, 4))) for g in range(12) for c in "ab"] + [("t", g, "flat", 1.0) for g in range(12)]
    value = {(g, c): v for _, g, c, v in true}
    rec = [("t", m, g, c, float(rng.randint(0, 5))) for m in range(3) for g in range(12) for c in ("a", "b", "flat") if m == 0 or (g + m) % 3]
    rec.append(("t", 9, 1, "a", 2.0))
    df = spark.createDataFrame(rec, "tissue string, mixture int, gene int, cell_type string, recovered double")
    got = {(r.mixture, r.cell_type): r.spearman for r in evaluate.spearman_by_group(df, spark.createDataFrame(true, "tissue string, gene int, cell_type string, value double")).collect()}
    for (m, c), s in got.items():
        own = [(v, value[g, c]) for _, n, g, k, v in rec if (n, k) == (m, c)]
        if c == "flat" or len(own) < 2:
            assert s is None
        else:
            assert s == pytest.approx(np.corrcoef(ranks([v for v, _ in own]), ranks([t for _, t in own]))[0, 1], abs=1e-12)
    assert len(got) == 10


def test_samples_of_all_repeats(spark):
    rng = np.random.default_rng(0)
    rows = [("t", m, g, [float(x) for x in rng.normal(size=2)], float(rng.normal()), 1.0 + g) for m in range(2) for g in range(9 + m)]
    df = spark.createDataFrame(rows, "tissue string, mixture int, gene int, a array<double>, b double, w double")
    order = lambda r: F.pmod(F.col("gene") * 7 + r * 5 + F.col("mixture"), F.lit(4))
    by = ["tissue", "mixture"]
    picked = {}
    for m in range(2):
        for r in range(3):
            genes = sorted(range(9 + m), key=lambda g: ((g * 7 + r * 5 + m) % 4, g))
            picked[m, r] = set(genes[: round((9 + m) * 0.5)])
    flags = solve.subsample_genes(df, 3, 0.5, order, by).collect()
    assert len(flags) == 19
    assert all(f.in_repeats == [f.gene in picked[f.mixture, r] for r in range(3)] for f in flags)
    full = solve.simplex_ls(solve.gram_stats(df, by, F.col("w"))).select(*by, F.col("x").alias("full_x"))
    got = solve.stability_solve(df, full, 3, 0.5, order, by).collect()
    assert {(r.mixture, r.repeat) for r in got} == set(picked)
    for r in got:
        own = [x for x in rows if x[1] == r.mixture and x[2] in picked[r.mixture, r.repeat]]
        one = solve.simplex_ls(solve.gram_stats(spark.createDataFrame(own, df.schema), by, F.col("w"))).first()
        assert np.allclose(r.x, one.x, atol=1e-9) and r.n_genes == len(own)
        assert (r.w_min, r.w_max) == (min(x[5] for x in own), max(x[5] for x in own))


def test_correlations_add_up_over_tasks(spark):
    rng = random.Random(4)
    names = [f"type{k}" for k in range(13)]
    rows = [(t, g, n, rng.choice([0.0, rng.random(), rng.random() * 9])) for t in "uv" for g in range(30) for n in names if rng.random() < 0.7]
    rows += [("u", g, "none", 0.0) for g in range(3)]
    df = spark.createDataFrame(rows, "tissue string, gene int, cell_type string, value double").repartition(6)
    got = {(r.tissue, r.name_1, r.name_2): r.distance for r in profiles.profile_correlation(df).collect()}
    for t in "uv":
        own = {(g, n): v for s, g, n, v in rows if s == t}
        genes, kinds = sorted({g for g, _ in own}), sorted({n for _, n in own})
        x = np.array([[own.get((g, n), 0.0) for g in genes] for n in kinds])
        for i, a in enumerate(kinds):
            for j in range(i + 1, len(kinds)):
                r = np.corrcoef(x[i], x[j])[0, 1] if x[i].std() > 0 and x[j].std() > 0 else 0.0
                assert got.pop((t, a, kinds[j])) == pytest.approx(min(2.0, max(0.0, 1 - r)), abs=1e-10)
    assert not got


def test_repeated_predictions_stop_the_job(spark):
    truth = spark.createDataFrame([("t", 1, "a", 1.0)], "tissue string, mixture int, cell_type string, truth double")
    twice = spark.createDataFrame([("m", "t", 1, "a", 0.5)] * 2, "method string, tissue string, mixture int, cell_type string, prediction double")
    assert evaluate.prediction_detail(twice.limit(1), truth).count() == 1
    with pytest.raises(Exception, match="prediction isn't one to one"):
        evaluate.prediction_detail(twice, truth).collect()


def test_types_that_the_truth_lacks(spark):
    sig = spark.createDataFrame([(t, g, c, 1.0) for t in "uv" for g in range(2) for c in "ab"], "tissue string, gene int, cell_type string, value double")
    truth = spark.createDataFrame([("u", 1, "a", 0.5), ("u", 1, "b", 0.5), ("v", 1, "a", 1.0), ("v", 2, "x", 1.0)], "tissue string, mixture int, cell_type string, truth double")
    got = {(r.tissue, r.cell_type): r.in_truth for r in normalize.shared_cell_types(sig, truth).collect()}
    assert got == {("u", "a"): True, ("u", "b"): True, ("v", "a"): True, ("v", "b"): False}


def test_winners_where_a_method_lacks_a_type(spark):
    rows = [("t", "a", "m0", 0.3), ("t", "a", "m1", 0.1), ("t", "b", "m0", 0.2), ("t", "b", "m2", 0.2), ("t", "c", "m2", None)]
    df = spark.createDataFrame(rows, "tissue string, cell_type string, method string, mae double")
    got = {r.cell_type: r for r in summarize.winners(df, "mae", ["m0", "m1", "m2"], "m1").collect()}
    assert (got["a"].best_method, got["a"].second_method, got["a"].rank, got["a"].is_best) == ("m1", "m0", 1, True)
    assert got["a"].margin == pytest.approx(0.2)
    assert (got["b"].best_method, got["b"].second_method, got["b"].rank, got["b"].is_best) == ("m0", "m2", None, False)
    assert got["c"].best_error is None and got["c"].rank is None


def test_linkage_with_ties_against_a_search_of_all_pairs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 24):
        for method, over in (("average", np.mean), ("single", np.min), ("complete", np.max)):
            d = np.triu(rng.integers(1, 5, (n, n)), 1).astype(float)
            d = d + d.T
            names = [f"n{k:02}" for k in range(n)]
            clusters, merges = {k: [k] for k in range(n)}, {}
            for new in range(n, 2 * n - 1):
                gap = lambda a, b: float(over([[d[x, y] for y in clusters[b]] for x in clusters[a]]))  # noqa: B023, E731
                at = sorted(clusters)
                h, i, j = min((round(gap(a, b), 9), a, b) for k, a in enumerate(at) for b in at[k + 1 :])
                clusters[new] = clusters.pop(i) + clusters.pop(j)
                merges[new] = (i, j, h)
            rows = {r[0]: r for r in linkage_tree(names, np.round(d, 9), method)}
            assert len(rows) == 2 * n - 1
            name = lambda x: names[x] if x < n else f"merge_{x - n + 1}"  # noqa: B023, E731
            if method != "average":  # there sums of thirds differ in their last bits
                for new, (i, j, h) in merges.items():
                    assert rows[name(new)][5] == pytest.approx(h)
                    assert (rows[name(i)][1], rows[name(i)][3]) == (name(new), 0) and (rows[name(j)][1], rows[name(j)][3]) == (name(new), 1)


def test_anchor_switches_and_settings(spark):
    rng = np.random.default_rng(2)
    sig = spark.createDataFrame([("t", g, c, float(v)) for g in range(24) for c, v in zip("ab", rng.lognormal(0, 1, 2))], "tissue string, gene int, cell_type string, value double")
    bulk = spark.createDataFrame([("t", m, g, float(rng.lognormal(0, 1))) for m in range(4) for g in range(24)], "tissue string, mixture int, gene int, value double")
    for wrong in ({"fit_quantile": 1.5}, {"weight_quantile": -0.1}, {"most": 0.0}):
        with pytest.raises(ValueError):
            anchor.anchor_recover(sig, bulk, **wrong)
    seen = []

    def initial(rows, by):
        seen.append(rows)
        return weighted.weighted_deconvolve(rows, by, learn.Config(rounds=0))

    kept = anchor.anchor_recover(sig, bulk, initial=initial, preprocess_selection=False, preprocess_proportions=False)
    raw = {(r.mixture, r.gene): r.b for r in seen[0].collect()}
    assert raw == {(r.mixture, r.gene): r.value for r in bulk.collect()}
    anchors = {r.gene for r in kept["metrics"].where("is_anchor").collect()}
    assert len(anchors) >= 10
    want = solve.simplex_ls(solve.gram_stats(anchor.anchor_rows(sig, bulk, kept["metrics"]), ["tissue", "mixture"])).collect()
    got = {}
    for r in kept["proportions"].collect():
        got.setdefault(r.mixture, {})[r.cell_type] = r.p
    for r in want:
        assert [got[r.mixture][c] for c in "ab"] == pytest.approx(r.x, abs=1e-9)
    for r in kept["signature"].collect():
        assert (r.recovered == r.value) if r.gene in anchors else r.recovered >= 0


def test_draws_of_few_rows_are_not_broadcast(spark, tmp_path):
    spark.range(30).write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few")).select(F.col("id").alias("mixture"), F.lit("t").alias("tissue"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("cell_type"))
    plan = few.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(99))))
    cells = spark.range(50).selectExpr("'t' as tissue", "id as cell_id", "if(id % 5 = 0, 'b', 'a') as cell_type")
    drawn = profiles.draw_cells(plan, spark.createDataFrame(cells.collect(), cells.schema), F.col("mixture") * 7 + F.col("draw") * 3)
    want = {}
    for m in range(30):
        for t, own in (("a", [c for c in range(50) if c % 5]), ("b", list(range(0, 50, 5)))):
            for d in range(100):
                key = (m, t, own[(m * 7 + d * 3) % len(own)])
                want[key] = want.get(key, 0) + 1
    assert {(r.mixture, r.cell_type, r.cell_id): r.times for r in drawn.collect()} == want
    lines = drawn._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    deep = lambda line: len(line) - len(line.lstrip(" :+-*|"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [x for x in lines[i + 1 :] if x.strip()]
            end = next((k for k, x in enumerate(below) if deep(x) <= deep(line)), len(below))
            assert not any("Generate" in x for x in below[:end])
