"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations


def _normal_tail(z: str) -> str:
    """Upper tail of the normal distribution: half less the density times z + z^3 / 3 + z^5 / (3 * 5) + ..."""
    term = f"exp((2*k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))"
    return f"""CASE WHEN {z} = 0 THEN 0.5 WHEN {z} > 8 THEN 0.0 WHEN {z} < -8 THEN 1.0
  ELSE 0.5 - sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(160), lambda k: {term})) END"""


def _corr_p(r: str, n: str) -> str:
    """Two-sided p of a correlation: for a whole number of degrees of freedom the t distribution is a finite sum."""
    even = f"exp(lgamma(2*j + 1) - j * ln(4) - 2 * lgamma(j + 1) + j * ln(1 - {r} * {r}))"
    odd = f"exp(j * ln(4) + 2 * lgamma(j + 1) - lgamma(2*j + 2) + j * ln(1 - {r} * {r}))"
    return f"""CASE WHEN {r} IS NULL OR {n} < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0.0
  WHEN {n} % 2 = 0 THEN 1 - abs({r}) * list_sum(list_transform(range(({n} - 2) // 2), lambda j: {even}))
  ELSE 1 - 2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * coalesce(list_sum(list_transform(range(({n} - 3) // 2), lambda j: {odd})), 0)) END"""


def _bh(source: str, p: str, by: str, order: str, name: str = "fdr") -> str:
    """The source with p-values adjusted by the step-up rule."""
    return f"""SELECT * EXCLUDE (_r, _k), CASE WHEN {p} IS NOT NULL THEN least(1.0, min({p} * _k / _r) OVER (PARTITION BY {by} ORDER BY _r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS {name}
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {p} NULLS LAST, {order}) AS _r, count({p}) OVER (PARTITION BY {by}) AS _k FROM ({source}))"""


ROLES = """
li AS (SELECT l.*, p.p_size, p.p_brand FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey),
sig AS (SELECT l_linestatus AS tissue, p_size AS gene, l_returnflag AS cell_type, avg(l_quantity) AS value FROM li GROUP BY ALL),
blk AS (SELECT l_linestatus AS tissue, l_suppkey AS mixture, p_size AS gene, sum(l_quantity) AS value FROM li GROUP BY ALL),
gns AS (SELECT DISTINCT tissue, gene FROM blk SEMI JOIN sig USING (tissue, gene)),
dblk AS (SELECT g.tissue, m.mixture, g.gene, coalesce(b.value, 0) AS value FROM gns g JOIN (SELECT DISTINCT tissue, mixture FROM blk) m USING (tissue)
         LEFT JOIN blk b ON b.tissue = g.tissue AND b.mixture = m.mixture AND b.gene = g.gene),
dsig AS (SELECT g.tissue, g.gene, m.cell_type, coalesce(s.value, 0) AS value FROM gns g JOIN (SELECT DISTINCT tissue, cell_type FROM sig) m USING (tissue)
         LEFT JOIN sig s ON s.tissue = g.tissue AND s.cell_type = m.cell_type AND s.gene = g.gene),
tru AS (SELECT tissue, mixture, cell_type, q / sum(q) OVER (PARTITION BY tissue, mixture) AS truth FROM (
  SELECT l_linestatus AS tissue, l_suppkey AS mixture, l_returnflag AS cell_type, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)),
raws AS (SELECT 'm' || (l_linenumber % 4) AS method, l_linestatus AS tissue, l_suppkey AS mixture, l_returnflag AS cell_type,
         sum(l_quantity) AS raw FROM lineitem GROUP BY ALL),
pre AS (SELECT method, tissue, mixture, cell_type, raw / sum(raw) OVER (PARTITION BY method, tissue, mixture) AS prediction FROM raws),
det AS (SELECT method, tissue, mixture, cell_type, truth, prediction, abs(prediction - truth) AS abs_error,
        prediction - truth AS signed_error, truth > 0 AND truth < 0.33 AS is_rare FROM pre JOIN tru USING (tissue, mixture, cell_type)),
met AS (SELECT method, tissue, mixture, sum(abs_error) AS l1, 1 - sum(abs_error) / 2 AS accuracy, avg(abs_error) AS mae,
        sqrt(avg(signed_error * signed_error)) AS rmse,
        CASE WHEN count(*) > 1 AND stddev_pop(truth) > 0 AND stddev_pop(prediction) > 0 THEN corr(truth, prediction) END AS pearson,
        avg(abs_error) FILTER (WHERE is_rare) AS rare_mae FROM det GROUP BY ALL),
runs AS (SELECT *, 'd' || (mixture % 2) AS dataset, CASE WHEN mixture % 7 = 3 THEN 'failed' END AS error,
         CASE WHEN method <> 'm3' THEN mixture % 3 = 0 END AS converged, mixture % 11 AS iterations FROM met),
wts AS (SELECT l_linestatus AS tissue, l_suppkey AS mixture, p_size AS gene, 1 + avg(l_discount) * 100 AS meta_weight FROM li GROUP BY ALL),
cel AS (SELECT c_mktsegment AS tissue, o_orderkey AS cell_id, o_orderpriority AS cell_type, c_nationkey AS subject
        FROM orders JOIN customer ON o_custkey = c_custkey),
cnt AS (SELECT tissue, cell_id, p_size AS gene, sum(l_quantity) AS value FROM li JOIN cel ON l_orderkey = cell_id GROUP BY ALL),
siz AS (SELECT tissue, cell_type, count(*) AS n FROM cel GROUP BY ALL),
prof AS (SELECT tissue, cell_type, gene, sum(ln(1 + value)) / any_value(n) AS value
         FROM cnt JOIN cel USING (tissue, cell_id) JOIN siz USING (tissue, cell_type) GROUP BY tissue, cell_type, gene),
dprof AS (SELECT g.tissue, g.gene, m.cell_type, coalesce(p.value, 0) AS value FROM (SELECT DISTINCT tissue, gene FROM prof) g JOIN (SELECT DISTINCT tissue, cell_type FROM prof) m USING (tissue)
          LEFT JOIN prof p ON p.tissue = g.tissue AND p.cell_type = m.cell_type AND p.gene = g.gene),
shr AS (SELECT tissue, cell_type, gene, value / sum(value) OVER (PARTITION BY tissue, cell_type) AS value FROM prof),
leaf AS (SELECT * FROM (VALUES ('root','1-URGENT'),('root','2-HIGH'),('root','3-MEDIUM'),('root','4-NOT SPECIFIED'),('root','5-LOW'),
  ('high','1-URGENT'),('high','2-HIGH'),('low','3-MEDIUM'),('low','4-NOT SPECIFIED'),('low','5-LOW'),
  ('1-URGENT','1-URGENT'),('2-HIGH','2-HIGH'),('3-MEDIUM','3-MEDIUM'),('4-NOT SPECIFIED','4-NOT SPECIFIED'),('5-LOW','5-LOW')) t(node, leaf)),
edge AS (SELECT * FROM (VALUES ('high','root'),('low','root'),('1-URGENT','high'),('2-HIGH','high'),('3-MEDIUM','low'),
  ('4-NOT SPECIFIED','low'),('5-LOW','low')) t(node, parent)),
draw AS (SELECT s_suppkey AS mixture, tissue, cell_type, (s_suppkey * 7919 + d * 104729) % n AS slot
         FROM supplier, range(10) r(d), siz),
plc AS (SELECT tissue, cell_type, cell_id, row_number() OVER (PARTITION BY tissue, cell_type ORDER BY cell_id) - 1 AS slot FROM cel),
drawn AS (SELECT tissue, mixture, cell_type, cell_id, count(*) AS times FROM draw JOIN plc USING (tissue, cell_type, slot) GROUP BY ALL),
psb AS (SELECT tissue, mixture, gene, v / sum(v) OVER (PARTITION BY tissue, mixture) AS value FROM (
        SELECT tissue, mixture, gene, sum(times * value) AS v FROM drawn JOIN cnt USING (tissue, cell_id) GROUP BY ALL)),
nod AS (SELECT tissue, node, gene, sum(value) / any_value(k) AS value FROM prof JOIN leaf ON leaf = cell_type
        JOIN (SELECT node, count(*) AS k FROM leaf GROUP BY 1) USING (node) GROUP BY tissue, node, gene),
nods AS (SELECT tissue, node, gene, sum(value) / any_value(k) AS value FROM shr JOIN leaf ON leaf = cell_type
        JOIN (SELECT node, count(*) AS k FROM leaf GROUP BY 1) USING (node) GROUP BY tissue, node, gene),
sig2 AS (SELECT l_returnflag AS tissue, p_size AS gene, l_linestatus AS cell_type, avg(l_quantity) AS value FROM li GROUP BY ALL),
blk2 AS (SELECT l_returnflag AS tissue, l_suppkey AS mixture, p_size AS gene, sum(l_quantity) AS value FROM li GROUP BY ALL),
tru2 AS (SELECT tissue, mixture, cell_type, q / sum(q) OVER (PARTITION BY tissue, mixture) AS p FROM (
  SELECT l_returnflag AS tissue, l_suppkey AS mixture, l_linestatus AS cell_type, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)),
dist AS (
  SELECT tissue, gene, value, cell_type, count(*) AS n FROM cnt JOIN cel USING (tissue, cell_id) WHERE value > 0 GROUP BY ALL
  UNION ALL
  SELECT g.tissue, g.gene, 0.0, s.cell_type, s.n - coalesce(k.shown, 0) FROM (SELECT DISTINCT tissue, gene FROM cnt) g
  JOIN siz s USING (tissue) LEFT JOIN (SELECT tissue, gene, cell_type, count(*) AS shown FROM cnt JOIN cel USING (tissue, cell_id)
  WHERE value > 0 GROUP BY ALL) k ON k.tissue = g.tissue AND k.gene = g.gene AND k.cell_type = s.cell_type),
de AS (SELECT *, log2((mean_in + 0.1) / (mean_out + 0.1)) AS log2fc, pct_in - pct_out AS pct_diff FROM (
  SELECT tissue, gene, cell_type, c AS n_in, tc - c AS n_out, s / c AS mean_in, (ts - s) / (tc - c) AS mean_out, d / c AS pct_in,
         (td - d) / (tc - c) AS pct_out FROM (
    SELECT *, sum(s) OVER g AS ts, sum(d) OVER g AS td, sum(c) OVER g AS tc FROM (
      SELECT tissue, gene, cell_type, sum(n * value) AS s, coalesce(sum(n) FILTER (WHERE value > 0), 0) AS d, sum(n) AS c FROM dist GROUP BY ALL)
    WINDOW g AS (PARTITION BY tissue, gene)))),
rks AS (SELECT tissue, gene, value, coalesce(sum(t) OVER (PARTITION BY tissue, gene ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        + (t + 1) / 2 AS rank, t FROM (SELECT tissue, gene, value, sum(n)::DOUBLE AS t FROM dist GROUP BY ALL)),
tie AS (SELECT tissue, gene, sum(t * t * t - t) AS ties, sum(t) AS total FROM rks GROUP BY ALL),
rst AS (SELECT *, CASE WHEN u_variance > 0 THEN (u - n * m / 2 - 0.5) / sqrt(u_variance) ELSE 0.0 END AS z FROM (
  SELECT tissue, gene, cell_type, n, total - n AS m, rs - n * (n + 1) / 2 AS u,
         n * (total - n) / 12.0 * ((total + 1) - ties / (total * (total - 1))) AS u_variance FROM (
    SELECT d.tissue, d.gene, d.cell_type, sum(d.n * r.rank) AS rs, sum(d.n)::DOUBLE AS n FROM dist d
    JOIN rks r ON r.tissue = d.tissue AND r.gene = d.gene AND r.value = d.value GROUP BY ALL) JOIN tie USING (tissue, gene))),
fdr AS (""" + _bh("SELECT *, CASE WHEN u_variance > 0 THEN " + _normal_tail("z") + " ELSE 1.0 END AS p FROM rst", "p", "tissue, cell_type", "gene") + """),
call AS (SELECT de.*, round(f.fdr, 6) < 0.97 AND log2fc > 0.02 AND pct_in >= 0.05 AS is_marker,
         EXISTS (SELECT 1 FROM cel WHERE cel.tissue = de.tissue AND cel.cell_type = de.cell_type AND (cel.cell_id % 10) * 5 + 1 = de.gene) AS in_list
         FROM de JOIN fdr f USING (tissue, cell_type, gene)),
prim AS (SELECT g.tissue, g.gene, cell_type AS primary_type, log2fc, pct_diff FROM (SELECT DISTINCT tissue, gene FROM cnt) g LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY tissue, gene ORDER BY round(log2fc, 9) DESC, round(pct_diff, 9) DESC, cell_type) AS k FROM call WHERE is_marker) c
  ON c.tissue = g.tissue AND c.gene = g.gene AND k = 1),
sw AS (SELECT tissue, subject AS mixture, p_size AS gene, round(1 + avg(l_discount) * 10, 9) AS meta_weight FROM li JOIN cel ON l_orderkey = cell_id GROUP BY ALL),
st AS (SELECT tissue, subject AS mixture, cell_type, count(*) / any_value(t) AS truth FROM cel JOIN (
  SELECT tissue, subject, count(*) AS t FROM cel GROUP BY ALL) USING (tissue, subject) GROUP BY tissue, subject, cell_type),
tab AS (SELECT *, mean_weight > 1 AS above_1, mean_weight >= quantile_cont(mean_weight, 0.9) OVER (PARTITION BY tissue, cell_type) AS in_top FROM (
  SELECT call.*, w.mean_weight FROM call JOIN (SELECT tissue, gene, round(avg(meta_weight), 9) AS mean_weight FROM sw GROUP BY ALL) w USING (tissue, gene))),
mix AS (SELECT tissue, cell_type, mixture, ms / mc AS marker_weight, CASE WHEN c > mc THEN (s - ms) / (c - mc) END AS other_weight, truth FROM (
  SELECT m.tissue, m.cell_type, w.mixture, sum(w.meta_weight) AS ms, count(*) AS mc FROM call m JOIN sw w USING (tissue, gene) WHERE m.is_marker GROUP BY ALL)
  JOIN (SELECT tissue, mixture, sum(meta_weight) AS s, count(*) AS c FROM sw GROUP BY ALL) USING (tissue, mixture)
  LEFT JOIN st USING (tissue, mixture, cell_type))
"""


def _prepared(s: str, b: str, n: str) -> str:
    """Solver rows of two or three cell types: shared genes, shares, joint z-scores."""
    return f"""
{n}g AS (SELECT DISTINCT tissue, gene FROM {b} SEMI JOIN {s} USING (tissue, gene)),
{n}t AS (SELECT DISTINCT tissue, cell_type, dense_rank() OVER (PARTITION BY tissue ORDER BY cell_type) AS k FROM {s}),
{n}n AS (SELECT tissue, gene, cell_type, value / sum(value) OVER (PARTITION BY tissue, cell_type) AS value FROM {s} SEMI JOIN {n}g USING (tissue, gene)),
{n}s AS (SELECT tissue, gene, coalesce(max(value) FILTER (WHERE k = 1), 0) AS a0, coalesce(max(value) FILTER (WHERE k = 2), 0) AS a1,
         coalesce(max(value) FILTER (WHERE k = 3), 0) AS a2, any_value(kk) AS kk FROM {n}n JOIN {n}t USING (tissue, cell_type)
         JOIN (SELECT tissue, max(k) AS kk FROM {n}t GROUP BY 1) USING (tissue) GROUP BY tissue, gene),
{n}b AS (SELECT tissue, mixture, gene, value / sum(value) OVER (PARTITION BY tissue, mixture) AS b FROM {b} SEMI JOIN {n}g USING (tissue, gene)),
{n}f AS (SELECT m.tissue, m.mixture, g.gene, coalesce({n}b.b, 0) AS b FROM (SELECT DISTINCT tissue, mixture FROM {n}b) m JOIN {n}g g USING (tissue)
         LEFT JOIN {n}b ON {n}b.tissue = m.tissue AND {n}b.mixture = m.mixture AND {n}b.gene = g.gene),
{n}m AS (SELECT *, (a0 + a1 + CASE WHEN kk = 3 THEN a2 ELSE 0 END + b) / (kk + 1) AS mean FROM {n}f JOIN {n}s USING (tissue, gene)),
{n}v AS (SELECT *, sqrt((pow(a0 - mean, 2) + pow(a1 - mean, 2) + CASE WHEN kk = 3 THEN pow(a2 - mean, 2) ELSE 0 END + pow(b - mean, 2)) / (kk + 1)) AS sd0 FROM {n}m),
{n} AS (SELECT tissue, mixture, gene, (a0 - mean) / sd AS a0, (a1 - mean) / sd AS a1, (a2 - mean) / sd AS a2, (b - mean) / sd AS b
        FROM (SELECT *, CASE WHEN sd0 > 0 THEN sd0 ELSE 1 END AS sd FROM {n}v))"""


THREE, TWO = _prepared("sig", "blk", "z3"), _prepared("sig2", "blk2", "z2")


def sql(body: str, doubles: str = "", more: str = "", longs: str = "") -> str:
    """The body over the roles, with its doubles rounded as the queries round theirs."""
    casts = [f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
    replace = f" REPLACE ({', '.join(casts)})" if casts else ""
    return f"SELECT *{replace} FROM (WITH {ROLES}{',' + more if more else ''}\n{body})"


def _two_solution(where: str, w: str) -> str:
    """Two cell types: the one free share in closed form, weighted by ``w``."""
    return f"""SELECT tissue, mixture, greatest(0.0, least(1.0, sum({w} * (a0 - a1) * (b - a1)) / sum({w} * (a0 - a1) * (a0 - a1)))) AS x
  FROM z2 {where} GROUP BY tissue, mixture"""


def _long_two(solution: str) -> str:
    return f"""SELECT tissue, mixture, cell_type, CASE WHEN k = 1 THEN x ELSE 1 - x END AS prediction
  FROM ({solution}) JOIN z2t USING (tissue)"""


SAMPLE = """
smp AS (SELECT * FROM (SELECT *, 1 + gene / 10.0 AS w, row_number() OVER (PARTITION BY tissue, mixture, repeat
  ORDER BY (gene * 7919 + repeat * 104729 + mixture * 31) % 1009, gene) AS place, count(*) OVER (PARTITION BY tissue, mixture, repeat) AS k
  FROM z2, range(5) r(repeat)) WHERE place <= greatest(1, round_even(k * 0.7, 0)))"""

WIN = """SELECT *, second_error - best_error AS margin, CASE WHEN second_error > 0 THEN (second_error - best_error) / second_error END AS relative_margin,
  best_method = 'm1' AS is_best FROM (
  SELECT tissue, cell_type, max(method) FILTER (WHERE nth = 1) AS best_method, max(method) FILTER (WHERE nth = 2) AS second_method,
         max(e) FILTER (WHERE nth = 1) AS best_error, max(e) FILTER (WHERE nth = 2) AS second_error,
         max(CASE WHEN method = 'm1' AND e IS NOT NULL THEN rank END) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY tissue, cell_type ORDER BY e NULLS LAST, method) AS nth,
           rank() OVER (PARTITION BY tissue, cell_type ORDER BY e NULLS LAST) AS rank FROM (
      SELECT g.tissue, g.cell_type, m.method, round(s.{e}, 12) AS e FROM (SELECT DISTINCT tissue, cell_type FROM ({src})) g,
      (VALUES ('m0'), ('m1'), ('m2'), ('m3')) m(method)
      LEFT JOIN ({src}) s ON s.tissue = g.tissue AND s.cell_type = g.cell_type AND s.method = m.method)) GROUP BY tissue, cell_type)"""

CTS = """SELECT tissue, cell_type, method, count(*) AS n, avg(truth) AS mean_truth, median(truth) AS median_truth, avg(abs_error) AS mae,
  median(abs_error) AS median_ae, count(*) FILTER (WHERE is_rare) AS n_rare, avg(truth) FILTER (WHERE is_rare) AS rare_mean_truth,
  avg(abs_error) FILTER (WHERE is_rare) AS rare_mae, median(abs_error) FILTER (WHERE is_rare) AS rare_median_ae FROM det GROUP BY ALL"""

MID = "(rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0)"

RANK1 = """
fit AS (SELECT s.tissue, p.mixture, s.gene, sum(s.value * p.truth) AS fitted FROM dsig s JOIN tru p USING (tissue, cell_type) GROUP BY ALL),
r1 AS (SELECT s.tissue, b.mixture, s.gene, s.cell_type, s.value, greatest(0.0, s.value + (b.value - fitted) / (0.6 + pp) * p.truth) AS recovered
  FROM dblk b JOIN fit USING (tissue, mixture, gene) JOIN (SELECT tissue, mixture, sum(truth * truth) AS pp FROM tru GROUP BY ALL) USING (tissue, mixture)
  JOIN dsig s ON s.tissue = b.tissue AND s.gene = b.gene JOIN tru p ON p.tissue = b.tissue AND p.mixture = b.mixture AND p.cell_type = s.cell_type)"""

SPEAR = RANK1 + f""",
sp AS (SELECT tissue, mixture, cell_type, CASE WHEN count(*) > 1 AND stddev_pop(rr) > 0 AND stddev_pop(rt) > 0 THEN corr(rr, rt) END AS spearman FROM (
  SELECT *, {MID.format(g='tissue, mixture, cell_type', v='rec')} AS rr, {MID.format(g='tissue, mixture, cell_type', v='val')} AS rt
  FROM (SELECT *, round(recovered, 9) AS rec, round(value, 9) AS val FROM r1)) GROUP BY ALL)"""

ANC = """anc AS (SELECT *, round(mean_weight / (relative_residual + 1e-8), 6) AS score FROM (
  SELECT tissue, gene, round(stddev_pop(value), 9) AS relative_residual, round(avg(value), 9) AS mean_weight FROM sig GROUP BY ALL))"""


def _anchors(fit: float, weight: float, low: int, most: float) -> str:
    return f"""SELECT tissue, gene, relative_residual, mean_weight, score,
  CASE WHEN passed < least({low}, n) THEN place <= least({low}, n)
       WHEN passed > least(greatest(least({low}, n), ceil({most} * n)), n) THEN passes AND own <= least(greatest(least({low}, n), ceil({most} * n)), n)
       ELSE passes END AS is_anchor FROM (
  SELECT *, sum(passes::INT) OVER (PARTITION BY tissue) AS passed, row_number() OVER (PARTITION BY tissue ORDER BY score DESC, gene) AS place,
         row_number() OVER (PARTITION BY tissue, passes ORDER BY score DESC, gene) AS own FROM (
    SELECT a.*, n, relative_residual <= f AND mean_weight >= w AS passes FROM anc a JOIN (
      SELECT tissue, count(*) AS n, quantile_cont(relative_residual, {fit}) AS f, quantile_cont(mean_weight, {weight}) AS w FROM anc GROUP BY 1) USING (tissue)))"""


def _summary(metrics: str) -> str:
    return f"""SELECT method, tissue, count(*) AS n, avg(l1) AS mean_l1, median(l1) AS median_l1, avg(accuracy) AS mean_accuracy,
  median(accuracy) AS median_accuracy, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse, avg(pearson) AS mean_pearson, avg(rare_mae) AS mean_rare_mae,
  count(error) AS errors, sum(converged::INT) AS converged, avg(iterations) AS mean_iterations FROM {metrics} GROUP BY GROUPING SETS ((method), (method, tissue))"""


SUMS = "mean_l1 median_l1 mean_accuracy median_accuracy mean_mae mean_rmse mean_pearson mean_rare_mae mean_iterations"

#: Three cell types: the seven supports in closed form; the best that is feasible wins.
SUPPORTS = """
g3 AS (SELECT tissue, mixture, sum(a0*a0) AS h00, sum(a0*a1) AS h01, sum(a0*a2) AS h02, sum(a1*a1) AS h11, sum(a1*a2) AS h12, sum(a2*a2) AS h22,
  sum(a0*b) AS l0, sum(a1*b) AS l1, sum(a2*b) AS l2 FROM z3 GROUP BY ALL),
d3 AS (SELECT *, h00 - 2*h02 + h22 AS p, h11 - 2*h12 + h22 AS r, h01 - h02 - h12 + h22 AS q, l0 - l2 - h02 + h22 AS u, l1 - l2 - h12 + h22 AS v FROM g3),
c3 AS (
  SELECT *, (r*u - q*v) / (p*r - q*q) AS x0, (p*v - q*u) / (p*r - q*q) AS x1 FROM d3
  UNION ALL SELECT *, u / p, 0.0 FROM d3 UNION ALL SELECT *, 0.0, v / r FROM d3
  UNION ALL SELECT * EXCLUDE (t), t, 1 - t FROM (SELECT *, ((u - v) + (r - q)) / (p - 2*q + r) AS t FROM d3)
  UNION ALL SELECT *, 1.0, 0.0 FROM d3 UNION ALL SELECT *, 0.0, 1.0 FROM d3 UNION ALL SELECT *, 0.0, 0.0 FROM d3),
x3 AS (SELECT tissue, mixture, unnest(arg_min([x0, x1, 1 - x0 - x1], p*x0*x0 + 2*q*x0*x1 + r*x1*x1 - 2*u*x0 - 2*v*x1)) AS prediction,
  generate_subscripts([1, 2, 3], 1) AS k FROM c3 WHERE x0 >= -1e-12 AND x1 >= -1e-12 AND x0 + x1 <= 1 + 1e-12 GROUP BY tissue, mixture)"""

ENRICHMENT = f"""SELECT * FROM (SELECT *, CASE WHEN (n_markers - top_markers) * top_others > 0 THEN top_markers * (n_genes - n_markers - top_others) / ((n_markers - top_markers) * top_others) END AS odds_ratio FROM (
      SELECT tissue, cell_type, count(*) FILTER (WHERE is_marker) AS n_markers, count(*) AS n_genes, avg(mean_weight) FILTER (WHERE is_marker) AS marker_mean,
      avg(mean_weight) FILTER (WHERE NOT is_marker) AS other_mean, median(mean_weight) FILTER (WHERE is_marker) AS marker_median, count(*) FILTER (WHERE is_marker AND in_top) AS top_markers,
      count(*) FILTER (WHERE NOT is_marker AND in_top) AS top_others, count(*) FILTER (WHERE is_marker AND above_1) AS markers_above_1,
      sum(rk) FILTER (WHERE is_marker) - count(*) FILTER (WHERE is_marker) * (count(*) FILTER (WHERE is_marker) + 1) / 2 AS u,
      avg(mean_weight) FILTER (WHERE is_marker) / avg(mean_weight) FILTER (WHERE NOT is_marker) AS ratio
      FROM (SELECT *, {MID.format(g='tissue, cell_type', v='mean_weight')} AS rk FROM tab) GROUP BY ALL) JOIN (
      SELECT tissue, cell_type, sum(t * t * t - t) AS ties FROM (SELECT tissue, cell_type, mean_weight, count(*)::DOUBLE AS t FROM tab GROUP BY ALL) GROUP BY ALL) USING (tissue, cell_type))
      LEFT JOIN (SELECT tissue, cell_type, sum(CASE WHEN gap > 0 THEN r ELSE 0 END) AS w, count(*) AS n_pairs FROM gp GROUP BY ALL) USING (tissue, cell_type)
      LEFT JOIN (SELECT tissue, cell_type, sum(t * t * t - t) AS pair_ties FROM (SELECT tissue, cell_type, size, count(*)::DOUBLE AS t FROM gp GROUP BY ALL) GROUP BY ALL) USING (tissue, cell_type)
      LEFT JOIN (SELECT tissue, cell_type, CASE WHEN count(*) > 1 AND stddev_pop(truth) > 0 AND stddev_pop(marker_weight) > 0 THEN corr(truth, marker_weight) END AS pearson,
        CASE WHEN count(*) > 1 AND stddev_pop(rt) > 0 AND stddev_pop(rw) > 0 THEN corr(rt, rw) END AS spearman, count(*) AS n_mixtures, avg(gap) AS mean_gap FROM (
        SELECT *, marker_weight - other_weight AS gap, {MID.format(g='tissue, cell_type', v='truth')} AS rt, {MID.format(g='tissue, cell_type', v='marker_weight')} AS rw
        FROM mix WHERE truth IS NOT NULL AND other_weight IS NOT NULL) GROUP BY ALL) USING (tissue, cell_type)"""
ENRICHED = "marker_mean other_mean marker_median u ratio ties odds_ratio w pair_ties pearson spearman mean_gap"
GAPS = f"gp AS (SELECT *, {MID.format(g='tissue, cell_type', v='size')} AS r FROM (SELECT *, marker_weight - other_weight AS gap, round(abs(marker_weight - other_weight), 12) AS size FROM mix) WHERE gap <> 0)"

#: How many of the signs of 1 to n give each rank sum, for n up to 50.
WAYS = """ways AS (WITH RECURSIVE w(n, c) AS (SELECT 0, [1.0::DOUBLE] || list_transform(range(1275), lambda i: 0.0::DOUBLE) UNION ALL
  SELECT n + 1, list_transform(range(1, 1277), lambda i: c[i] + CASE WHEN i > n + 1 THEN c[i - n - 1] ELSE 0 END) FROM w WHERE n < 50) SELECT * FROM w)"""


def _choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"


def _enrichment_p() -> str:
    top = "(top_markers + top_others)"
    table = f"exp({_choose('n_markers', 'k')} + {_choose('(n_genes - n_markers)', f'({top} - k)')} - {_choose('n_genes', top)})"
    tests = f"""SELECT e.* EXCLUDE (mz, wz), CASE WHEN u IS NULL THEN NULL WHEN mz IS NULL THEN 1.0 ELSE {_normal_tail('mz')} END AS mann_whitney_p,
      least(1.0, list_sum(list_transform(range(top_markers, least(n_markers, {top}) + 1), lambda k: {table}))) AS fisher_p,
      CASE WHEN n_pairs <= 50 AND pair_ties = 0 THEN list_sum(c[ceil(w - 1e-9)::INT + 1:]) / pow(2, n_pairs) ELSE {_normal_tail('wz')} END AS wilcoxon_p,
      {_corr_p('pearson', 'n_mixtures')} AS pearson_p, {_corr_p('spearman', 'n_mixtures')} AS spearman_p FROM (
      SELECT *, CASE WHEN v > 0 THEN (u - n_markers * m / 2.0 - 0.5) / sqrt(v) END AS mz, (w - n_pairs * (n_pairs + 1) / 4.0) / sqrt(n_pairs * (n_pairs + 1) * (2 * n_pairs + 1) / 24.0 - pair_ties / 48.0) AS wz FROM (
        SELECT *, n_markers * m / 12.0 * ((n_genes + 1) - ties / (n_genes * (n_genes - 1.0))) AS v FROM (SELECT *, n_genes - n_markers AS m FROM ({ENRICHMENT})))) e LEFT JOIN ways ON ways.n = n_pairs"""
    for name in ("mann_whitney", "fisher", "wilcoxon"):
        tests = _bh(tests, f"{name}_p", "tissue", "cell_type", f"{name}_fdr")
    return f"SELECT * EXCLUDE (m, v) FROM ({tests})"


ENRICHMENT_P = _enrichment_p()


def _nnls_three(source: str, name: str) -> str:
    """Shares of the non-negative solution for three types: the eight supports, of which the best that is feasible wins."""
    det = "(h00 * (h11*h22 - h12*h12) - h01 * (h01*h22 - h12*h02) + h02 * (h01*h12 - h11*h02))"
    full = [
        f"(l0 * (h11*h22 - h12*h12) - h01 * (l1*h22 - h12*l2) + h02 * (l1*h12 - h11*l2)) / {det}",
        f"(h00 * (l1*h22 - h12*l2) - l0 * (h01*h22 - h12*h02) + h02 * (h01*l2 - l1*h02)) / {det}",
        f"(h00 * (h11*l2 - l1*h12) - h01 * (h01*l2 - l1*h02) + l0 * (h01*h12 - h11*h02)) / {det}",
    ]
    pair = lambda i, j: [f"(l{i}*h{j}{j} - l{j}*h{i}{j}) / (h{i}{i}*h{j}{j} - h{i}{j}*h{i}{j})", f"(l{j}*h{i}{i} - l{i}*h{i}{j}) / (h{i}{i}*h{j}{j} - h{i}{j}*h{i}{j})"]
    rows = [full, ["0.0"] * 3]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        x = ["0.0"] * 3
        x[i], x[j] = pair(i, j)
        rows.append(x)
    for i in range(3):
        x = ["0.0"] * 3
        x[i] = f"l{i} / h{i}{i}"
        rows.append(x)
    every = " UNION ALL ".join(f"SELECT *, {x} AS x0, {y} AS x1, {z} AS x2 FROM {name}g" for x, y, z in rows)
    return f"""
{name}g AS (SELECT tissue, mixture, sum(a0*a0) AS h00, sum(a0*a1) AS h01, sum(a0*a2) AS h02, sum(a1*a1) AS h11, sum(a1*a2) AS h12, sum(a2*a2) AS h22,
  sum(a0*b) AS l0, sum(a1*b) AS l1, sum(a2*b) AS l2 FROM {source} GROUP BY ALL),
{name} AS (SELECT tissue, mixture, CASE WHEN list_sum(x) > 0 THEN list_transform(x, lambda v: v / list_sum(x)) ELSE [1.0/3, 1.0/3, 1.0/3] END AS x FROM (
  SELECT tissue, mixture, arg_min([x0, x1, x2], h00*x0*x0 + h11*x1*x1 + h22*x2*x2 + 2*h01*x0*x1 + 2*h02*x0*x2 + 2*h12*x1*x2 - 2*l0*x0 - 2*l1*x1 - 2*l2*x2) AS x
  FROM ({every}) WHERE x0 >= 0 AND x1 >= 0 AND x2 >= 0 GROUP BY tissue, mixture))"""


SHARES_TWO = """nn AS (SELECT tissue, gene, cell_type, value / sum(value) OVER (PARTITION BY tissue, cell_type) AS v FROM sig2),
db2 AS (SELECT m.tissue, m.mixture, g.gene, coalesce(b.value / m.total, 0) AS b FROM (SELECT tissue, mixture, sum(value) AS total FROM blk2 GROUP BY ALL) m
        JOIN (SELECT DISTINCT tissue, gene FROM blk2 SEMI JOIN sig2 USING (tissue, gene)) g USING (tissue) LEFT JOIN blk2 b ON b.tissue = m.tissue AND b.mixture = m.mixture AND b.gene = g.gene)"""


def _edges(rows: str) -> str:
    """A tree with two children a node: edges (node, parent, depth, which child by name) and leaves below each node."""
    return f"""
he AS (SELECT * FROM (VALUES {rows}) t(node, parent, depth, k)),
hl AS (WITH RECURSIVE w(node, leaf) AS (SELECT node, node FROM he WHERE node NOT IN (SELECT parent FROM he) UNION ALL
  SELECT he.parent, w.leaf FROM w JOIN he USING (node)) SELECT * FROM w)"""


def _down(depth: int) -> str:
    """Solutions of all nodes' children at a depth (s), their masses (m), what the next depth has to explain (v) and its values (l)."""
    gap = "(a.value - z.value)"
    text = "'ValueError: signature and bulk must be finite and not empty'"
    above = "(SELECT DISTINCT tissue, mixture, 'root' AS node, 1.0 AS mass, NULL::VARCHAR AS error FROM hb)" if depth == 1 else f"m{depth - 1}"
    seen = "UNION ALL ".join(f"SELECT tissue, mixture, node, mass FROM m{d} WHERE mass IS NOT NULL AND (depth = {depth} OR node NOT IN (SELECT parent FROM he)) " for d in range(1, depth + 1))
    return f"""
s{depth} AS (SELECT tissue, mixture, l.node AS parent, bool_or(isinf(l.value)) AS bad, greatest(0.0, least(1.0, sum({gap} * (l.value - z.value)) FILTER (WHERE NOT isinf(l.value)) / sum({gap} * {gap}))) AS x
  FROM l{depth} l JOIN hk USING (tissue, node, gene) JOIN he e ON e.parent = l.node AND e.k = 1 JOIN he f ON f.parent = l.node AND f.k = 2
  JOIN hp a ON a.tissue = l.tissue AND a.gene = l.gene AND a.node = e.node JOIN hp z ON z.tissue = l.tissue AND z.gene = l.gene AND z.node = f.node GROUP BY ALL),
m{depth} AS (SELECT *, above * raw AS mass FROM (SELECT u.tissue, u.mixture, e.node, e.parent, e.depth, u.mass AS above,
    CASE WHEN u.error IS NULL AND NOT bad THEN CASE WHEN k = 1 THEN x ELSE 1 - x END END AS raw, coalesce(u.error, CASE WHEN bad THEN {text} END) AS error
  FROM {above} u JOIN he e ON e.parent = u.node LEFT JOIN s{depth} s ON s.tissue = u.tissue AND s.mixture = u.mixture AND s.parent = u.node)),
k{depth} AS (SELECT DISTINCT tissue, mixture, parent AS node, above AS mass FROM m{depth} WHERE mass IS NULL AND above IS NOT NULL{f' UNION ALL SELECT * FROM k{depth - 1}' if depth > 1 else ''}),
v{depth} AS ({seen}UNION ALL SELECT * FROM k{depth}),
t{depth} AS (SELECT tissue, mixture, gene, sum(mass * value) AS fit FROM v{depth} JOIN hp USING (tissue, node) GROUP BY ALL),
l{depth + 1} AS (SELECT v.tissue, v.mixture, v.node, b.gene, greatest(1e-12, greatest(v.mass, 1e-12) * (p.value + (b.value - fit))) AS value
  FROM v{depth} v JOIN m{depth} m ON m.tissue = v.tissue AND m.mixture = v.mixture AND m.node = v.node AND m.error IS NULL JOIN hp p ON p.tissue = v.tissue AND p.node = v.node
  JOIN hb b ON b.tissue = v.tissue AND b.mixture = v.mixture AND b.gene = p.gene JOIN t{depth} t ON t.tissue = v.tissue AND t.mixture = v.mixture AND t.gene = p.gene
  WHERE v.node IN (SELECT parent FROM he))"""


def _hierarchy(edges: str, depth: int, bulk: str, signature: str, value: str) -> str:
    """All levels of a tree over the bulk (whose ``value`` that is) and the signature."""
    return _edges(edges) + f""",
hg AS (SELECT DISTINCT tissue, gene FROM {bulk} SEMI JOIN {signature} USING (tissue, gene)),
hb AS (SELECT m.tissue, m.mixture, g.gene, {value} AS value
  FROM (SELECT DISTINCT tissue, mixture FROM {bulk}) m JOIN hg g USING (tissue) LEFT JOIN {bulk} b ON b.tissue = m.tissue AND b.mixture = m.mixture AND b.gene = g.gene),
hd AS (SELECT g.tissue, g.gene, n.leaf, coalesce(s.value, 0) AS value FROM hg g, (SELECT DISTINCT leaf FROM hl) n LEFT JOIN {signature} s ON s.tissue = g.tissue AND s.gene = g.gene AND s.cell_type = n.leaf),
hp AS (SELECT tissue, node, gene, avg(value) AS value FROM hd JOIN hl USING (leaf) GROUP BY ALL),
hk AS (SELECT tissue, parent AS node, gene FROM (SELECT *, row_number() OVER (PARTITION BY tissue, parent ORDER BY score DESC, gene) AS place FROM (
  SELECT tissue, parent, gene, var_pop(m) / (avg(v) + 1e-12) AS score FROM (
    SELECT tissue, parent, node, gene, avg(value) AS m, var_pop(value) AS v FROM hd JOIN hl USING (leaf) JOIN he USING (node) GROUP BY ALL) GROUP BY ALL)) WHERE place <= 30),
l1 AS (SELECT tissue, mixture, 'root' AS node, gene, value FROM hb),""" + ",".join(map(_down, range(1, depth + 1)))


#: The tree of ``Roles.pairs_tree``; every seventh mixture has no finite value for gene 17.
HIERARCHY = _hierarchy(
    "('high','root',1,1),('low','root',1,2),('1-URGENT','high',2,1),('2-HIGH','high',2,2),('3-MEDIUM','low',2,1),('rest','low',2,2),('4-NOT SPECIFIED','rest',3,1),('5-LOW','rest',3,2)",
    3, "psb", "shr", "CASE WHEN m.mixture % 7 = 3 AND g.gene = 17 AND b.value IS NOT NULL THEN 'inf'::DOUBLE ELSE coalesce(b.value, 0) END",
)
#: One cell type and the other two under a node of their own.
ONE_AND_TWO = """
hs AS (SELECT tissue, gene, cell_type, value / sum(value) OVER (PARTITION BY tissue, cell_type) AS value FROM sig),
hm AS (SELECT tissue, mixture, gene, value / sum(value) OVER (PARTITION BY tissue, mixture) AS value FROM blk),""" + _hierarchy(
    "('A','root',1,1),('rest','root',1,2),('N','rest',2,1),('R','rest',2,2)", 2, "hm", "hs", "coalesce(b.value, 0)"
)
UNUSABLE = "'mixture: the column sum isn''t finite and positive'"
FAILED = f"SELECT tissue, mixture, method, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::INT, NULL::BOOLEAN, {UNUSABLE} FROM (SELECT DISTINCT tissue, mixture FROM blk WHERE mixture % 7 = 3)"


DISTANCES = """SELECT a.tissue, a.cell_type AS name_1, b.cell_type AS name_2, greatest(0.0, least(2.0, 1 - CASE WHEN stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0
  THEN corr(a.value, b.value) ELSE 0 END)) AS distance FROM dprof a JOIN dprof b ON a.tissue = b.tissue AND a.gene = b.gene AND a.cell_type < b.cell_type GROUP BY ALL"""


def _linkage(distances: str, over: str, groups: str) -> str:
    """Trees by linkage: a row a merge with all clusters left (numbers, members); the distance of two clusters is
    ``over`` (avg, min, max) the distances of their members. Then the cut: the highest node opens until there are enough."""
    gap = f"list_{over}(flatten(list_transform(a.m, lambda x: list_transform(b.m, lambda y: gaps[least(x, y) || '|' || greatest(x, y)]))))"
    pairs = f"flatten(list_transform(c, lambda a: list_transform(list_filter(c, lambda b: b.id > a.id), lambda b: {{'d': {gap}, 'i': a.id, 'j': b.id}})))"
    return f"""
ld AS ({distances}),
ln AS (SELECT tissue, list_sort(list_distinct(list(name_1) || list(name_2))) AS names, map_from_entries(list((name_1 || '|' || name_2, distance))) AS gaps FROM ld GROUP BY tissue),
lm AS (WITH RECURSIVE w(tissue, step, c, gaps, best, n) AS (
  SELECT tissue, 0, list_transform(names, lambda x, i: {{'id': i - 1, 'm': [x]}}), gaps, {{'d': 0.0::DOUBLE, 'i': -1::BIGINT, 'j': -1::BIGINT}}, len(names) FROM ln
  UNION ALL SELECT tissue, step + 1, list_append(list_filter(c, lambda a: a.id <> b.i AND a.id <> b.j),
      {{'id': n + step, 'm': list_filter(c, lambda a: a.id = b.i)[1].m || list_filter(c, lambda a: a.id = b.j)[1].m}}), gaps, b, n
    FROM (SELECT *, list_min({pairs}) AS b FROM w WHERE len(c) > 1))
  SELECT tissue, n + step - 1 AS id, best.d AS height, best.i AS i, best.j AS j, n FROM w WHERE step > 0),
lp AS (SELECT tissue, i AS id, id AS up, 0 AS pos FROM lm UNION ALL SELECT tissue, j, id, 1 FROM lm),
la AS (WITH RECURSIVE w(tissue, id, depth) AS (SELECT tissue, max(id), 0 FROM lm GROUP BY 1 UNION ALL SELECT lp.tissue, lp.id, depth + 1 FROM w JOIN lp ON lp.tissue = w.tissue AND lp.up = w.id) SELECT * FROM w),
lc AS (WITH RECURSIVE w(tissue, cut, want) AS (SELECT tissue, [max(id)], {groups} FROM lm GROUP BY tissue UNION ALL
    SELECT w.tissue, flatten(list_transform(cut, lambda x: CASE WHEN x = t.id THEN [t.i, t.j] ELSE [x] END)), want
    FROM w JOIN LATERAL (SELECT id, i, j FROM lm WHERE lm.tissue = w.tissue AND list_contains(w.cut, lm.id) ORDER BY height DESC, id DESC LIMIT 1) t ON true WHERE len(cut) < want)
  SELECT tissue, max_by(cut, len(cut)) AS cut FROM w GROUP BY tissue),
lg AS (WITH RECURSIVE w(tissue, id, coarse) AS (SELECT tissue, unnest(cut), generate_subscripts(cut, 1) - 1 FROM lc UNION ALL SELECT lp.tissue, lp.id, coarse FROM w JOIN lp ON lp.tissue = w.tissue AND lp.up = w.id) SELECT * FROM w),
lt AS (SELECT la.tissue, CASE WHEN la.id < n THEN names[la.id + 1] ELSE 'merge_' || (la.id - n + 1) END AS node, CASE WHEN up IS NOT NULL THEN 'merge_' || (up - n + 1) END AS parent, depth,
  coalesce(pos, 0) AS child_pos, la.id < n AS is_leaf, coalesce(height, 0) AS distance, coarse FROM la JOIN (SELECT tissue, names, len(names) AS n FROM ln) USING (tissue)
  LEFT JOIN lp USING (tissue, id) LEFT JOIN (SELECT tissue, id, height FROM lm) USING (tissue, id) LEFT JOIN lg USING (tissue, id))"""


def _recovered(scored: bool, scored_again: bool) -> str:
    """The anchor chain for two cell types under equal weights; whether each of its two solves is on joint z-scores of shares or on values."""
    solve = "greatest(0.0, least(1.0, sum((a0 - a1) * (b - a1)) / sum((a0 - a1) * (a0 - a1))))"
    pivot = lambda t: f"SELECT tissue, gene, max(value) FILTER (WHERE cell_type = 'F') AS a0, max(value) FILTER (WHERE cell_type = 'O') AS a1 FROM {t} GROUP BY ALL"
    raw = "SELECT tissue, mixture, gene, a0, a1, value AS b FROM ab JOIN apv USING (tissue, gene)"
    return f"""
ag AS (SELECT DISTINCT tissue, gene FROM blk2 SEMI JOIN sig2 USING (tissue, gene)),
asg AS (SELECT g.tissue, g.gene, t.cell_type, coalesce(s.value, 0) AS value FROM ag g JOIN (SELECT DISTINCT tissue, cell_type FROM sig2) t USING (tissue)
  LEFT JOIN sig2 s ON s.tissue = g.tissue AND s.gene = g.gene AND s.cell_type = t.cell_type),
ab AS (SELECT g.tissue, m.mixture, g.gene, coalesce(b.value, 0) AS value FROM ag g JOIN (SELECT DISTINCT tissue, mixture FROM blk2) m USING (tissue)
  LEFT JOIN blk2 b ON b.tissue = g.tissue AND b.gene = g.gene AND b.mixture = m.mixture),
apv AS ({pivot('asg')}),
ash AS (SELECT tissue, gene, cell_type, value / sum(value) OVER (PARTITION BY tissue, cell_type) AS value FROM asg),
abh AS (SELECT tissue, gene, mixture, value / sum(value) OVER (PARTITION BY tissue, mixture) AS value FROM ab),
ast AS (SELECT tissue, gene, avg(value) AS m, stddev_pop(value) AS d FROM (SELECT tissue, gene, value FROM ash UNION ALL SELECT tissue, gene, value FROM abh) GROUP BY ALL),
asz AS (SELECT tissue, gene, cell_type, (value - m) / CASE WHEN d > 0 THEN d ELSE 1 END AS value FROM ash JOIN ast USING (tissue, gene)),
apz AS ({pivot('asz')}),
az AS (SELECT tissue, mixture, gene, a0, a1, (value - m) / CASE WHEN d > 0 THEN d ELSE 1 END AS b FROM abh JOIN ast USING (tissue, gene) JOIN apz USING (tissue, gene)),
ar AS ({raw}),
af AS (SELECT tissue, mixture, {solve} AS x FROM {'az' if scored else 'ar'} GROUP BY ALL),
am AS (SELECT tissue, gene, sqrt(avg(pow(b - fit, 2))) / greatest(sqrt(avg(b * b)) + sqrt(avg(fit * fit)), 1e-8) AS rel FROM (
  SELECT *, a0 * x + a1 * (1 - x) AS fit FROM {'az' if scored else 'ar'} JOIN af USING (tissue, mixture)) GROUP BY ALL),
an AS (SELECT tissue, gene, CASE WHEN passed < 10 THEN place <= 10 ELSE rel <= f END AS is_anchor FROM (SELECT *, count(*) FILTER (WHERE rel <= f) OVER (PARTITION BY tissue) AS passed,
  row_number() OVER (PARTITION BY tissue ORDER BY rel, gene) AS place FROM am JOIN (SELECT tissue, quantile_cont(rel, 0.25) AS f FROM am GROUP BY 1) USING (tissue))),
ap AS (SELECT tissue, mixture, {solve} AS x FROM {'az' if scored_again else 'ar'} SEMI JOIN (SELECT * FROM an WHERE is_anchor) USING (tissue, gene) GROUP BY ALL)"""


RECOVERED = """SELECT tissue, gene, is_anchor, cell_type, value, recovered, recovered - value AS shift FROM (
  SELECT tissue, gene, is_anchor, cell_type, CASE cell_type WHEN 'F' THEN a0 ELSE a1 END AS value,
  CASE WHEN is_anchor THEN CASE cell_type WHEN 'F' THEN a0 ELSE a1 END ELSE greatest(0.0, CASE cell_type WHEN 'F' THEN (r0*g11 - r1*g01) / d ELSE (r1*g00 - r0*g01) / d END) END AS recovered FROM (
    SELECT *, g00*g11 - g01*g01 AS d, b0 + 0.6*a0 AS r0, b1 + 0.6*a1 AS r1 FROM (
      SELECT tissue, sum(x*x) + 0.6 + 1e-8 AS g00, sum(x*(1-x)) AS g01, sum((1-x)*(1-x)) + 0.6 + 1e-8 AS g11 FROM ap GROUP BY ALL) JOIN (
      SELECT tissue, gene, sum(value*x) AS b0, sum(value*(1-x)) AS b1 FROM ab JOIN ap USING (tissue, mixture) GROUP BY ALL) USING (tissue)
    JOIN apv USING (tissue, gene) JOIN an USING (tissue, gene)), (VALUES ('F'), ('O')) t(cell_type))"""


ORACLES: dict[str, str] = {
    "shared_genes": sql("SELECT DISTINCT tissue, gene FROM blk SEMI JOIN sig USING (tissue, gene)"),
    "shared_cell_types": sql("SELECT DISTINCT tissue, cell_type, EXISTS (SELECT 1 FROM tru WHERE tru.tissue = sig.tissue AND tru.cell_type = sig.cell_type) AS in_truth FROM sig"),
    "select_mixtures": sql("SELECT * FROM (SELECT tissue, mixture, dense_rank() OVER (PARTITION BY tissue ORDER BY mixture) AS place FROM (SELECT DISTINCT tissue, mixture FROM blk)) WHERE place <= 10"),
    "pick_mixtures": sql("SELECT t.tissue, s_suppkey AS mixture, EXISTS (SELECT 1 FROM blk WHERE blk.tissue = t.tissue AND blk.mixture = s_suppkey) AS found FROM supplier, (VALUES ('F'), ('X')) t(tissue)"),
    "normalize_columns": sql("SELECT tissue, mixture, gene, value / sum(value) OVER (PARTITION BY tissue, mixture) AS value FROM blk SEMI JOIN sig USING (tissue, gene)", "value"),
    "joint_zscore": sql("SELECT tissue, mixture, gene, b, a0, a1, a2 FROM z3", "b a0 a1 a2", THREE),
    "joint_zscore_all": sql("""SELECT tissue, gene, name, (value - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS value FROM (
      SELECT tissue, gene, cell_type AS name, value FROM dsig UNION ALL SELECT tissue, gene, mixture::VARCHAR, value FROM dblk) JOIN (
      SELECT tissue, gene, avg(value) AS m, stddev_pop(value) AS s FROM (SELECT tissue, gene, value FROM dsig UNION ALL SELECT tissue, gene, value FROM dblk) GROUP BY ALL) USING (tissue, gene)""", "value"),
    "normalize_nonnegative": sql("""SELECT method, tissue, mixture, cell_type, CASE WHEN t > 0 THEN v / t ELSE 1.0 / k END AS raw FROM (
      SELECT *, sum(v) OVER g AS t, count(*) OVER g AS k FROM (SELECT *, greatest(0.0, CASE WHEN mixture % 9 = 4 THEN -1.0 ELSE raw - 20 END) AS v FROM raws)
      WINDOW g AS (PARTITION BY method, tissue, mixture))""", "raw"),
    "log1p_counts": sql("SELECT tissue, cell_id, gene, ln(1 + greatest(value - 10, 0)) AS value FROM cnt", "value"),
    "normalize_labels": sql("SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'Mixture' ELSE 'Sample' END || l_suppkey AS label, l_suppkey AS number, count(*) AS n FROM lineitem GROUP BY ALL"),
    "discover_cases": sql("""SELECT DISTINCT l_suppkey AS dataset, p_brand AS tissue FROM li GROUP BY ALL HAVING count(*) FILTER (WHERE l_returnflag = 'A') > 0
      AND count(*) FILTER (WHERE l_returnflag = 'N') > 0 AND count(*) FILTER (WHERE l_returnflag = 'R') > 0"""),
    "long_to_matrix": sql("""SELECT tissue, mixture, max(truth) FILTER (WHERE cell_type = 'A') AS A, max(truth) FILTER (WHERE cell_type = 'N') AS N,
      max(truth) FILTER (WHERE cell_type = 'R') AS R FROM tru GROUP BY ALL""", "A N R"),
    "matrix_to_long": sql("SELECT tissue, mixture, cell_type, truth FROM tru", "truth"),
    "celltype_profiles": sql("""SELECT tissue, cell_type, gene, sum(m) / any_value(k) AS value FROM (
      SELECT tissue, cell_type, subject, gene, sum(ln(1 + value)) / any_value(n) AS m FROM cnt JOIN cel USING (tissue, cell_id)
      JOIN (SELECT tissue, cell_type, subject, count(*) AS n FROM cel GROUP BY ALL) USING (tissue, cell_type, subject) GROUP BY tissue, cell_type, subject, gene)
      JOIN (SELECT tissue, cell_type, count(DISTINCT subject) AS k FROM cel GROUP BY ALL) USING (tissue, cell_type) GROUP BY tissue, cell_type, gene""", "value"),
    "celltype_profiles_pooled": sql("SELECT tissue, cell_type, gene, sum(value) / any_value(n) AS value FROM cnt JOIN cel USING (tissue, cell_id) JOIN siz USING (tissue, cell_type) GROUP BY tissue, cell_type, gene", "value"),
    "aggregate_profiles_by_node": sql("SELECT * FROM nod", "value"),
    "gene_dispersion_score": sql("""SELECT tissue, gene, CASE WHEN top > 0 THEN raw / top ELSE 1.0 END AS score FROM (SELECT *, max(raw) OVER (PARTITION BY tissue) AS top FROM (
      SELECT tissue, gene, greatest(var_pop(value) / greatest(avg(value), 1e-12), 0) AS raw FROM dsig GROUP BY ALL))""", "score"),
    "split_gene_selection": sql("""SELECT * REPLACE (log10(score) AS score) FROM (SELECT *, row_number() OVER (PARTITION BY tissue, parent ORDER BY score DESC, gene) AS place FROM (
      SELECT tissue, parent, gene, var_pop(m) / (avg(v) + 1e-12) AS score FROM (
        SELECT tissue, parent, node, gene, avg(value) AS m, var_pop(value) AS v FROM dprof JOIN leaf ON leaf = cell_type JOIN edge USING (node) GROUP BY ALL)
      GROUP BY ALL HAVING count(*) > 1)) WHERE place <= 20""", "score"),
    "allocate_counts": sql("""SELECT tissue, mixture, cell_type, f + CASE WHEN place <= 1000 - t THEN 1 ELSE 0 END AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY tissue, mixture ORDER BY round(rest, 9) DESC, cell_type) AS place, sum(f) OVER (PARTITION BY tissue, mixture) AS t FROM (
        SELECT *, floor(truth * 1000) AS f, truth * 1000 - floor(truth * 1000) AS rest FROM tru))""", longs="n"),
    "draw_cells": sql("SELECT * FROM drawn"),
    "pseudobulk": sql("SELECT * FROM psb", "value"),
    "drawn_shares": sql("SELECT tissue, mixture, cell_type, sum(times) / sum(sum(times)) OVER (PARTITION BY tissue, mixture) AS truth FROM drawn GROUP BY tissue, mixture, cell_type", "truth"),
    "perturb_reference": sql("""SELECT tissue, gene, cell_type, v * sum(value) OVER g / sum(v) OVER g AS value FROM (
      SELECT *, value * exp(0.05 * (((gene * 37 + ascii(cell_type)) % 19) / 10.0 - 0.9)) AS v FROM sig) WINDOW g AS (PARTITION BY tissue, cell_type)""", "value"),
    "profile_correlation": sql(DISTANCES, "distance"),
    "build_hierarchy": sql("SELECT * FROM lt", "distance", _linkage(DISTANCES, "avg", "ceil(sqrt(any_value(n)))::INT"), "depth child_pos coarse"),
    "build_hierarchy_ties": sql("SELECT * FROM lt", "distance", _linkage(f"SELECT * REPLACE (floor(distance * 10) / 10 AS distance) FROM ({DISTANCES})", "min", "2"), "depth child_pos coarse"),
    "gram_stats": sql("""SELECT tissue, mixture, sum(a0*a0) AS h0, sum(a0*a1) AS h1, sum(a0*a2) AS h2, sum(a1*a1) AS h4, sum(a1*a2) AS h5, sum(a2*a2) AS h8,
      sum(a0*b) AS l0, sum(a1*b) AS l1, sum(a2*b) AS l2, sum(b*b) AS bb, count(*) AS n_genes FROM z3 GROUP BY ALL""", "h0 h1 h2 h4 h5 h8 l0 l1 l2 bb", THREE),
    "simplex_ls": sql(_long_two(_two_solution("", "1.0")), "prediction", TWO),
    "simplex_ls_weighted": sql(_long_two(_two_solution("", "(1 + gene / 10.0)")), "prediction", TWO),
    "simplex_ls_three": sql("SELECT tissue, mixture, cell_type, prediction FROM x3 JOIN z3t USING (tissue, k)", "prediction", THREE + "," + SUPPORTS),
    "nnls_solve": sql("""SELECT tissue, mixture, x[1] AS raw0, x[2] AS raw1, CASE WHEN x[1] + x[2] > 0 THEN x[1] / (x[1] + x[2]) ELSE 0.5 END AS x0,
      sqrt(greatest(0.0, h00*x[1]*x[1] + 2*h01*x[1]*x[2] + h11*x[2]*x[2] - 2*l0*x[1] - 2*l1*x[2] + bb)) AS residual FROM (
      SELECT *, CASE WHEN d > 0 AND l0*h11 - l1*h01 >= 0 AND l1*h00 - l0*h01 >= 0 THEN [(l0*h11 - l1*h01) / d, (l1*h00 - l0*h01) / d]
        WHEN pow(greatest(l0, 0), 2) / h00 >= pow(greatest(l1, 0), 2) / h11 THEN [greatest(l0, 0) / h00, 0.0] ELSE [0.0, greatest(l1, 0) / h11] END AS x FROM (
        SELECT *, h00*h11 - h01*h01 AS d FROM (SELECT tissue, mixture, sum(a0*a0) AS h00, sum(a0*a1) AS h01, sum(a1*a1) AS h11, sum(a0*b) AS l0, sum(a1*b) AS l1, sum(b*b) AS bb
        FROM z2m GROUP BY ALL)))""", "raw0 raw1 x0 residual", TWO),
    "weighted_deconvolve_given": sql("""SELECT tissue, mixture, xn + (x - xn) * pow(2.5 / 3.5, t) AS proportions0, x AS initial_proportions0, t AS iterations, true AS converged, t AS steps,
      10 * lo AS total_min, 10 * mid AS total_mean, 10 * hi AS total_max, NULL::VARCHAR AS error FROM (SELECT *, 1 + greatest(0, ceil(CASE WHEN x = xn THEN 0 ELSE
        ln(0.005 * 3.5 / (sqrt(2) * abs(x - xn))) / ln(2.5 / 3.5) END)) AS t FROM (""" + _two_solution("", "1.0") + ") JOIN (SELECT tissue, mixture, x AS xn FROM ("
      + _two_solution("", "(1 + gene / 10.0)") + ")) USING (tissue, mixture) JOIN (SELECT tissue, mixture, min(1 + gene / 10.0) AS lo, avg(1 + gene / 10.0) AS mid, "
      "max(1 + gene / 10.0) AS hi FROM z2 GROUP BY ALL) USING (tissue, mixture))", "proportions0 initial_proportions0 total_min total_mean total_max", TWO, "iterations steps"),
    "learn_gene_weights_parabola": sql("""SELECT tissue, mixture, gene, round(10 - (r - avg(r) OVER (PARTITION BY tissue, mixture)) / 2, 4) AS meta_weight FROM (
      SELECT tissue, mixture, gene, pow(x * a0 + (1 - x) * a1 - b, 2) AS r FROM z2 JOIN (""" + _two_solution("", "1.0") + ") USING (tissue, mixture))", "meta_weight", TWO),
    "deconvolve_batch_given": sql(f"""SELECT tissue, mixture, 'weighted' AS method, max(prediction) FILTER (WHERE k = 1) AS p0, max(prediction) FILTER (WHERE k = 2) AS p1,
      max(prediction) FILTER (WHERE k = 3) AS p2, 1 AS iterations, true AS converged, NULL::VARCHAR AS error FROM x3 WHERE mixture % 7 <> 3 GROUP BY tissue, mixture
      UNION ALL SELECT tissue, mixture, 'nnls', x[1], x[2], x[3], NULL, NULL, NULL FROM nz WHERE mixture % 7 <> 3
      UNION ALL {FAILED.replace(' FROM (', " FROM (VALUES ('weighted'), ('nnls')) v(method), (")}""", "p0 p1 p2", THREE + "," + SUPPORTS + "," + _nnls_three("z3m", "nz"), "iterations"),
    "deconvolve_batch_tree_given": sql(f"""SELECT tissue, mixture, 'hierarchical' AS method, max(mass) FILTER (WHERE node = 'A') AS p0, max(mass) FILTER (WHERE node = 'N') AS p1,
      max(mass) FILTER (WHERE node = 'R') AS p2, 2 AS iterations, true AS converged, NULL::VARCHAR AS error FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2) WHERE mixture % 7 <> 3 GROUP BY tissue, mixture
      UNION ALL SELECT tissue, mixture, 'nnls', x[1], x[2], x[3], NULL, NULL, NULL FROM nz WHERE mixture % 7 <> 3
      UNION ALL {FAILED.replace(' FROM (', " FROM (VALUES ('hierarchical'), ('nnls')) v(method), (")}""", "p0 p1 p2", THREE + "," + _nnls_three("z3m", "nz") + "," + ONE_AND_TWO, "iterations"),
    "hierarchical_deconvolve_given": sql("""SELECT tissue, mixture, node, parent, depth, node NOT IN (SELECT parent FROM he) AS is_leaf, raw, mass,
      CASE WHEN error IS NULL THEN 1 END AS iterations, CASE WHEN error IS NULL THEN true END AS converged, error FROM (
      SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)""", "raw mass", HIERARCHY, "depth iterations"),
    "parent_local_bulk": sql("""SELECT tissue, mixture, node, gene, greatest(greatest(mass, 1e-12) * (profile + value - fit), 1e-12) AS value FROM (
      SELECT p.tissue, p.mixture, n.node, p.gene, n.value AS profile, CASE n.node WHEN 'high' THEN 0.4 ELSE 0.6 END AS mass, p.value,
      sum(n.value * CASE n.node WHEN 'high' THEN 0.4 ELSE 0.6 END) OVER (PARTITION BY p.tissue, p.mixture, p.gene) AS fit
      FROM psb p JOIN nods n ON n.tissue = p.tissue AND n.gene = p.gene AND n.node IN ('high', 'low'))""", "value"),
    "propagate_masses": sql("""SELECT tissue, mixture, node, mass FROM m1 UNION ALL SELECT tissue, mixture, 'root', 1.0 FROM (SELECT DISTINCT tissue, mixture FROM lf)
      UNION ALL SELECT lf.tissue, lf.mixture, lf.node, m1.mass * raw / sum(raw) OVER (PARTITION BY lf.tissue, lf.mixture, edge.parent) FROM lf JOIN edge USING (node)
      JOIN m1 ON m1.tissue = lf.tissue AND m1.mixture = lf.mixture AND m1.node = edge.parent""", "mass", """
      lf AS (SELECT tissue, cell_id % 50 AS mixture, cell_type AS node, count(*)::DOUBLE AS raw FROM cel GROUP BY ALL),
      m1 AS (SELECT tissue, mixture, node, s / sum(s) OVER (PARTITION BY tissue, mixture) AS mass FROM (
        SELECT tissue, mixture, parent AS node, sqrt(sum(raw)) AS s FROM lf JOIN edge USING (node) GROUP BY ALL))"""),
    "anchor_gene_metrics": sql("""SELECT *, normalized_weight / (relative_residual + 1e-8) AS score FROM (
      SELECT tissue, gene, residual_rms, fitted_mean, residual_rms / greatest(scale, 1e-8) AS relative_residual, mean_weight,
      CASE WHEN hi - lo <= 1e-8 THEN 1.0 ELSE (mean_weight - lo) / (hi - lo) END AS normalized_weight FROM (SELECT *, min(mean_weight) OVER g AS lo, max(mean_weight) OVER g AS hi FROM (
        SELECT tissue, gene, sqrt(avg(pow(b.value - fitted, 2))) AS residual_rms, sqrt(avg(b.value * b.value)) + sqrt(avg(fitted * fitted)) AS scale, avg(fitted) AS fitted_mean
        FROM dblk b JOIN fit USING (tissue, mixture, gene) GROUP BY ALL) JOIN (SELECT tissue, gene, avg(meta_weight) AS mean_weight FROM wts GROUP BY ALL) USING (tissue, gene)
        WINDOW g AS (PARTITION BY tissue)))""", "residual_rms relative_residual mean_weight normalized_weight score fitted_mean", RANK1),
    "select_anchors": sql(_anchors(0.25, 0.75, 10, 0.5), "relative_residual mean_weight score", ANC),
    "select_anchors_capped": sql(_anchors(0.9, 0.1, 2, 0.3), "relative_residual mean_weight score", ANC),
    "anchor_proportions": sql("""SELECT tissue, mixture, cell_type, CASE WHEN cell_type = 'F' THEN x ELSE 1 - x END AS p FROM (
      SELECT tissue, mixture, greatest(0.0, least(1.0, sum((a0 - a1) * (b - a1)) / sum((a0 - a1) * (a0 - a1)))) AS x FROM (
        SELECT b.tissue, b.mixture, b.b, coalesce(f.v, 0) AS a0, coalesce(o.v, 0) AS a1 FROM db2 b
        LEFT JOIN nn f ON f.tissue = b.tissue AND f.gene = b.gene AND f.cell_type = 'F' LEFT JOIN nn o ON o.tissue = b.tissue AND o.gene = b.gene AND o.cell_type = 'O'
        WHERE b.gene % 3 = 0) GROUP BY ALL), (VALUES ('F'), ('O')) t(cell_type)""", "p", SHARES_TWO),
    "anchor_proportions_nonnegative": sql("""SELECT tissue, mixture, cell_type, CASE WHEN s > 0 THEN x[CASE WHEN cell_type = 'F' THEN 1 ELSE 2 END] / s ELSE 0.5 END AS p FROM (SELECT *, x[1] + x[2] AS s FROM (
      SELECT *, CASE WHEN d > 0 AND l0*h11 - l1*h01 >= 0 AND l1*h00 - l0*h01 >= 0 THEN [(l0*h11 - l1*h01) / d, (l1*h00 - l0*h01) / d]
        WHEN pow(greatest(l0, 0), 2) / h00 >= pow(greatest(l1, 0), 2) / h11 THEN [greatest(l0, 0) / h00, 0.0] ELSE [0.0, greatest(l1, 0) / h11] END AS x FROM (
        SELECT *, h00*h11 - h01*h01 AS d FROM (SELECT tissue, mixture, sum(a0*a0) AS h00, sum(a0*a1) AS h01, sum(a1*a1) AS h11, sum(a0*b) AS l0, sum(a1*b) AS l1 FROM (
          SELECT b.tissue, b.mixture, b.b, coalesce(f.v, 0) AS a0, coalesce(o.v, 0) AS a1 FROM db2 b
          LEFT JOIN nn f ON f.tissue = b.tissue AND f.gene = b.gene AND f.cell_type = 'F' LEFT JOIN nn o ON o.tissue = b.tissue AND o.gene = b.gene AND o.cell_type = 'O'
          WHERE b.gene % 3 = 0) GROUP BY ALL)))), (VALUES ('F'), ('O')) t(cell_type)""", "p", SHARES_TWO),
    "recover_signature": sql("""SELECT tissue, gene, is_anchor, cell_type, value, recovered, recovered - value AS shift FROM (
      SELECT tissue, gene, gene % 3 = 0 AS is_anchor, cell_type, CASE cell_type WHEN 'F' THEN s0 ELSE s1 END AS value,
      CASE WHEN gene % 3 = 0 THEN CASE cell_type WHEN 'F' THEN s0 ELSE s1 END ELSE greatest(0.0, CASE cell_type WHEN 'F' THEN (r0*g11 - r1*g01) / d ELSE (r1*g00 - r0*g01) / d END) END AS recovered FROM (
        SELECT *, g00*g11 - g01*g01 AS d, b0 + 0.6*s0 AS r0, b1 + 0.6*s1 AS r1 FROM (
          SELECT tissue, sum(p0*p0) + 0.6 + 1e-8 AS g00, sum(p0*p1) AS g01, sum(p1*p1) + 0.6 + 1e-8 AS g11 FROM pp GROUP BY ALL) JOIN (
          SELECT tissue, gene, sum(value*p0) AS b0, sum(value*p1) AS b1 FROM blk2 JOIN pp USING (tissue, mixture) GROUP BY ALL) USING (tissue) JOIN (
          SELECT tissue, gene, coalesce(max(value) FILTER (WHERE cell_type = 'F'), 0) AS s0, coalesce(max(value) FILTER (WHERE cell_type = 'O'), 0) AS s1 FROM sig2 GROUP BY ALL) USING (tissue, gene)),
      (VALUES ('F'), ('O')) t(cell_type))""", "value recovered shift", """pp AS (SELECT tissue, mixture, coalesce(max(p) FILTER (WHERE cell_type = 'F'), 0) AS p0,
      coalesce(max(p) FILTER (WHERE cell_type = 'O'), 0) AS p1 FROM tru2 GROUP BY ALL)"""),
    "reconstruction_error": sql("SELECT tissue, sqrt(sum(pow(value - fitted, 2))) AS error FROM dblk JOIN fit USING (tissue, mixture, gene) GROUP BY ALL", "error", RANK1),
    "anchor_recover_given": sql(RECOVERED, "value recovered shift", _recovered(True, True)),
    "anchor_recover_plain": sql(RECOVERED, "value recovered shift", _recovered(False, False)),
    "anchor_recover_mixed": sql(RECOVERED, "value recovered shift", _recovered(True, False)),
    "recover_reference_rank1": sql("SELECT tissue, mixture, gene, cell_type, recovered FROM r1", "recovered", RANK1),
    "subsample_genes": sql("SELECT tissue, mixture, repeat, gene FROM smp", "", TWO + "," + SAMPLE),
    "stability_solve": sql("""SELECT tissue, mixture, repeat, x AS x0, n_genes, 2 * abs(x - f) AS l1, sqrt(2.0) * abs(x - f) AS l2, w_min, w_mean, w_max FROM (
      SELECT tissue, mixture, repeat, count(*) AS n_genes, min(w) AS w_min, avg(w) AS w_mean, max(w) AS w_max,
      greatest(0.0, least(1.0, sum(w * (a0 - a1) * (b - a1)) / sum(w * (a0 - a1) * (a0 - a1)))) AS x FROM smp GROUP BY ALL) JOIN (
      SELECT tissue, mixture, x AS f FROM (""" + _two_solution("", "(1 + gene / 10.0)") + ")) USING (tissue, mixture)", "x0 l1 l2 w_min w_mean w_max", TWO + "," + SAMPLE),
    "align_predictions": sql("SELECT method, tissue, mixture, cell_type, prediction FROM pre", "prediction"),
    "align_predictions_lenient": sql("SELECT method, tissue, mixture, cell_type, prediction FROM pre", "prediction"),
    "method_coverage": sql("""SELECT t.tissue, m.method, count(DISTINCT p.mixture) AS mixtures, CASE WHEN count(p.mixture) > 0 THEN 'ok' ELSE 'missing' END AS status
      FROM (SELECT DISTINCT tissue FROM tru) t, (VALUES ('m0'), ('m1'), ('m2'), ('m3'), ('m9')) m(method) LEFT JOIN pre p ON p.tissue = t.tissue AND p.method = m.method GROUP BY ALL"""),
    "common_mixtures": sql("SELECT tissue, mixture FROM raws GROUP BY ALL HAVING count(DISTINCT method) = 4"),
    "prediction_detail": sql("SELECT * FROM det", "truth prediction abs_error signed_error"),
    "mixture_metrics": sql("SELECT * FROM met", "l1 accuracy mae rmse pearson rare_mae"),
    "subset_l1": sql("SELECT method, tissue, mixture, sum(abs_error) AS l1 FROM det WHERE cell_type IN ('A', 'R') GROUP BY ALL", "l1"),
    "method_correlations": sql(f"""SELECT *, {_corr_p('pearson', 'n')} AS pearson_p, {_corr_p('spearman', 'n')} AS spearman_p FROM (
      SELECT tissue, cell_type, method, count(*) AS n, avg(truth) AS mean_truth, avg(prediction) AS mean_prediction,
      CASE WHEN count(*) > 1 AND stddev_pop(truth) > 0 AND stddev_pop(prediction) > 0 THEN corr(truth, prediction) END AS pearson,
      CASE WHEN count(*) > 1 AND stddev_pop(rt) > 0 AND stddev_pop(rp) > 0 THEN corr(rt, rp) END AS spearman, avg(abs_error) AS mae, sqrt(avg(signed_error * signed_error)) AS rmse
      FROM (SELECT *, {MID.format(g='tissue, cell_type, method', v='truth')} AS rt, {MID.format(g='tissue, cell_type, method', v='prediction')} AS rp FROM det) GROUP BY ALL)""",
      "mean_truth mean_prediction pearson spearman mae rmse pearson_p spearman_p"),
    "spearman_by_group": sql("SELECT * FROM sp", "spearman", SPEAR),
    "recovery_summary": sql("""SELECT tissue, mixture, avg(spearman) AS mean_spearman, min(spearman) AS min_spearman, avg(spearman) >= 0.2 AS mean_pass,
      coalesce(bool_and(spearman >= 0.2), false) AS all_pass FROM sp GROUP BY ALL""", "mean_spearman min_spearman", SPEAR),
    "max_abs_difference": sql("""SELECT max(abs(a.prediction - b.prediction)) AS max_difference, count(*) AS n_rows FROM pre a JOIN pre b USING (tissue, mixture, cell_type)
      WHERE a.method = 'm0' AND b.method = 'm1'""", "max_difference"),
    "summarize_detail": sql(_summary("runs"), SUMS, longs="converged"),
    "method_summaries": sql("""SELECT method, dataset, tissue, datasets, cases, n, mean_l1, mean_accuracy, median_l1 FROM (
      SELECT method, NULL AS dataset, NULL AS tissue, count(DISTINCT dataset) AS datasets, count(DISTINCT dataset || tissue) AS cases, count(*) AS n, avg(l1) AS mean_l1, avg(accuracy) AS mean_accuracy, median(l1) AS median_l1 FROM runs WHERE error IS NULL GROUP BY method
      UNION ALL SELECT method, dataset, NULL, 1, count(DISTINCT tissue), count(*), avg(l1), avg(accuracy), median(l1) FROM runs WHERE error IS NULL GROUP BY method, dataset
      UNION ALL SELECT method, dataset, tissue, 1, 1, count(*), avg(l1), avg(accuracy), median(l1) FROM runs WHERE error IS NULL GROUP BY method, dataset, tissue)""", "mean_l1 mean_accuracy median_l1"),
    "compare_methods": sql("""SELECT *, accuracy_1 - accuracy_2 AS delta_accuracy, l1_1 - l1_2 AS delta_l1 FROM (SELECT tissue, avg(accuracy) FILTER (WHERE method = 'm0') AS accuracy_1,
      avg(accuracy) FILTER (WHERE method = 'm1') AS accuracy_2, avg(l1) FILTER (WHERE method = 'm0') AS l1_1, avg(l1) FILTER (WHERE method = 'm1') AS l1_2
      FROM runs WHERE method IN ('m0', 'm1') GROUP BY GROUPING SETS ((), (tissue)))""", "accuracy_1 accuracy_2 l1_1 l1_2 delta_accuracy delta_l1"),
    "l1_pivot_rank": sql("""SELECT tissue, max(l1) FILTER (WHERE method = 'm0') AS m0, max(l1) FILTER (WHERE method = 'm1') AS m1, max(l1) FILTER (WHERE method = 'm2') AS m2,
      max(l1) FILTER (WHERE method = 'm3') AS m3, max(method) FILTER (WHERE nth = 1) AS best_method, min(l1) AS best_l1, max(rank) FILTER (WHERE method = 'm2') AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY tissue ORDER BY round(l1, 12), method) AS nth, rank() OVER (PARTITION BY tissue ORDER BY round(l1, 12)) AS rank FROM (
        SELECT tissue, method, avg(l1) AS l1 FROM runs GROUP BY ALL)) GROUP BY tissue""", "m0 m1 m2 m3 best_l1"),
    "celltype_summary": sql(CTS, "mean_truth median_truth mae median_ae rare_mean_truth rare_mae rare_median_ae"),
    "winners": sql(WIN.format(e="mae", src=CTS), "best_error second_error margin relative_margin"),
    "rare_winners": sql("SELECT w.*, n_rare, rare_mean_truth FROM (" + WIN.format(e="rare_mae", src=f"SELECT * FROM ({CTS}) SEMI JOIN (SELECT tissue, cell_type FROM ({CTS}) GROUP BY ALL HAVING max(n_rare) >= 5) USING (tissue, cell_type)")
      + f") w JOIN (SELECT tissue, cell_type, max(n_rare) AS n_rare, avg(rare_mean_truth) AS rare_mean_truth FROM ({CTS}) GROUP BY ALL) USING (tissue, cell_type)", "best_error second_error margin relative_margin rare_mean_truth"),
    "low_mean_winners": sql("SELECT w.*, mean_truth FROM (" + WIN.format(e="mae", src=f"SELECT * FROM ({CTS}) SEMI JOIN (SELECT tissue, cell_type FROM ({CTS}) GROUP BY ALL HAVING avg(mean_truth) < 0.3335) USING (tissue, cell_type)")
      + f") w JOIN (SELECT tissue, cell_type, avg(mean_truth) AS mean_truth FROM ({CTS}) GROUP BY ALL) USING (tissue, cell_type)", "best_error second_error margin relative_margin mean_truth"),
    "rare_method_summary": sql("SELECT method, count(*) AS n, avg(abs_error) AS mae, median(abs_error) AS median_ae FROM det WHERE is_rare GROUP BY ALL", "mae median_ae"),
    "cumulative_windows": sql("""SELECT method, tissue, upto, count(*) AS n, avg(accuracy) AS mean, median(accuracy) AS median, avg((accuracy >= 0.9)::INT) AS pass_rate, min(accuracy) AS min
      FROM runs JOIN (VALUES (20), (40), (60), (80), (100)) b(upto) ON mixture <= upto GROUP BY ALL""", "mean median pass_rate min", longs="upto"),
    "numeric_summary": sql("""SELECT method, metric, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.25) AS q25,
      median(value) AS median, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95, max(value) AS max FROM (
      SELECT method, 'l1' AS metric, l1 AS value FROM runs UNION ALL SELECT method, 'accuracy', accuracy FROM runs UNION ALL SELECT method, 'rmse', rmse FROM runs
      UNION ALL SELECT method, 'pearson', pearson FROM runs) WHERE value IS NOT NULL GROUP BY ALL""", "mean std min q05 q25 median q75 q95 max"),
    "numeric_summary_delta": sql("""SELECT method, tissue, cell_type, 'prediction' AS metric, avg(prediction) AS mean, stddev_samp(prediction) AS std, min(prediction) AS min,
      quantile_cont(prediction, 0.05) AS q05, quantile_cont(prediction, 0.25) AS q25, median(prediction) AS median, quantile_cont(prediction, 0.75) AS q75, quantile_cont(prediction, 0.95) AS q95,
      max(prediction) AS max, avg(prediction - truth) AS mean_delta, avg(abs(prediction - truth)) AS mean_abs_delta FROM det GROUP BY ALL""", "mean std min q05 q25 median q75 q95 max mean_delta mean_abs_delta"),
    "signature_block_means": sql("""SELECT tissue, block, cell_type, genes, sum(value) / any_value(genes) AS mean_value FROM bl JOIN (SELECT tissue, block, count(DISTINCT gene) AS genes FROM bl GROUP BY ALL)
      USING (tissue, block) GROUP BY tissue, block, cell_type, genes""", "mean_value", """bl AS (SELECT * FROM sig JOIN (VALUES ('head', 0, 10), ('mid', 10, 40), ('all', 0, 60)) b(block, lo, hi) ON gene >= lo AND gene < hi)"""),
    "weight_block_summary": sql("""SELECT tissue, block, count(DISTINCT gene) AS genes, avg(meta_weight) AS mean_weight, median(meta_weight) AS median_weight, quantile_cont(meta_weight, 0.9) AS p90_weight
      FROM wts JOIN (VALUES ('head', 0, 10), ('mid', 10, 40), ('all', 0, 60)) b(block, lo, hi) ON gene >= lo AND gene < hi GROUP BY ALL""", "mean_weight median_weight p90_weight"),
    "gene_weight_stats": sql("""SELECT tissue, gene, avg(meta_weight) AS mean_weight, median(meta_weight) AS median_weight, stddev_samp(meta_weight) AS std_weight,
      avg((meta_weight > 1)::INT) AS share_above_1, max(meta_weight) <= 1 + 1e-9 AS at_floor FROM wts GROUP BY ALL""", "mean_weight median_weight std_weight share_above_1"),
    "value_counts": sql("SELECT * FROM dist", "value"),
    "detection_and_fold_change": sql("SELECT * FROM de", "mean_in mean_out pct_in pct_out log2fc pct_diff", longs="n_in n_out"),
    "rank_sum_test": sql("SELECT tissue, gene, cell_type, u, sqrt(u_variance) AS u_sd, z FROM rst", "u u_sd z"),
    "rank_sum_p": sql("SELECT tissue, cell_type, gene, u, sqrt(u_variance) AS u_sd, z, p, fdr FROM fdr", "u u_sd z p fdr"),
    "bh_fdr": sql("SELECT tissue, cell_type, gene, p, fdr FROM fdr", "p fdr"),
    "call_markers": sql("SELECT tissue, cell_type, gene, is_marker, in_list FROM call"),
    "primary_marker": sql("SELECT * FROM prim", "log2fc pct_diff"),
    "marker_composition": sql("SELECT *, genes / sum(genes) OVER (PARTITION BY tissue) AS share FROM (SELECT tissue, coalesce(primary_type, 'Unassigned') AS primary_type, count(*) AS genes FROM prim GROUP BY ALL)", "share"),
    "marker_weight_table": sql("SELECT tissue, cell_type, gene, is_marker, mean_weight, above_1, in_top FROM tab", "mean_weight"),
    "marker_weight_by_mixture": sql("SELECT * FROM mix", "marker_weight other_weight truth"),
    "marker_weight_enrichment": sql(ENRICHMENT, ENRICHED, GAPS),
    "enrichment_p": sql(ENRICHMENT_P, ENRICHED + " mann_whitney_p fisher_p wilcoxon_p pearson_p spearman_p mann_whitney_fdr fisher_fdr wilcoxon_fdr", GAPS + "," + WAYS),
    "top_markers": sql("""SELECT * FROM (SELECT tissue, cell_type, gene, mean_weight, row_number() OVER (PARTITION BY tissue, cell_type ORDER BY round(mean_weight, 9) DESC, gene) AS place
      FROM tab WHERE is_marker) WHERE place <= 5""", "mean_weight"),
    "batch_evaluation": sql(_summary("bm"), SUMS, THREE + "," + SUPPORTS + "," + _nnls_three("z3m", "n3") + """,
      bd AS (SELECT m.method, tissue, mixture, cell_type, truth, x AS prediction, abs(x - truth) AS abs_error, x - truth AS signed_error, truth > 0 AND truth < 0.33 AS is_rare FROM (
        SELECT 'simplex' AS method, tissue, mixture, cell_type, prediction AS x FROM x3 JOIN z3t USING (tissue, k)
        UNION ALL SELECT 'nnls', tissue, mixture, cell_type, x[k] FROM n3 JOIN z3t USING (tissue)) m JOIN tru USING (tissue, mixture, cell_type)),
      bm AS (SELECT method, tissue, mixture, sum(abs_error) AS l1, 1 - sum(abs_error) / 2 AS accuracy, avg(abs_error) AS mae, sqrt(avg(signed_error * signed_error)) AS rmse,
        CASE WHEN stddev_pop(truth) > 0 AND stddev_pop(prediction) > 0 THEN corr(truth, prediction) END AS pearson, avg(abs_error) FILTER (WHERE is_rare) AS rare_mae,
        NULL::VARCHAR AS error, true AS converged, 1 AS iterations FROM bd GROUP BY method, tissue, mixture)""", longs="converged"),
    "read_matrix_tsv": sql("""SELECT tissue, gene, dense_rank() OVER (PARTITION BY tissue ORDER BY gene) - 1 AS gene_idx, cell_type, dense_rank() OVER (PARTITION BY tissue ORDER BY cell_type) - 1 AS cell_type_idx,
      coalesce(value, 0) AS value FROM (SELECT DISTINCT tissue, gene FROM sig) JOIN (SELECT DISTINCT tissue, cell_type FROM sig) USING (tissue) LEFT JOIN sig USING (tissue, gene, cell_type)""", "value"),
    "read_labels": sql("SELECT tissue, row_number() OVER (PARTITION BY tissue ORDER BY cell_id) - 1 AS pos, cell_id::VARCHAR AS cell_id, cell_type FROM cel"),
    "read_hierarchy_json": sql("""SELECT tissue, node, parent, depth, CASE WHEN depth = 0 THEN 0 ELSE row_number() OVER (PARTITION BY tissue, parent ORDER BY node) - 1 END AS child_pos, depth = 2 AS is_leaf, CAST(0 AS DOUBLE) AS distance, n_leaves FROM (
      SELECT tissue, node, any_value(parent) AS parent, any_value(CASE WHEN node = 'root' THEN 0 WHEN node IN ('high', 'low') THEN 1 ELSE 2 END) AS depth, count(*) AS n_leaves
      FROM siz JOIN leaf ON leaf = cell_type LEFT JOIN edge USING (node) GROUP BY tissue, node)""", "distance", longs="depth child_pos"),
    "write_results": sql("SELECT * FROM det", "truth prediction abs_error signed_error"),
}
