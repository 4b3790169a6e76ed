"""Queries that draw single cells, on small invented tables: right rows, and no task or driver with all draws."""

import duckdb
import pytest
from pyspark.sql import functions as F

from unblend.jobs import oracles, queries
from unblend.operators import profiles, tree, weighted
from unblend.sources.roles import PRIORITIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    made = {
        "customer": spark.range(12).select(F.col("id").alias("c_custkey"), F.when(F.col("id") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("c_mktsegment"), (F.col("id") % 3).cast("int").alias("c_nationkey")),
        "supplier": spark.range(8).select(F.col("id").alias("s_suppkey")),
        "part": spark.range(40).select(F.col("id").alias("p_partkey"), (F.col("id") % 7 + 1).cast("int").alias("p_size"), F.lit("b").alias("p_brand")),
        "orders": spark.range(200).select(F.col("id").alias("o_orderkey"), ((F.col("id") * 5) % 12).alias("o_custkey"), F.get(F.array(*map(F.lit, PRIORITIES)), ((F.col("id") * 3 + F.floor(F.col("id") / 9)) % 5).cast("int")).alias("o_orderpriority")),
        "lineitem": spark.range(700).select(
            ((F.col("id") * 11) % 190).alias("l_orderkey"), ((F.col("id") * 13) % 40).alias("l_partkey"), (F.col("id") % 8).alias("l_suppkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"),
            (F.col("id") * 17 % 50 + 1).cast("double").alias("l_quantity"), F.lit(0.1).alias("l_discount"), F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        ),
    }
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def wanted(folder, name):
    with duckdb.connect() as c:
        for table in ("customer", "supplier", "part", "orders", "lineitem"):
            c.execute(f"create view {table} as from '{folder}/{table}.parquet/*.parquet'")
        return sorted(c.execute(oracles.ORACLES[name]).fetchall(), key=str)


def broadcasts(df):
    """The parts of a plan that has run which are broadcast, a text each."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    deep = lambda line: len(line) - len(line.lstrip(" :+-*|"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [x for x in lines[i + 1 :] if x.strip()]
            yield "\n".join(below[: next((k for k, x in enumerate(below) if deep(x) <= deep(line)), len(below))])


@pytest.mark.parametrize("name", ["pseudobulk", "drawn_shares"])
def test_all_draws_and_none_broadcast(spark, tables, name):
    df = queries.QUERIES[name](spark, tables)
    assert sorted((tuple(r) for r in df.collect()), key=str) == wanted(tables, name)
    assert not any("Generate" in part for part in broadcasts(df))


def test_the_tissue_bulk_is_made_once(spark, tables, monkeypatch):
    made, make = [], profiles.pseudobulk
    monkeypatch.setattr(profiles, "pseudobulk", lambda *a: made.append(1) or make(*a))
    got = sorted((tuple(r) for r in queries.QUERIES["parent_local_bulk"](spark, tables).collect()), key=str)
    assert got == wanted(tables, "parent_local_bulk")
    assert len(made) == 1


@pytest.mark.parametrize("name", ["hierarchical_deconvolve_given", "hierarchical_deconvolve", "deconvolve_batch_tree"])
def test_the_hierarchy_reads_a_written_bulk(spark, tables, monkeypatch, name):
    seen = []
    for module, f in ((tree, "hierarchical_deconvolve"), (weighted, "deconvolve_batch")):
        monkeypatch.setattr(module, f, lambda *a, own=getattr(module, f), **k: seen.append(a[:2]) or own(*a, **k))
    df = queries.QUERIES[name](spark, tables)
    for read in seen[0]:
        plan = read._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" in plan and not any(word in plan for word in ("Join", "Aggregate", "Generate"))
    keys = [c for c in ("tissue", "mixture", "method", "node") if c in df.columns]
    got = {tuple(r[k] for k in keys): r for r in df.collect()}
    assert got and (name not in oracles.ORACLES or {k[:2] for k in got} == {k[:2] for k in wanted(tables, name)})
