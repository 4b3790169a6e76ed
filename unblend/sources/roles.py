"""Sales tables in the roles of expression data.

One place says which table plays what: a line item's part size is the gene, its
return flag the cell type, its supplier the mixture and its line status the
tissue. An order is a single cell; its priority is the cell's type, its customer's
nation the subject and their market segment the tissue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialize


class Roles:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.written: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A step that a query reads several times: made and written the first time."""
        if name not in self.written:
            self.written[name] = materialize(make(), name)
        return self.written[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def lines(self) -> DataFrame:
        """Line items with their part's size."""
        part = self.table("part").select("p_partkey", "p_size")
        return self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))

    def hierarchy(self) -> DataFrame:
        """(tissue, json): each tissue's cell types under high and low, as hierarchy files state them"""
        high = F.col("cell_type").isin(PRIORITIES[:2])
        types = self.cells().select("tissue", "cell_type", F.when(high, "high").otherwise("low").alias("name")).distinct()
        inner = types.groupBy("tissue", "name").agg(F.array_sort(F.collect_list(F.struct(F.col("cell_type").alias("name")))).alias("children"))
        top = inner.groupBy("tissue").agg(F.array_sort(F.collect_list(F.struct("name", "children"))).alias("children"))
        return top.select("tissue", F.to_json(F.struct(F.lit("root").alias("name"), "children")).alias("json"))

    def signature(self, tissue: str = "l_linestatus", cell_type: str = "l_returnflag") -> DataFrame:
        """(tissue, gene, cell_type, value)"""
        keys = [F.col(tissue).alias("tissue"), F.col("p_size").alias("gene"), F.col(cell_type).alias("cell_type")]
        return self.lines().groupBy(*keys).agg(F.avg("l_quantity").alias("value"))

    def bulk(self, tissue: str = "l_linestatus") -> DataFrame:
        """(tissue, mixture, gene, value)"""
        keys = [F.col(tissue).alias("tissue"), F.col("l_suppkey").alias("mixture"), F.col("p_size").alias("gene")]
        return self.lines().groupBy(*keys).agg(F.sum("l_quantity").alias("value"))

    def truth(self, tissue: str = "l_linestatus", cell_type: str = "l_returnflag") -> DataFrame:
        """(tissue, mixture, cell_type, truth): shares of quantity in a mixture"""
        keys = [F.col(tissue).alias("tissue"), F.col("l_suppkey").alias("mixture")]
        each = self.table("lineitem").groupBy(*keys, F.col(cell_type).alias("cell_type")).agg(F.sum("l_quantity").alias("q"))
        total = each.groupBy("tissue", "mixture").agg(F.sum("q").alias("total"))
        return each.join(total, ["tissue", "mixture"]).select("tissue", "mixture", "cell_type", (F.col("q") / F.col("total")).alias("truth"))

    def predictions(self) -> DataFrame:
        """(method, tissue, mixture, cell_type, raw): four methods by line number"""
        keys = [
            F.concat(F.lit("m"), F.pmod("l_linenumber", F.lit(4)).cast("string")).alias("method"),
            F.col("l_linestatus").alias("tissue"),
            F.col("l_suppkey").alias("mixture"),
            F.col("l_returnflag").alias("cell_type"),
        ]
        return self.table("lineitem").groupBy(*keys).agg(F.sum("l_quantity").alias("raw"))

    def weights(self) -> DataFrame:
        """(tissue, mixture, gene, meta_weight): mean quantity in place of learned weights"""
        keys = [F.col("l_linestatus").alias("tissue"), F.col("l_suppkey").alias("mixture"), F.col("p_size").alias("gene")]
        return self.lines().groupBy(*keys).agg((1 + F.avg("l_discount") * 100).alias("meta_weight"))

    def cells(self) -> DataFrame:
        """(tissue, cell_id, cell_type, subject)"""
        customer = self.table("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
        return (
            self.table("orders")
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("c_mktsegment").alias("tissue"),
                F.col("o_orderkey").alias("cell_id"),
                F.col("o_orderpriority").alias("cell_type"),
                F.col("c_nationkey").alias("subject"),
            )
        )

    def counts(self) -> DataFrame:
        """(tissue, cell_id, gene, value): sparse, what is absent is 0"""
        cells = self.cells().select("tissue", "cell_id")
        each = self.lines().groupBy(F.col("l_orderkey").alias("cell_id"), F.col("p_size").alias("gene"))
        return each.agg(F.sum("l_quantity").alias("value")).join(cells, "cell_id").select("tissue", "cell_id", "gene", "value")

    def tree(self) -> DataFrame:
        """(node, parent, depth, child_pos, is_leaf): priorities under high and low"""
        rows = [("root", None, 0, 0, False), ("high", "root", 1, 0, False), ("low", "root", 1, 1, False)]
        rows += [(p, "high" if k < 2 else "low", 2, k, True) for k, p in enumerate(PRIORITIES)]
        return self.spark.createDataFrame(rows, "node string, parent string, depth int, child_pos int, is_leaf boolean")

    def pairs_tree(self) -> tuple[DataFrame, DataFrame]:
        """``tree`` and ``node_leaf`` with two children a node: the lowest two priorities are under a node of their own."""
        at = {"high": "root", "low": "root", "rest": "low"} | dict(zip(PRIORITIES, ("high", "high", "low", "rest", "rest")))
        way = lambda n: [n, *(way(at[n]) if n in at else ())]
        rows = [(n, p, len(way(n)) - 1, k % 2, n in PRIORITIES) for k, (n, p) in enumerate(at.items())]
        tree = self.spark.createDataFrame([("root", None, 0, 0, False), *rows], "node string, parent string, depth int, child_pos int, is_leaf boolean")
        return tree, self.spark.createDataFrame([(n, leaf) for leaf in PRIORITIES for n in way(leaf)], "node string, leaf string")

    def node_leaf(self) -> DataFrame:
        """(node, leaf): every node above or at a leaf"""
        rows = [(n, p) for k, p in enumerate(PRIORITIES) for n in ("root", "high" if k < 2 else "low", p)]
        return self.spark.createDataFrame(rows, "node string, leaf string")


#: Values of the priority column (fixed).
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
