"""Readers and writers of the file layouts that expression data comes in."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line): lines with a key that orders them within their file, however
    files are split; blank lines are left out."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )
    at = F.struct("block", F.monotonically_increasing_id().alias("no"))
    return raw.select("file", at.alias("at"), "line").where(F.trim("line") != "")


def _header(lines: DataFrame) -> DataFrame:
    """(file, header, first): each file's first line."""
    return lines.groupBy("file").agg(F.min_by("line", "at").alias("header"), F.min("at").alias("first"))


def _number(lines: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("file").orderBy("at"))


def tissue_of(file: str = "file") -> Column:
    """A file's folder names its tissue, alone or as ``tissue=name`` (with Spark's own escapes)."""
    plain = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    folder = plain(F.element_at(F.split(F.col(file), "/"), -2))
    return F.when(folder.contains("="), plain(F.regexp_replace(folder, "^[^=]*=", ""))).otherwise(folder)


def read_matrix_tsv(spark: SparkSession, path: str, row: str = "gene", column: str = "cell_type") -> DataFrame:
    """Labelled matrices as long rows (tissue, row, row_idx, column, column_idx, value).

    The header names the value columns only, one field fewer than rows have; one with
    a field for the row names too is understood. Places count from 0 in file order.
    Values that aren't numbers are null.
    """
    lines = _lines(spark, path)
    head = _header(lines).withColumn("names", F.split("header", "\t"))
    body = lines.join(head, "file").where(F.col("at") > F.col("first"))
    body = body.withColumn(f"{row}_idx", _number(body) - 1).withColumn("fields", F.split("line", "\t"))
    extra = F.size("names") - F.size("fields") + 1
    names = F.when(extra > 0, F.slice("names", extra + 1, F.size("names"))).otherwise(F.col("names"))
    cells = body.select(
        tissue_of().alias("tissue"), F.get("fields", F.lit(0)).alias(row), f"{row}_idx", names.alias("names"),
        F.posexplode(F.slice("fields", 2, 1 << 30)).alias(f"{column}_idx", "text"),
    )
    value = F.trim("text").try_cast("double")
    return cells.select("tissue", row, f"{row}_idx", F.get("names", F.col(f"{column}_idx")).alias(column), f"{column}_idx", value.alias("value"))


def write_matrix_tsv(long: DataFrame, folder: str, row: str = "gene", column: str = "cell_type", value: str = "value") -> None:
    """Long rows (tissue, row, column, value) as one matrix file a tissue, ``folder/tissue=name/part-*``, in the
    layout that ``read_matrix_tsv`` reads: rows and columns by name, what is absent as 0.

    The layout asks for one file a tissue, so a tissue is one task's, which holds one line at a time.
    """
    names = long.groupBy("tissue").agg(F.array_sort(F.collect_set(column)).alias("names"))
    cells = long.groupBy("tissue", row).agg(F.map_from_entries(F.collect_list(F.struct(column, value))).alias("m"))
    at = F.transform("names", lambda n: F.coalesce(F.try_element_at("m", n), F.lit(0.0)).cast("string"))
    lines = cells.join(names, "tissue").select(
        "tissue", F.lit(1).alias("part"), F.col(row).alias("key"), F.array_join(F.concat(F.array(F.col(row).cast("string")), at), "\t").alias("line")
    )
    key = cells.schema[row].dataType
    head = names.select(
        "tissue", F.lit(0).alias("part"), F.lit(None).cast(key).alias("key"), F.array_join(F.transform("names", lambda n: n.cast("string")), "\t").alias("line")
    )
    _write_lines(head.unionByName(lines), folder)


def write_labels(long: DataFrame, folder: str, value: str, order: str) -> None:
    """Rows (tissue, value) as one file of a column a tissue, in the order of ``order``, under a header."""
    rows = long.select("tissue", F.lit(1).alias("part"), F.col(order).alias("key"), F.col(value).cast("string").alias("line"))
    head = long.select("tissue").distinct().select(
        "tissue", F.lit(0).alias("part"), F.lit(None).cast(long.schema[order].dataType).alias("key"), F.lit(value).alias("line")
    )
    _write_lines(head.unionByName(rows), folder)


def _write_lines(lines: DataFrame, folder: str) -> None:
    placed = lines.repartition("tissue").sortWithinPartitions("tissue", "part", "key")
    placed.select("tissue", "line").write.partitionBy("tissue").option("maxRecordsPerFile", 0).text(folder)


def read_labels(spark: SparkSession, path: str, name: str = "value", header: bool = True) -> DataFrame:
    """One-column files as (tissue, pos, name); places count from 0 after the header."""
    lines = _lines(spark, path)
    pos = _number(lines) - (2 if header else 1)
    return lines.select(tissue_of().alias("tissue"), pos.alias("pos"), F.trim("line").alias(name)).where("pos >= 0")


def pair_labels(cells: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Labels joined to cells (tissue, pos) by place; a difference in length stops the job."""
    both = cells.join(labels, ["tissue", "pos"], "full")
    fits = F.col("cell_id").isNotNull() & F.col(name).isNotNull()
    checked = F.when(fits, F.col(name)).otherwise(F.raise_error(F.lit(f"{name}: not as many as there are cells")).cast("string"))
    return both.withColumn(name, checked)


def read_hierarchy_json(spark: SparkSession, path: str, cell_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, node_leaf) of hierarchy files: edges (tissue, node, parent, depth, child_pos, is_leaf,
    distance); node_leaf (tissue, node, leaf) for every node above or at a leaf.

    A file's tissue is its name (``Fat_hierarchy.json``) or its folder's (``tissue=Fat``). A tree
    is a few dozen names, so files are walked on the driver. Names must be
    unique, a leaf stands for one cell type, and with ``cell_types`` the leaves must be those.
    """
    edges, leaves = [], []
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    tissue_ = F.when(folder.contains("="), tissue_of("_metadata.file_path")).otherwise(F.regexp_replace("_metadata.file_name", r"(_hierarchy)?\.json$", ""))
    for r in spark.read.text(path, wholetext=True).select("value", tissue_.alias("tissue")).collect():
        tissue, names = r["tissue"], set()

        def walk(node: dict, parent: str | None, depth: int, pos: int, tissue: str = tissue, names: set = names) -> list[str]:
            name, children = node["name"], node.get("children") or []
            if name in names:
                raise ValueError(f"{tissue}: node {name} occurs twice")
            names.add(name)
            edges.append((tissue, name, parent, depth, pos, not children, float(node.get("distance") or 0.0)))
            own = [name] if not children else [x for k, c in enumerate(children) for x in walk(c, name, depth + 1, k)]
            stated = node.get("cell_types")
            if stated and sorted(stated) != sorted(own):
                raise ValueError(f"{tissue}: node {name} states other cell types than its leaves")
            leaves.extend((tissue, name, x) for x in own)
            return own

        found = walk(json.loads(r["value"]), None, 0, 0)
        if cell_types is not None and sorted(found) != sorted(cell_types):
            raise ValueError(f"{tissue}: leaves and cell types differ")
    tree = spark.createDataFrame(edges, "tissue string, node string, parent string, depth int, child_pos int, is_leaf boolean, distance double")
    return tree, spark.createDataFrame(leaves, "tissue string, node string, leaf string")


def write_results(tables: dict[str, DataFrame], folder: str, config: dict | None = None, overwrite: bool = False, keys: tuple[str, ...] = ("tissue",)) -> None:
    """Each table as gzip CSV in its own folder, by key where it has the keys, and the run's
    configuration as JSON. Existing results are an error unless ``overwrite``."""
    mode = "overwrite" if overwrite else "errorifexists"
    for name, df in tables.items():
        by = [k for k in keys if k in df.columns]
        df.write.mode(mode).partitionBy(*by).csv(f"{folder}/{name}", header=True, compression="gzip")
    if config is not None and tables:
        spark = next(iter(tables.values())).sparkSession
        text = json.dumps(config, sort_keys=True)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/config")
