"""Row numbers within groups, whatever part of all rows a group has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


def numbered(rows: DataFrame, groups: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... within ``groups`` in the order of ``order`` (which should leave no ties).

    Rows are dealt to partitions by ranges of groups and order, and written. A partition holds a stretch of a group, so a row's number is its
    place in the stretch and what the stretches before it hold: one count a group and partition. No task sees all rows of a large group.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*groups, "_part"]
    dealt = rows.repartitionByRange(parts, *groups, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "stretches")
    held = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    same = [placed[k].eqNullSafe(held[k]) for k in keys]
    joined = placed.join(held, same)
    return joined.select(*[placed[c] for c in rows.columns], (held["_before"] + placed["_place"]).cast("long").alias(name))
