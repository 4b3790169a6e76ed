"""Joins in which one key may have a large part of all rows.

A key with more than one in ``PARTS`` of the rows counts as hot. There are fewer than ``PARTS`` of
those, whatever the data, so they can be sent to every task; all other keys are small
enough for a task each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1024


def join_by_count(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` with the one row of ``right`` for its keys; ``how``: inner or left.

    ``count`` is a column of ``right``, dropped here: how many of the ``total`` rows of ``left`` have the keys. ``right``
    is read twice and ``left`` too, so both should be written tables or cheap to make.
    """
    limit = total / PARTS
    hot = right.where(F.col(count) > limit).drop(count)
    rest = right.where(F.col(count) <= limit).drop(count)
    small = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return left.join(F.broadcast(hot), keys).select(*small.columns).unionByName(small)


def join_salted(rows: DataFrame, one: DataFrame, key: str, spread: Column, total: int) -> DataFrame:
    """``rows`` with the one row of ``one`` for ``key``, where rows of ``one`` are large.

    A hot key's rows go to several tasks by the hash ``spread``, and its row of ``one`` to each of them:
    fewer than twice ``PARTS`` copies in all. ``rows``, ``total`` of them, is read twice.
    """
    limit = max(1.0, total / PARTS)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > limit)
    hot = hot.select(key, F.ceil(F.col("_k") / limit).cast("int").alias("_fan"))
    fan = F.coalesce("_fan", F.lit(1))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(spread, fan).cast("int")).drop("_fan")
    copies = one.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), fan - 1))).drop("_fan")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")
