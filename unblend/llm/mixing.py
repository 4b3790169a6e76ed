"""Mixing sources to target weights by a hash-random order and exact cuts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, materialize, words

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, share: float, max_epochs: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (source, size): source, source_size, target.

    The total to hand out is ``share`` times all sizes. Each source gets its
    weight's part but at most ``max_epochs`` times its size; what is over goes to the
    others by weight until none is above. That end state has one closed form:
    the sources that are capped come first in the order of cap per weight, and
    the others all get the same amount per weight. One row a source passes
    through the windows here, whatever the number of documents.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    ranked = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place.cast("int")).cast("double"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ranked = ranked.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(from_here)
    ranked = ranked.withColumn("level", level).withColumn("nth", F.row_number().over(by_ratio))
    # the first source, in this order, that its even share does not fill sets the level of all after it
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(whole)
    target = F.when(fits.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), fits["level"] * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 0,
    buckets: int | None = None,
) -> DataFrame:
    """One row per input row: ``id_col``, size, source_size, target, taken and, for
    callers that need the row again, ``copies`` (times that the mix has it).

    A document's key is a hash of its id and text; equal-width ranges of the keys, by default about as
    many as a range has rows, cut every source into sorted ``buckets``, so a
    source with a third of all rows is many tasks' work, and so are rows without an id. Bucket totals are
    summed along each source, and windows inside a bucket give each document the
    number of words before it. A source takes whole passes while its target holds
    them, then documents in key order up to the target, the last one only if that
    brings the sum nearer. No document is cut, so taken words differ from the
    target by at most half of one document.

    Null texts have size 0 and are taken in whole passes only; a null
    source is a source of its own, the last in order. Rows that repeat an id are
    separate rows, with equal keys if they repeat the text too. Other columns are ignored. An empty table gives
    no rows. Reruns agree: keys depend on ids, texts and ``seed`` alone.
    """
    plan = _planned(docs, id_col, text_col, source_col, share, max_epochs, weights, seed, buckets)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return plan.select(F.col("id").alias(id_col), "size", "source_size", "target", taken, "copies")


def _planned(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 0,
    buckets: int | None = None,
) -> DataFrame:
    """A row per input row: id, source, size, source_size, target and copies."""
    sizes = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)).alias("key"),
        ),
        "mix-sizes",
    )
    targets = materialize(source_targets(sizes, share, max_epochs, weights), "mix-targets")
    buckets = buckets or max(1, math.isqrt(sizes.count()))
    width = 2.0**64 / buckets
    bucket = F.least(F.floor((F.col("key").cast("double") + 2.0**63) / width), F.lit(buckets - 1)).cast("int")
    rows = sizes.withColumn("bucket", bucket)
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("start", F.coalesce(F.sum("words").over(along), F.lit(0)))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "source_size", "target")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_bucket", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    )
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - passes * F.col("source_size")
    partly = (F.col("start") + F.col("in_bucket") + F.col("size") / 2 <= rest) & (F.col("size") > 0)
    copies = (passes + F.when(partly, 1).otherwise(0)).cast("long")
    return placed.select("id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix`` takes it, and no others.

    Rows may share an id or have none. Those of one id, source and size are alike to ``mix``, which
    gives some of them one copy more than the rest: the first by a hash of the row.
    """
    group, nth, low, more, copy = fresh(docs, "mixed_group", "mixed_nth", "mixed_low", "mixed_more", "mixed_copy")
    # nulls within structs are equal, so these join where plain columns would not
    plan = _planned(docs, id_col, text_col, source_col, **options)
    plan = plan.select(F.struct("id", "source", "size").alias(group), "copies").groupBy(group).agg(
        F.min("copies").alias(low), (F.sum("copies") - F.count(F.lit(1)) * F.min("copies")).alias(more)
    )
    row = F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t])
    # of the plan's own type, nullable size included, or else rows would be exchanged once more for the join
    size = F.nullif(word_count(F.col(text_col)), F.lit(-1)).alias("size")
    placed = docs.withColumn(group, F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size))
    placed = placed.withColumn(nth, F.row_number().over(Window.partitionBy(group).orderBy(row)))
    copies = F.col(low) + F.when(F.col(nth) <= F.col(more), 1).otherwise(0)
    taken = placed.join(plan, group).withColumn(copy, copies).where(F.col(copy) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy))).alias(copy)).drop(copy)
