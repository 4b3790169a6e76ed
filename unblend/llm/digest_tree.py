"""Exact deduplication: a tree merge of sorted digest runs.

Every row's text becomes a digest. Rows are dealt to ``fan_in ** rounds`` runs
by a hash of their id and place, so the copies of one text, however many, start out spread
over all runs. In each round the runs whose numbers differ in one digit (to the
base ``fan_in``) exchange entries: an entry goes to the run whose digit there
is the digest's own: with a base of 16 as four binomial rounds at once. A partition holds whole runs, several where there are more
runs than partitions. Spark's exchange doesn't keep the order of the sorted blocks that arrive, so they are sorted again; then equal
digests lie side by side and are merged in that order into one sorted run, which is written.
After the last round each digest is in the one run that its digits name. A
digest has at most one entry in a run, so no merge sees more than ``fan_in``
entries of it, and a text that a third of all rows share costs no more than any
other. The decisions go back down through the same levels, where a digest again
meets at most ``fan_in`` runs at a time, until rows find theirs by (run, digest).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, materialize

#: Texts count as equal when all three agree: SHA-256, length in bytes and a second hash.
KEY = ["sha", "bytes", "check"]


def _next_run(round_: int, fan_in: int) -> Column:
    """The run that an entry of ``run`` goes to in a round."""
    step = fan_in**round_
    digit = lambda x: F.pmod(F.floor(x / F.lit(step)).cast("long"), F.lit(fan_in))
    goal = F.pmod(F.shiftright("check", 8 * round_), F.lit(fan_in))
    return (F.col("run") + (goal - digit(F.col("run"))) * step).cast("int")


def digest_entries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One entry a row: the facts of its text and ``row``, the pair of its
    id and a number that tells repeated rows apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.octet_length(text).alias("bytes"),
        F.xxhash64(text).alias("check"),
        F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("no")).alias("row"),
    )


def merge_levels(entries: DataFrame, keep: str, fan_in: int, rounds: int) -> list[DataFrame]:
    """The runs after each round, from the rows' own runs (level 0) to the merged
    ones: a row per (run, digest) with the row that stays and the group's size."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    # dealt by run alone: grouping by (run, digest) then needs no further exchange, and goes through a sorted run in order
    merged = lambda rows, n: (
        rows.repartition("run").sortWithinPartitions("run", *KEY).groupBy("run", *KEY).agg(pick("row").alias("row"), n.alias("n"))
    )
    levels = [materialize(merged(entries, F.count(F.lit(1))), "run-level")]
    for r in range(rounds):
        levels.append(materialize(merged(levels[-1].withColumn("run", _next_run(r, fan_in)), F.sum("n")), "run-level"))
    return levels


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    fan_in: int = 16,
    rounds: int | None = None,
    rows_per_run: int = 1_000_000,
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after no change; null counts as empty, so null
    and empty texts form one group. Of equal texts the row with the smallest
    (``keep="largest"``: largest) id stays, where a null id is smaller than
    all others; of rows that repeat both id and text one stays. Columns other
    than the two named are ignored, whatever their names. An empty table
    gives no rows. Texts of any length are read whole. Unless ``rounds`` is given, there are as many (2 at
    least) as leave about ``rows_per_run`` rows to a run.
    """
    entries = materialize(digest_entries(docs, id_col, text_col), "digests")
    if rounds is None:
        rounds = max(2, math.ceil(math.log(max(1, entries.count() / rows_per_run), fan_in)))
    run = F.pmod(F.xxhash64("row.id", "row.no"), F.lit(fan_in**rounds)).cast("int")
    entries = entries.withColumn("run", run)
    levels = merge_levels(entries, keep, fan_in, rounds)
    answer = levels[-1].where("n > 1").select("run", *KEY, F.col("row").alias("keep"), F.col("n").alias("size"))
    for r in reversed(range(rounds)):
        lower = levels[r].select(F.col("run").alias("from"), _next_run(r, fan_in).alias("run"), *KEY)
        answer = lower.join(answer, ["run", *KEY]).drop("run").withColumnRenamed("from", "run")
    found = entries.join(answer, ["run", *KEY], "left")
    stays = F.coalesce("keep", "row")
    return found.select(
        F.col("row.id").alias(id_col),
        stays["id"].alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (stays["no"] == F.col("row.no")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Rows are matched by id and digest, so an id that several texts share does no
    harm. Only where rows repeat both (which the marks tell) is one of them picked.
    """
    marks = materialize(exact_dedup(docs, id_col, text_col, keep), "copy-marks")
    key, sha, digest = fresh(docs, "gone_id", "gone_sha", "own_sha")
    pairs = marks.groupBy(F.col(id_col).alias(key), F.unhex("text_sha256").alias(sha))
    pairs = pairs.agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    gone = pairs.where("not stays").select(key, sha)
    own = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    left = docs.join(gone, F.col(id_col).eqNullSafe(F.col(key)) & (own == F.col(sha)), "left_anti")
    if pairs.where("n > 1").isEmpty():
        return left
    return left.withColumn(digest, own).dropDuplicates([id_col, digest]).select(*docs.columns)
