"""Quality rules: text statistics and a learned decision list over them.

Everything here is Spark expressions and aggregates. The list is learned by
sequential covering: grow a conjunction of thresholds on one part of the labelled
rows, prune it on the other, drop what it covers, go on. Each step asks Spark
for a histogram of the rows that are left, so what the driver sees is a few
hundred counts, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, words

#: Characters that count as symbols (fixed value).
SYMBOLS = r"[#*$%&|<>]"


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and counts of its whole text.

    n_words; word_chars (code points in words); n_symbols; n_dup_lines
    (lines with a word that equal an earlier line); n_repeat_words (words in
    three-word windows that the text has twice or more); n_distinct_words;
    n_lines (lines with a word); n_upper (A-Z); n_marks (! and ?). Null and
    blank texts have zero of each. Windows are compared by a 64-bit hash. Other
    columns are ignored; repeated rows stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), words(text).alias("w"))
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    grams = F.when(F.size("w") > 2, F.transform(F.sequence(F.lit(0), F.size("w") - 3), window))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = rows.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        F.coalesce(grams, F.array().cast("array<bigint>")).alias("g"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
        lines.alias("lines"),
    )
    # only texts with a repeated window are sorted; equal windows are then neighbours
    placed = F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    repeated = counted.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), placed))
    same = lambda x, j: F.coalesce(F.get("s", j)["g"] == x["g"], F.lit(False))
    starts = F.transform(F.filter("s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])
    repeated = repeated.withColumn("at", F.when(F.col("s").isNotNull(), starts))
    covered = F.array_union(
        F.array_union("at", F.transform("at", lambda i: i + 1)), F.transform("at", lambda i: i + 2)
    )
    return repeated.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("at").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
        "n_distinct_words",
        F.size("lines").cast("long").alias("n_lines"),
        "n_upper",
        "n_marks",
    )


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def features() -> dict[str, Column]:
    """What the learned conditions look at, each a share or a mean."""
    return {
        "symbol_share": _share("n_symbols", "word_chars"),
        "upper_share": _share("n_upper", "word_chars"),
        "mark_share": _share("n_marks", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "distinct_share": _share("n_distinct_words", "n_words"),
        "mean_word": _share("word_chars", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold`` or ``feature < threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self, columns: dict[str, Column]) -> Column:
        x = columns[self.feature]
        return x >= F.lit(self.threshold) if self.above else x < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules, each a conjunction; a row is bad by the first that holds."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def column(self, columns: dict[str, Column]) -> Column:
        """The number of the first rule that holds, from 1; 0 where none does."""
        out = F
        for k, rule in enumerate(self.rules, 1):
            out = out.when(_all(c.column(columns) for c in rule), F.lit(k))
        return out.otherwise(F.lit(0)) if self.rules else F.lit(0)

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) for r in self.rules)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def learn_rules(
    labelled: DataFrame,
    columns: dict[str, Column],
    bad: Column,
    split_by: Column,
    thresholds: int = 40,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.95,
    min_covered: int = 3,
) -> DecisionList:
    """Learn a decision list that tells bad rows from good ones.

    All rows of ``labelled`` count; rows where ``bad`` is null are left out. A third
    of the rows, picked by a hash of ``split_by``, prunes. A rule stays
    if at least ``min_precision`` of what it covers in either part is bad and it
    covers ``min_covered`` bad rows; the first that fails ends the list. ``max_rules`` and
    ``max_conditions`` bound what a reader has to understand, and with it the number of passes; they
    bound no rows. ``thresholds`` quantiles of each feature and class are the cut points. Without
    labels, or without bad rows, the list is empty.
    """
    names = list(columns)
    points = [i / thresholds for i in range(1, thresholds)]
    rows = labelled.select(
        bad.cast("int").alias("bad"),
        (F.pmod(F.xxhash64(split_by), F.lit(3)) == 0).alias("prunes"),
        *[columns[n].cast("double").alias(n) for n in names],
    ).where("bad is not null")
    # bad rows are few: cut points come from each class alike
    cuts_of = rows.groupBy("bad").agg(*[F.percentile_approx(n, points, 1000).alias(n) for n in names]).collect()
    if {r["bad"] for r in cuts_of} != {0, 1}:
        return DecisionList()
    cuts = {n: sorted({x for r in cuts_of for x in r[n]}) for n in names}

    def bin_of(name: str) -> Column:
        return F.size(F.filter(F.lit(cuts[name]), lambda cut: cut <= F.col(name)))

    bins = F.array(*[F.struct(F.lit(k).alias("f"), bin_of(n).alias("b")) for k, n in enumerate(names)])
    rows = materialize(rows.withColumn("bins", bins), "rule-rows")
    own = {n: F.col(n) for n in names}
    found = DecisionList()

    def left() -> DataFrame:
        return rows.where(found.column(own) == 0)

    while len(found.rules) < max_rules:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            part = left().where(~F.col("prunes") & _all(c.column(own) for c in rule))
            counts = (
                part.select("bad", F.explode("bins").alias("x")).groupBy("x.f", "x.b").agg(
                    F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")
                )
            ).collect()
            hist = {(r["f"], r["b"]): (r["p"], r["n"]) for r in counts}
            p0 = sum(v[0] for (f, _), v in hist.items() if f == 0)
            n0 = sum(v[1] for (f, _), v in hist.items() if f == 0)
            if not p0 or not n0:
                break
            best: tuple[float, Condition] | None = None
            for f, name in enumerate(names):
                p = n = 0
                for b, cut in enumerate(cuts[name]):
                    p, n = p + hist.get((f, b), (0, 0))[0], n + hist.get((f, b), (0, 0))[1]
                    for above, a, c in ((False, p, n), (True, p0 - p, n0 - n)):
                        g = _gain(a, c, p0, n0)
                        if g > 1e-9 and (best is None or g > best[0]):
                            best = (g, Condition(name, above, cut))
            if best is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # drop conditions from the end as long as the rows held back are told apart no worse
        sums = []
        for k in range(1, len(rule) + 1):
            holds = _all(c.column(own) for c in rule[:k])
            for part_name, prunes in (("g", False), ("h", True)):
                hit = holds & (F.col("prunes") == F.lit(prunes))
                sums.append(F.sum(F.when(hit, F.col("bad")).otherwise(0)).alias(f"{part_name}p{k}"))
                sums.append(F.sum(F.when(hit, 1 - F.col("bad")).otherwise(0)).alias(f"{part_name}n{k}"))
        got = left().agg(*sums).first().asDict()
        worth = lambda k: (got[f"hp{k}"] - got[f"hn{k}"]) / max(1, got[f"hp{k}"] + got[f"hn{k}"])
        size = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        sure = lambda part: got[f"{part}p{size}"] >= min_precision * (got[f"{part}p{size}"] + got[f"{part}n{size}"])
        if got[f"gp{size}"] + got[f"hp{size}"] < min_covered or not (sure("g") and sure("h")):
            break
        found.rules.append(tuple(rule[:size]))
    return found


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds base_failed, rule (the first learned rule that holds, 0 for none) and kept.

    base_failed: under 50 words, or more than half of the words repeat.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = stats.withColumn("base_failed", failed).withColumn("rule", rules.column(features()))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    **options,
) -> DataFrame:
    """One row per row of ``docs``: its ``text_stats`` with the verdict of ``judge``
    under rules learned from ``labels`` (``id_col``, ``quality_col``: 1 good, 0 bad,
    null unknown). Labels of unknown or null ids do nothing; several labels of a
    row all count. Empty tables are fine: no rows, or no learned rules."""
    stats = materialize(text_stats(docs, id_col, text_col), "text-stats")
    marks = labels.select(F.col(id_col).alias("label_id"), F.col(quality_col).alias("label_quality"))
    seen = stats.join(marks, F.col(id_col) == F.col("label_id"))
    rules = learn_rules(seen, features(), F.col("label_quality") == 0, F.col("label_id"), **options)
    return judge(stats, rules)
