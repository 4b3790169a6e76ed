"""What several operators of this package need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize, new_dir, shared_dir

__all__ = ["SPACES", "SPACE_RUN", "bounded_sample", "fresh", "materialize", "new_dir", "shared_dir", "words"]

#: ASCII white space: space and U+0009 to U+000D. A word is a run of anything else.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_sample(df: DataFrame, id_col: str, most: int, total: int) -> DataFrame:
    """The ``most`` rows of ``total`` with about the smallest hashes of their ids.

    A hash threshold leaves a tenth more than that in the whole table, so what tasks hand
    on for the final ordering doesn't grow with the number of tasks.
    """
    key = F.xxhash64(F.col(id_col).cast("string"))
    scale = 1 << 30
    some = df if total <= most else df.where(F.pmod(key, F.lit(scale)) < int(scale * min(1.0, 1.1 * most / total)) + 1)
    return some.orderBy(key, id_col).limit(most)
