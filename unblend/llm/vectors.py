"""Tables of vectors as integers, for the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Components beyond this can't be told apart as integers in a double.
LARGEST = 2.0**52


def finite(vector: Column) -> Column:
    """True for a vector that isn't null or empty and has neither null nor non-finite components."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector.cast("array<double>"), odd), F.lit(False))


def integers(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * component) + shift for each component."""

    def whole(v: Column) -> Column:
        y = F.floor(v * F.lit(float(scale)))
        return F.when(F.abs(v) * scale < LARGEST, y + F.lit(shift)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))

    return F.transform(vector.cast("array<double>"), whole)


def integer_table(df: DataFrame, id_col: str, vec_col: str, scale: int, shift: int = 0, multiple: int = 1, more: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """(no, id, x, and ``more``), written, and the number of dimensions.

    ``no`` tells repeated rows apart. The dimensions are those of most usable vectors among the multiples of ``multiple`` (the
    larger of equally frequent ones); rows of other lengths are dropped as unusable ones are.
    """
    fit = df.where(finite(F.col(vec_col)) & (F.size(vec_col) % multiple == 0))
    rows = fit.select(
        F.monotonically_increasing_id().alias("no"), F.col(id_col).alias("id"), integers(F.col(vec_col), scale, shift).alias("x"),
        *[c.alias(n) for n, c in (more or {}).items()],
    )
    rows = materialize(rows, "integer-vectors")
    first = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    dims = first.d if first else 0
    return rows.where(F.size("x") == dims), dims


def smallest(rows: DataFrame, most: int) -> list:
    """The rows of the ``most`` smallest ids, nulls last, equal ones by their vectors."""
    return rows.orderBy(F.col("id").asc_nulls_last(), "x").select("id", "x").limit(most).collect()
