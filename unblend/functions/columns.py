"""Small column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_positive(total: Column) -> Column:
    """Finite and above zero."""
    return total.isNotNull() & ~F.isnan(total) & (total > 0) & (total < F.lit(float("inf")))


def positive_or_fail(total: Column, what: str) -> Column:
    """The total where it is finite and above zero; any other stops the job."""
    return F.when(is_positive(total), total).otherwise(F.raise_error(F.lit(f"{what}: a column sum isn't finite and positive")).cast("double"))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation; null (never NaN) for under two rows or no spread."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count(F.lit(1)) > 1) & (sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy))


def number_or_zero(value: Column) -> Column:
    """A number from anything; what is missing or isn't a number counts as 0."""
    x = value.cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)


def mid_rank(value: str, keys: list[str]) -> Column:
    """Rank from 1 within the keys, ties at the mean of their ranks."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    same = Window.partitionBy(*keys, value)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results of different summing orders compare equal."""
    return df.select(
        *[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )
