"""Missing values and contracts: NULL is the one form of missing, and violated contracts raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def finite(c: Column | str) -> Column:
    """Whether the value is there and finite. It is named once, so long expressions don't grow."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("double") * 0.0 == 0.0, F.lit(False))


def fin(c: Column | str) -> Column:
    """The value if it is finite, else NULL."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(c * 0.0 == 0.0, c)


def normalise(df: DataFrame) -> DataFrame:
    """Every floating column with NaN and infinities as NULL."""
    return df.select(*(fin(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def require_none(violations: DataFrame, message: str) -> None:
    """Raise with the message and one example if the table of violations has a row."""
    row = violations.limit(1).collect()
    if row:
        raise ContractError(f"{message}: {row[0].asDict()}")


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    require_none(df.groupBy(*keys).count().filter("count > 1"), f"{what} has repeated keys")


def require_same_keys(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> None:
    """Both tables have the same set of keys; the message carries how many each side misses."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    sides = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), keys, "full_outer")
    n = sides.agg(F.count_if(F.col("r").isNull()).alias("l"), F.count_if(F.col("l").isNull()).alias("r")).first()
    if n.l or n.r:
        raise ContractError(f"{what}: keys differ, {n.l} only on the left and {n.r} only on the right")
