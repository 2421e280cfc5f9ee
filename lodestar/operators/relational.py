"""DataFrame forms of the operators that compose with the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """EXCEPT ALL: each row as often as it is more often on the left."""
    return left.exceptAll(right)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two relations are equal as multisets: by counts of rows, one shuffle a side, no rows collected."""
    cols = left.columns
    if cols != right.columns:
        return False
    both = left.select(*cols, F.lit(1).alias("__n")).unionAll(right.select(*cols, F.lit(-1).alias("__n")))
    return both.groupBy(*cols).agg(F.sum("__n").alias("__n")).where("__n <> 0").limit(1).count() == 0


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of an order; each task keeps k rows, so the whole is never sorted."""
    return df.orderBy(*order).limit(k)


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int) -> DataFrame:
    """Inner equi-join that spreads each key of `large` over `salts` tasks; `small` is copied so many times.

    For keys so hot that adaptive skew handling doesn't see them coming; AQE does the rest by itself.
    """
    left = large.withColumn("__salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"]).drop("__salt")
