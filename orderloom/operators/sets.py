"""Comparisons of sets and multisets of rows, per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_difference(left: DataFrame, right: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """(by, only_left, only_right, shared): how many rows one side has more than the other, counted per key.

    Both sides are unioned with a sign and counted in one aggregation, null keys included: no join. Two multisets
    are equal where both differences are 0.
    """
    a = left.select(by, *keys, F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(by, *keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    n = a.unionByName(b).groupBy(by, *keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    zero = F.lit(0).cast("long")
    return n.groupBy(by).agg(
        F.sum(F.greatest(F.col("l") - F.col("r"), zero)).alias("only_left"), F.sum(F.greatest(F.col("r") - F.col("l"), zero)).alias("only_right"), F.sum(F.least("l", "r")).alias("shared")
    )


def overlap(left: DataFrame, right: DataFrame, by: str, key: str) -> DataFrame:
    """(by, shared, only_left, only_right): distinct keys of both sides."""
    a = left.select(by, key, F.lit(True).alias("l"), F.lit(False).alias("r"))
    b = right.select(by, key, F.lit(False).alias("l"), F.lit(True).alias("r"))
    n = a.unionByName(b).groupBy(by, key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return n.groupBy(by).agg(
        F.count_if(F.col("l") & F.col("r")).alias("shared"), F.count_if(F.col("l") & ~F.col("r")).alias("only_left"), F.count_if(F.col("r") & ~F.col("l")).alias("only_right")
    )


def stage_findings(given: DataFrame, out: DataFrame, by: str, family: list[str], required: list[str]) -> DataFrame:
    """(by, missing, added, incomplete): families of the input without output, families only in the output, and
    output rows that lack a required field."""
    a = given.select(by, *family, F.lit(1).alias("g"), F.lit(0).alias("o"), F.lit(0).alias("bad"))
    lacks = F.lit(False)
    for f in required:
        lacks = lacks | F.col(f).isNull()
    b = out.select(by, *family, F.lit(0).alias("g"), F.lit(1).alias("o"), lacks.cast("int").alias("bad"))
    n = a.unionByName(b).groupBy(by, *family).agg(F.max("g").alias("g"), F.max("o").alias("o"), F.sum("bad").alias("bad"))
    return n.groupBy(by).agg(
        F.count_if((F.col("g") == 1) & (F.col("o") == 0)).alias("missing"), F.count_if((F.col("g") == 0) & (F.col("o") == 1)).alias("added"), F.sum("bad").alias("incomplete")
    )
