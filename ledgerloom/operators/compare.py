"""Differences between runs: outputs by path, top lists of leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def output_delta(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``path``, ``change`` (changed, missing, added, same), ``expected``, ``actual`` of two tables of ``path``, ``hash``."""
    both = expected.select("path", F.col("hash").alias("expected")).join(actual.select("path", F.col("hash").alias("actual")), "path", "full")
    change = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "added").when(F.col("expected") != F.col("actual"), "changed").otherwise("same")
    return both.select("path", change.alias("change"), "expected", "actual")


def first_of_each(df: DataFrame, side: str, order: str, n: int) -> DataFrame:
    """The first n rows of each side, numbered, with how many there are; sides may be of any size: only counts and n rows a task are moved."""
    counts = df.groupBy(side).agg(F.count("*").alias("total"))
    top = None
    for value in ("missing", "added"):
        part = df.where(F.col(side) == value).orderBy(order).limit(n)
        top = part if top is None else top.unionByName(part)
    return top.join(counts, side).withColumn("rank", F.row_number().over(Window.partitionBy(side).orderBy(order)))


def list_delta(expected: Column, actual: Column) -> Column:
    """What only one of two lists has: ``missing``, ``added``."""
    return F.struct(F.array_except(expected, actual).alias("missing"), F.array_except(actual, expected).alias("added"))
