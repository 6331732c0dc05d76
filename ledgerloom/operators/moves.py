"""Renames met by time: the next one that concerns a path, found without comparing a path with all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, rewrite_prefix
from ..tables import materialize

#: Times of one rename that stand in a row together.
CHUNK = 256


def listed(renames: DataFrame) -> DataFrame:
    """Chunks of the times at which a path became another: ``run_id``, ``_a``, ``_to``, ``_after`` (the last time of the chunk before), ``_last``, ``_times``.

    ``renames``: run_id, seq, from_path, to_path.  A chunk holds at most CHUNK times, however often a folder is renamed.
    """
    key = ["run_id", F.col("from_path").alias("_a"), F.col("to_path").alias("_to")]
    rows = renames.select(*key, "seq").distinct()
    by_time = Window.partitionBy("run_id", "_a", "_to").orderBy("seq")
    rows = rows.withColumn("_c", F.floor((F.row_number().over(by_time) - 1) / CHUNK))
    chunks = rows.groupBy("run_id", "_a", "_to", "_c").agg(F.sort_array(F.collect_list("seq")).alias("_times"))
    chunks = chunks.withColumn("_last", F.array_max("_times"))
    before = F.lag("_last").over(Window.partitionBy("run_id", "_a", "_to").orderBy("_c"))
    return materialize(chunks.withColumn("_after", before).drop("_c"), "renames")


def next_renames(rows: DataFrame, chunks: DataFrame, path: str, avail: str) -> DataFrame:
    """Each row once for every rename of its path or a folder above it that comes after ``avail``: with ``_a``, ``_to`` and ``_s``, the first time.

    The prefix condition is an equality with the path's ancestors, and of the chunks of a rename only that which holds the first time meets the row.
    """
    met = rows.withColumn("_a", F.explode(ancestors(F.col(path)))).join(chunks, ["run_id", "_a"])
    here = (F.col("_last") > F.col(avail)) & (F.col("_after").isNull() | (F.col("_after") <= F.col(avail)))
    met = met.where(here).withColumn("_s", F.array_min(F.filter("_times", lambda t: t > F.col(avail))))
    return met.drop("_times", "_last", "_after")


def renamed(path: str) -> Column:
    return rewrite_prefix(F.col(path), F.col("_a"), F.col("_to"))


def followed(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """``run_id``, ``seq``, ``path``: what a path is called at ``seq``, of rows of ``run_id``, ``seq``, ``path``, ``since``.

    Renames after ``since`` and before ``seq`` apply in order; both halves of
    an exchange have one time.  Each round takes the next rename of every path
    that has one, so rounds follow the longest chain of renames of one path.
    """
    chunks = listed(renames)
    front, done = materialize(rows.select("run_id", "seq", "path", "since"), "paths"), []
    while True:
        met = next_renames(front, chunks, "path", "since").where(F.col("_s") < F.col("seq"))
        first = met.groupBy("run_id", "seq").agg(F.min(F.struct("_s", "_a", "_to")).alias("_r"))
        step = front.join(first, ["run_id", "seq"], "left")
        now = rewrite_prefix(F.col("path"), F.col("_r._a"), F.col("_r._to"))
        step = materialize(step.select("run_id", "seq", F.coalesce(now, "path").alias("path"), F.coalesce("_r._s", "since").alias("since"), F.col("_r").isNotNull().alias("moved")), "paths")
        done.append(step.where("NOT moved"))
        front = step.where("moved").drop("moved")
        if front.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("run_id", "seq", "path")
