"""Merkle roots of leaf sets, distributed; set differences and similarity of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_pair, pair
from ..tables import materialize

BLOCK_BITS = 12
#: Characters of a leaf that deal it to a range: the prefix and four digits.
_RANGE = 11
PADDING = pair("padding", "padding")
EMPTY = pair("empty", "empty")


def fold(leaves: Column, levels: Column) -> Column:
    """Pairwise hashes, ``levels`` times, of an array whose length is a power of two."""
    step = lambda row, _: F.transform(F.sequence(F.lit(0), (F.size(row) / 2 - 1).cast("int")), lambda i: hash_pair(row[2 * i], row[2 * i + 1]))
    folded = F.aggregate(F.when(levels > 0, F.sequence(F.lit(1), F.greatest(levels, F.lit(1)))).otherwise(F.array().cast("array<int>")), leaves, step)
    return folded[0]


def _levels(n: Column) -> Column:
    """The number of levels above n leaves."""
    return F.when(n > 1, F.ceil(F.log2(n.cast("double")))).otherwise(0).cast("int")


def _padded(leaves: Column, n: Column, filler: str) -> Column:
    return F.concat(leaves, F.array_repeat(F.lit(filler), (n - F.size(leaves)).cast("int")))


def root_of(leaves: Column) -> Column:
    """The root of one sorted array of leaves; of a single leaf that leaf, of none a fixed hash."""
    n = F.size(leaves)
    levels = _levels(n)
    whole = F.pow(F.lit(2.0), levels.cast("double")).cast("int")
    return F.when(n == 0, F.lit(EMPTY)).when(n == 1, F.get(leaves, F.lit(0))).otherwise(fold(_padded(leaves, whole, PADDING), levels))


def positions(leaves: DataFrame) -> DataFrame:
    """``run_id``, ``leaf``, ``pos``: the place of each distinct leaf among its run's, without a window over a whole run.

    Leaves are dealt by a prefix that keeps their order; each range is numbered by itself and moved by what lies before it.
    """
    d = materialize(leaves.select("run_id", "leaf").distinct().withColumn("_r", F.substring("leaf", 1, _RANGE)), "leaves")
    counts = d.groupBy("run_id", "_r").agg(F.count("*").alias("n"))
    before = Window.partitionBy("run_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("run_id", "_r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("run_id", "_r").orderBy("leaf")
    d = d.withColumn("_n", F.row_number().over(within) - 1).join(counts, ["run_id", "_r"])
    return d.select("run_id", "leaf", (F.col("_before") + F.col("_n")).alias("pos"))


def roots(leaves: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``run_id``, ``root``, ``leaf_count`` from rows of ``run_id``, ``leaf``.

    Blocks of 2**bits leaves are folded by themselves, then the blocks' roots;
    what pads the upper levels is the root of a block of padding.
    """
    placed = positions(leaves).withColumn("_b", F.floor(F.col("pos") / (1 << bits)))
    blocks = materialize(placed.groupBy("run_id", "_b").agg(F.sort_array(F.collect_list("leaf")).alias("leaves")), "blocks")
    sizes = blocks.groupBy("run_id").agg(F.sum(F.size("leaves")).cast("long").alias("leaf_count"))
    blocks = blocks.join(sizes, "run_id")
    several = F.col("leaf_count") > (1 << bits)
    top = F.when(several, F.lit(fold_levels := bits)).otherwise(_levels(F.col("leaf_count")))
    whole = F.pow(F.lit(2.0), top.cast("double")).cast("int")
    blocks = blocks.withColumns({"_levels": top, "_whole": whole}).withColumn("_padded", _padded(F.col("leaves"), F.col("_whole"), PADDING))
    blocks = blocks.withColumn("node", fold(F.col("_padded"), F.col("_levels")))
    filler = PADDING
    for _ in range(fold_levels):
        filler = pair(filler, filler)
    upper = blocks.groupBy("run_id", "leaf_count").agg(F.sort_array(F.collect_list(F.struct("_b", "node"))).alias("nodes"))
    upper = upper.withColumn("nodes", F.transform("nodes", lambda x: x["node"])).withColumn("_levels", _levels(F.size("nodes")))
    upper = upper.withColumn("nodes", _padded(F.col("nodes"), F.pow(F.lit(2.0), F.col("_levels").cast("double")).cast("int"), filler))
    return upper.select("run_id", fold(F.col("nodes"), F.col("_levels")).alias("root"), "leaf_count")


def legacy_leaves(nodes: Column, leaf_count: Column) -> Column:
    """The leaves in an array of all nodes, root first, of an old document."""
    padded = F.ceil(F.size(nodes) / 2)
    return F.slice(F.transform(nodes, lambda x: x["hash"]), padded.cast("int"), leaf_count.cast("int"))


def leaf_diff(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``side`` (missing or added) and ``leaf`` of the leaves that only one of two sets has."""
    on = [*keys, "leaf"]
    both = expected.select(*on).distinct().withColumn("e", F.lit(1)).join(actual.select(*on).distinct().withColumn("a", F.lit(1)), on, "full")
    return both.where(F.col("e").isNull() | F.col("a").isNull()).select(F.when(F.col("a").isNull(), "missing").otherwise("added").alias("side"), *on)


def op_delta(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``side``, ``leaf``, ``n``: the difference of two multisets of operations, by counts summed before they are moved."""
    signed = expected.select("leaf", F.lit(1).alias("e")).unionByName(actual.select("leaf", F.lit(-1).alias("e")))
    n = signed.groupBy("leaf").agg(F.sum("e").alias("n")).where(F.col("n") != 0)
    return n.select(F.when(F.col("n") > 0, "missing").otherwise("added").alias("side"), "leaf", F.abs("n").cast("long").alias("n"))


def stability(leaves: DataFrame, baseline: DataFrame, run_roots: DataFrame | None = None) -> DataFrame:
    """Per run: ``leaf_count``, ``leaf_jaccard``, ``missing_leaves``, ``added_leaves`` against the baseline's leaves; the baseline's run is one of them.

    ``leaves`` has ``run_id``, ``leaf``; ``baseline`` has ``leaf``; runs without leaves are taken from ``run_roots``.
    """
    base = baseline.select("leaf").distinct().withColumn("_b", F.lit(1))
    counts = leaves.select("run_id", "leaf").distinct().join(base, "leaf", "left").groupBy("run_id").agg(F.count("*").alias("leaf_count"), F.count("_b").alias("_common"))
    if run_roots is not None:
        counts = run_roots.join(counts, "run_id", "left")
    counts = counts.withColumn("_total", base.agg(F.count("*").alias("_total")).scalar()).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("leaf_count", "_common")})
    union = F.col("leaf_count") + F.col("_total") - F.col("_common")
    return counts.withColumns({
        "leaf_jaccard": F.when(union == 0, F.lit(1.0)).otherwise(F.col("_common").cast("double") / union),
        "missing_leaves": F.col("_total") - F.col("_common"),
        "added_leaves": F.col("leaf_count") - F.col("_common"),
    }).drop("_total", "_common")


def stability_summary(runs: DataFrame) -> DataFrame:
    """One row over all runs, the baseline included: counts, least and mean similarity."""
    return runs.agg(
        F.count("*").alias("run_count"), F.count_if("root_match").alias("root_matches"), F.count_if("process_root_match").alias("process_root_matches"),
        F.min("leaf_jaccard").alias("minimum_leaf_jaccard"), F.avg("leaf_jaccard").alias("mean_leaf_jaccard"),
    )


def percentage(part: Column, whole: Column) -> Column:
    """A share as reports have it."""
    return F.format_string("%.1f%%", F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole))
