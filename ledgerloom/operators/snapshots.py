"""Workspace snapshots: what changed, and which outputs are selected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import within


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (``run_id``, ``path``, ``hash``) that are new or differ in kind, hash or target; what vanished isn't reported."""
    old = before.select("run_id", "path", *(F.col(c).alias(f"_{c}") for c in ("kind", "hash", "target")), F.lit(True).alias("_there"))
    same = F.col("_there").isNotNull()
    for c in ("kind", "hash", "target"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    df = after.join(old, ["run_id", "path"], "left").where(~same & (F.col("kind") == "File"))
    return df.select("run_id", "path", "hash")


def below_roots(outputs: DataFrame, roots: list[str]) -> DataFrame:
    """Outputs in one of the folders, each as its whole parts."""
    found = F.lit(False)
    for r in roots:
        found = found | within(F.col("path"), F.lit(r))
    return outputs.where(found)


def artifacts(after: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (run_id, path) with ``hash`` and ``error``: missing, not a regular file, or not hashed."""
    found = after.select("run_id", "path", "kind", "hash")
    error = F.when(F.col("kind").isNull(), "missing").when(F.col("kind") != "File", "non-regular").when(F.col("hash").isNull(), "unhashed")
    return wanted.select("run_id", "path").distinct().join(found, ["run_id", "path"], "left").select("run_id", "path", "hash", error.alias("error"))


def select_outputs(before: DataFrame, after: DataFrame, roots: list[str] = (), wanted: DataFrame | None = None) -> DataFrame:
    """``run_id``, ``path``, ``hash``, ``mode``: explicit artifacts and changed files below explicit roots, else all changed files."""
    delta = changed(before, after)
    if not roots and wanted is None:
        return delta.withColumn("mode", F.lit("inferred"))
    chosen = below_roots(delta, list(roots)) if roots else delta.limit(0)
    if wanted is not None:
        listed = artifacts(after, wanted)
        checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("artifact "), "path", F.lit(": "), "error"))).otherwise(F.col("hash"))
        chosen = chosen.unionByName(listed.select("run_id", "path", checked.alias("hash")))
    return chosen.distinct().withColumn("mode", F.lit("explicit"))
