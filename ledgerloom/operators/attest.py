"""Attestations: assembled from leaves and outputs, validated by recomputing what they commit to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.hashing import commitment_v02, commitment_v03
from ..tables import materialize
from . import merkle

#: Leaves of 71 characters that one row can hold by far, and a JSON file should.
MOST_LEAVES = 5_000_000


def assemble(leaves: DataFrame, outputs: DataFrame, command: list[str], selection: dict | None = None, predicate_type: str = "process-provenance/v0.3.0") -> DataFrame:
    """One document (``run_id`` and the columns of ATTESTATION) per run of ``leaves``; ``outputs``: run_id, path, hash.

    A document holds all leaves of its run, so a run of more than MOST_LEAVES
    has none; its root can still be computed and compared without one.
    """
    roots = materialize(merkle.roots(leaves), "roots")
    if found := roots.where(F.col("leaf_count") > MOST_LEAVES).first():
        raise ValueError(f"run {found.run_id} has {found.leaf_count} operations, more than a document can hold")
    selection = {"mode": "inferred", "artifacts": [], "output_roots": []} | (selection or {})
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    docs = leaves.select("run_id", "leaf").distinct().groupBy("run_id").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    outs = outputs.select("run_id", "path", "hash").distinct().groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("path", "hash"))).alias("outputs"))
    # The lists of a large run are made in tasks of their own.
    docs, outs = materialize(docs, "lists"), materialize(outs, "lists")
    docs = docs.join(roots, "run_id").join(outs, "run_id", "left")
    docs = docs.withColumns({
        "outputs": F.coalesce("outputs", F.array().cast(f"array<{schema.OUTPUT}>")),
        "command": strings(command),
        "output_selection": F.struct(F.lit(selection["mode"]).alias("mode"), strings(sorted(selection["artifacts"])).alias("artifacts"), strings(sorted(selection["output_roots"])).alias("output_roots")),
        "process_root": F.col("root"),
    })
    s = F.col("output_selection")
    docs = docs.withColumn("root_hash", commitment_v03(F.col("root"), F.col("command"), s["mode"], s["artifacts"], s["output_roots"], F.col("outputs")))
    tree = F.struct("leaves", F.array().cast("array<struct<hash:string,is_leaf:boolean>>").alias("nodes"), "leaf_count")
    return docs.select("run_id", F.lit(schema.VERSION).alias("version"), F.lit(predicate_type).alias("predicate_type"), "root_hash", "process_root", "command", "output_selection", "outputs", tree.alias("tree"))


def validated(docs: DataFrame) -> DataFrame:
    """Documents with absent fields filled in, ``computed_root`` from the leaves, ``error`` (null if valid) and ``warning``.

    Old documents have all nodes instead of leaves; there the leaves are found
    among the nodes and the root is computed from them as well.
    """
    strings = F.array().cast("array<string>")
    nodes = F.coalesce("tree.nodes", F.array().cast("array<struct<hash:string,is_leaf:boolean>>"))
    stored = F.coalesce("tree.leaves", strings)
    from_nodes = (F.size(stored) == 0) & (F.size(nodes) > 0)
    leaves = F.when(from_nodes, merkle.legacy_leaves(nodes, F.coalesce("tree.leaf_count", F.lit(0).cast("long")))).otherwise(stored)
    selection = F.struct(F.coalesce("output_selection.mode", F.lit("inferred")).alias("mode"), F.coalesce("output_selection.artifacts", strings).alias("artifacts"), F.coalesce("output_selection.output_roots", strings).alias("output_roots"))
    df = docs.withColumns({"_leaves": F.array_sort(leaves), "_nodes": nodes, "output_selection": selection, "outputs": F.coalesce("outputs", F.array().cast(f"array<{schema.OUTPUT}>"))})
    df = df.withColumn("computed_root", merkle.root_of(F.col("_leaves")))
    said = F.coalesce("process_root", F.lit(""))
    df = df.withColumn("process_root", F.when((said == "") | (F.col("version") == "0.1.0"), F.col("computed_root")).otherwise(said))
    s = F.col("output_selection")
    parts = (F.col("process_root"), F.col("command"), s["mode"], s["artifacts"], s["output_roots"], F.col("outputs"))
    versions: list[tuple[Column, Column]] = [(F.col("version").isin("0.2.0", "0.2.1"), commitment_v02(*parts)), (F.col("version") == "0.3.0", commitment_v03(*parts))]
    error = F.when(F.col("version") == "0.1.0", F.when(F.col("root_hash") != F.col("computed_root"), F.lit("root does not match the tree")))
    for which, computed in versions:
        wrong = F.when(F.col("process_root") != F.col("computed_root"), F.lit("process root does not match the leaves")).when(F.col("root_hash") != computed, F.lit("root does not match the commitment"))
        error = error.when(which, wrong)
    error = error.otherwise(F.concat(F.lit("unsupported version: "), F.coalesce("version", F.lit("none"))))
    warning = F.when(F.col("tree.leaf_count") != F.size("_leaves"), F.lit("leaf count does not match the leaves"))
    return df.withColumns({"error": error, "warning": warning}).drop("_leaves", "_nodes")
