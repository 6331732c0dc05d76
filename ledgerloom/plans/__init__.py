"""Whole runs: trace, verify, explain, diff, stability, harness."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import shell_command
from ..operators import attest, canonical, compare, enrich, merkle, provenance, snapshots
from ..tables import materialize


#: Names that one document's policy has at most.
MOST_NAMED = 100_000


def check_drops(dropped: DataFrame, allowed: bool = False) -> int:
    """How many events were lost; unless that is allowed, any loss is an error."""
    n = dropped.agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("n")).first().n
    if n and not allowed:
        raise RuntimeError(f"{n} events were dropped or malformed")
    return n


def operations(traced: DataFrame, roots: DataFrame, outputs: DataFrame | None, watch: list[str] = ()) -> DataFrame:
    """Sliced operations for runs with outputs, all operations for the others."""
    if outputs is None:
        return canonical.canonicalize(traced, roots, watch)
    which = outputs.select("run_id").distinct()
    full = canonical.canonicalize(traced.join(which, "run_id", "left_anti"), roots, watch)
    return provenance.canonicalize_slice(traced.join(which, "run_id", "left_semi"), roots.join(which, "run_id", "left_semi"), outputs).unionByName(full)


def trace(raw: DataFrame, observations: DataFrame, roots: DataFrame, before: DataFrame, after: DataFrame, command: list[str], watch: list[str] = (), output_roots: list[str] = (), wanted: DataFrame | None = None, allow_drops: bool = False) -> tuple[DataFrame, DataFrame]:
    """Attestations and operations of recorded runs; ``roots``: run_id, pid, cwd, root, obs and, if known, status (of waiting for the root)."""
    events, dropped = enrich.traced(raw, observations, roots, watch)
    check_drops(dropped, allow_drops)
    events = enrich.with_root_exec(events, roots)
    if "status" in roots.columns:
        events = enrich.with_root_exit(events, roots)
    outputs = materialize(snapshots.select_outputs(before, after, output_roots, wanted), "outputs")
    ops = materialize(operations(events, roots, outputs, watch), "ops")
    return materialize(attest.assemble(ops, outputs, command, selection(output_roots, wanted)), "documents"), ops


def selection(output_roots: list[str] = (), wanted: DataFrame | None = None) -> dict:
    """The policy that documents record: what a user named, as the user named it."""
    explicit = bool(output_roots) or wanted is not None
    named = [] if wanted is None else [r.path for r in wanted.select("path").distinct().orderBy("path").limit(MOST_NAMED + 1).collect()]
    if len(named) > MOST_NAMED:
        raise ValueError(f"a document names at most {MOST_NAMED} artifacts; name their folder instead")
    return {"mode": "explicit" if explicit else "inferred", "output_roots": list(output_roots), "artifacts": named}


def verify_trace(expected: DataFrame, raw: DataFrame, observations: DataFrame, roots: DataFrame, before: DataFrame, after: DataFrame, command: list[str], watch: list[str] = (), output_roots: list[str] = (), wanted: DataFrame | None = None, pinned: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Trace the recorded runs anew and hold them against ``expected`` (run_id and a document): verdicts, and the new documents.

    Lost events are an error, whatever was allowed when the documents were
    made.  A document's policy is never taken from it: if that was explicit, it
    has to be given again.
    """
    actual, _ = trace(raw, observations, roots, before, after, command, watch, output_roots, wanted)
    verdicts = verify(expected, actual, pinned)
    if output_roots or wanted is not None:
        return verdicts, actual
    policy = expected.select("run_id", (F.col("output_selection.mode") == "explicit").alias("_named"))
    again = F.when(F.col("_named") & (F.col("verdict") == "output selection differs"), "the outputs were chosen; name them again").otherwise(F.col("verdict"))
    return verdicts.join(policy, "run_id").select("run_id", again.alias("verdict")), actual


def verify(expected: DataFrame, actual: DataFrame, pinned: str | None = None) -> DataFrame:
    """One row per document of ``expected`` (joined with ``actual`` by run_id): ``verdict``, null if they agree.

    In order: the document itself, a pinned root, the command, the policy of outputs, the root.
    """
    e = attest.validated(expected).select("run_id", "error", *(F.col(c).alias(f"e_{c}") for c in ("root_hash", "command", "output_selection")))
    both = e.join(actual.select("run_id", "root_hash", "command", "output_selection"), "run_id", "left")
    checks = [
        (F.col("error").isNotNull(), F.col("error")),
        (F.lit(pinned is not None) & (F.col("e_root_hash") != F.lit(pinned or "")), F.lit("root differs from the pinned one")),
        (F.col("root_hash").isNull(), F.lit("nothing to compare with")),
        (F.col("e_command") != F.col("command"), F.lit("command differs")),
        (F.col("e_output_selection") != F.col("output_selection"), F.lit("output selection differs")),
        (F.col("e_root_hash") != F.col("root_hash"), F.lit("root differs")),
    ]
    verdict = F.lit(None).cast("string")
    for condition, said in reversed(checks):
        verdict = F.when(condition, said).otherwise(verdict)
    return both.select("run_id", verdict.alias("verdict"))


def explain(docs: DataFrame) -> DataFrame:
    """Documents in short: version, roots, command as typed, counts."""
    return attest.validated(docs).select("version", "root_hash", "process_root", shell_command(F.col("command")).alias("command"), F.col("output_selection.mode").alias("mode"), F.size("outputs").alias("outputs"), F.col("tree.leaf_count").alias("operations"), "error", "warning")


def diff(expected: DataFrame, actual: DataFrame, n: int = 12) -> dict[str, DataFrame]:
    """What differs between two documents: summary, outputs (no more than 20 are shown), leaves (n a side)."""
    leaves = [d.select(F.explode("tree.leaves").alias("leaf")) for d in (expected, actual)]
    outputs = [d.select(F.explode("outputs").alias("o")).select("o.*") for d in (expected, actual)]
    delta = merkle.leaf_diff(*leaves)
    changes = compare.output_delta(*outputs).where("change <> 'same'")
    said = lambda d, name: d.select(F.struct("root_hash", "command", "output_selection", F.col("tree.leaf_count").alias("operations")).alias(name))
    # One document each; a second row is an error.
    summary = said(expected, "e").withColumn("a", said(actual, "a").scalar()).select(*((F.col(f"e.{c}") == F.col(f"a.{c}")).alias(f"same_{c}") for c in ("root_hash", "command", "output_selection", "operations")), compare.list_delta(F.col("e.command"), F.col("a.command")).alias("command_delta"))
    return {"summary": summary, "outputs": changes.orderBy("path").limit(20), "output_counts": changes.groupBy("change").count(), "leaves": compare.first_of_each(delta, "side", "leaf", n)}


def stability(docs: DataFrame, baseline: str) -> tuple[DataFrame, DataFrame]:
    """Per document and over all: agreement with the one whose ``source`` is ``baseline``; at least two are needed."""
    if docs.limit(2).count() < 2:
        raise ValueError("at least 2 runs are needed")
    base = docs.where(F.col("source") == baseline)
    leaves = docs.select(F.col("source").alias("run_id"), F.explode("tree.leaves").alias("leaf"))
    # Of the baseline there is one row; a second one is an error.
    first = base.select(F.struct("root_hash", "process_root").alias("r")).scalar()
    runs = docs.select(F.col("source").alias("run_id"), (F.col("root_hash") == first["root_hash"]).alias("root_match"), (F.col("process_root") == first["process_root"]).alias("process_root_match"))
    rows = merkle.stability(leaves, base.select(F.explode("tree.leaves").alias("leaf")), runs)
    return rows.withColumnRenamed("run_id", "path"), merkle.stability_summary(rows)


def is_stable(summary: DataFrame) -> bool:
    """What the strict mode asks for: every run has the baseline's root."""
    row = summary.first()
    return row.run_count == row.root_matches


def report(rows: DataFrame, summary: DataFrame, dropped: int = 0) -> str:
    """A stability report as text; ``rows`` come one partition at a time."""
    shares = [merkle.percentage(F.col(c), F.col("run_count")).alias(f"{c}_share") for c in ("root_matches", "process_root_matches")]
    s = summary.select("*", *shares).first()
    lines = [f"Runs: {s.run_count}", f"Root matches: {s.root_matches} ({s.root_matches_share})", f"Process root matches: {s.process_root_matches} ({s.process_root_matches_share})", f"Leaf similarity: least {s.minimum_leaf_jaccard:.6f}, mean {s.mean_leaf_jaccard:.6f}"]
    lines += [f"  {r.path}: {'same' if r.root_match else 'differs'}, {r.leaf_count} leaves, {r.missing_leaves} missing, {r.added_leaves} added" for r in rows.orderBy("path").toLocalIterator()]
    if s.root_matches < s.run_count:
        lines.append(f"{s.run_count - s.root_matches} of {s.run_count} runs have another root")
    if dropped:
        lines.append(f"Dropped events: {dropped}")
    return "\n".join(lines)


def report_json(rows: DataFrame, summary: DataFrame, baseline: str | None = None) -> str:
    """The same as JSON, for other programs."""
    runs = [r.asDict() for r in rows.orderBy("path").toLocalIterator()]
    return json.dumps(summary.first().asDict() | {"baseline": baseline if baseline is not None else runs[0]["path"], "runs": runs}, indent=2)


def harness(traced: DataFrame, roots: DataFrame, command: list[str], runs: int, outputs: DataFrame | None = None, watch: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """All runs of one command in one job: attestations, then their stability against the least run_id."""
    if runs < 2:
        raise ValueError("at least 2 runs are needed")
    ops = operations(traced, roots, outputs, watch)
    none = ops.select("run_id").limit(0).withColumns({"path": F.lit(""), "hash": F.lit("")})
    docs = attest.assemble(ops, none if outputs is None else outputs, command).withColumn("source", F.col("run_id").cast("string"))
    return stability(docs, str(roots.agg(F.min("run_id")).first()[0]))
