"""Canonicalization: traced events become operations that don't depend on the system they ran on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.hashing import op_hash
from ..functions.paths import can_read, can_write, identity, is_system_state, maps_writes, watched
from ..tables import materialize
from . import descriptors
from .process import SLOT, numbered, with_tools

_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def flags_text(flags: Column) -> Column:
    return F.concat(F.lit("flags:0x"), F.lower(F.hex(flags)))


def without_unwatched(events: DataFrame, prefixes: list[str]) -> DataFrame:
    """Drop opens and mappings by external processes outside the watched paths."""
    outside = F.col("external") & F.col("kind").isin("FileOpen", "FileMmap") & ~watched(F.col("path"), prefixes)
    return events.where(~F.coalesce(outside, F.lit(False)))


def with_fallback(events: DataFrame, prefixes: list[str]) -> DataFrame:
    """Add ``outside``: whether an event counts as external, by origin or because its process turned out to be.

    A process other than the root that touches a watched path before it runs
    a known tool is external, and stays so for its lifetime from then on.
    Needs ``tool`` and ``is_root``.
    """
    touched = watched(F.col("path"), prefixes) | watched(F.col("from_path"), prefixes) | watched(F.col("to_path"), prefixes)
    whole = (F.col("kind") != "FileMmap") | (F.col("path").isNotNull() & F.col("obs").isNotNull())
    acts = F.col("kind").isin("FileOpen", "FileMmap", "FileRename", "FileUnlink") & whole
    candidate = ~F.col("external") & ~F.col("is_root") & touched
    trigger = acts & (F.col("external") | (candidate & F.col("tool").isNull()))
    lifetime = Window.partitionBy("run_id", "process.pid", "process.generation")
    df = events.withColumn("_from", F.min(F.when(trigger, F.col("seq"))).over(lifetime))
    marked = F.coalesce(F.col("seq") > F.col("_from"), F.lit(False))
    fallback = candidate & F.when(F.col("kind") == "FileClose", marked).otherwise(acts & (F.col("tool").isNull() | marked))
    return df.withColumn("outside", F.col("external") | fallback).drop("_from")


def _with_root(events: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return events.withColumns({"root": F.lit(None).cast(schema.PROCESS), "is_root": F.lit(False)})
    df = events.join(roots.select("run_id", "root"), "run_id", "left")
    return df.withColumn("is_root", F.coalesce((F.col("process.pid") == F.col("root.pid")) & (F.col("process.generation") == F.col("root.generation")), F.lit(False)))


def operations(traced: DataFrame, roots: DataFrame | None = None, watch: list[str] = ()) -> DataFrame:
    """Every operation, before equal ones are put together: ``run_id``, ``seq``, ``rank``, and the columns of CANONICAL_OP.

    ``traced`` has the columns of TRACED_EVENT, ``roots`` the root instance
    (``root``) of each run.  Without roots no process is the root.
    """
    watch = list(watch)
    # Only what happens to files can be external.
    external = F.coalesce("external", F.lit(False)) & ~F.col("kind").isin("Exec", "Fork", "Exit")
    events = with_tools(without_unwatched(traced.withColumn("external", external), watch))
    # Written once: marks, numbers and operations are all made from it.
    events = materialize(with_fallback(_with_root(events, roots), watch), "events")
    kind, ident, outside = F.col("kind"), identity(F.col("obs")), F.col("outside")
    flags, prot = F.coalesce("flags", F.lit(0).cast("long")), F.coalesce("prot", F.lit(0).cast("long"))
    system = is_system_state(F.col("path")) & ~outside
    mapped = (kind == "FileMmap") & F.col("path").isNotNull() & F.col("obs").isNotNull()
    writes_open, writes_map = (kind == "FileOpen") & can_write(flags) & ~system, mapped & maps_writes(prot, flags) & ~system

    # Pending writes by descriptor; outside events have a space of their own.
    closes = (kind == "FileClose") & F.col("path").isNotNull()
    marks = events.where(writes_open | writes_map | closes).select(
        "run_id", F.when(outside, "outside").otherwise("tree").alias("space"), "process.pid", "process.generation", "fd", "seq", F.lit(0).alias("rank"),
        F.when(closes, "close").when(writes_open, "open").otherwise("map").alias("action"), F.when(~closes, F.col("seq")).alias("op"),
        F.when(closes, ident).alias("closed"),
    )
    forks = events.where((kind == "Fork") & F.col("child").isNotNull()).select("run_id", "seq", "process.pid", "process.generation", F.col("child.pid").alias("child_pid"), F.col("child.generation").alias("child_generation"))
    matched = descriptors.match(marks, forks)
    ended = matched.where((F.col("action") == "close") & F.col("pending").isNotNull() & F.col("closed").isNotNull())
    ended = ended.groupBy("run_id", F.col("pending").alias("seq")).agg(F.max_by("closed", "seq").alias("written"))
    opened = matched.where(F.col("action").isin("open", "map") & (F.col("governs") == F.col("op"))).select("run_id", "seq").distinct().withColumn("opens", F.lit(True))
    events = events.join(opened, ["run_id", "seq"], "left").join(ended, ["run_id", "seq"], "left")

    named = lambda inside, out: F.when(outside, F.lit(out)).otherwise(F.lit(inside))
    tool = F.when(~outside, F.col("tool"))

    def op(rank: int, kind_: Column, args: Column, inputs: Column, outputs: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), kind_.alias("op_type"), tool.alias("tool_hash"), args.cast(_STRINGS).alias("args"), inputs.cast(_STRINGS).alias("input_hashes"), outputs.cast(_STRINGS).alias("output_hashes"))

    one, written = F.array(ident), F.array_compact(F.array("written"))
    reads = op(0, named("FileRead", "ExternalFileRead"), F.when(mapped, F.array(F.lit("mmap"))).otherwise(_none()), one, _none())
    write = F.when(F.col("opens"), op(1, named("FileWrite", "ExternalFileWrite"), _none(), _none(), written))
    state = op(0, F.lit("SystemStateRead"), _none(), F.array(F.lit(schema.SYSTEM_STATE)), _none())
    moved = op(0, named("FileRename", "ExternalFileRename"), F.array(flags_text(flags)), one, one)
    gone = op(0, named("FileDelete", "ExternalFileDelete"), F.array(flags_text(flags)), one, _none())
    ran = op(0, F.lit("Exec"), _none(), _none(), _none())
    code = F.concat(F.lit("exit:"), F.coalesce("exit_code", F.lit(0)).cast("string"))
    left = op(0, F.lit("Exit"), F.when(F.col("is_root"), F.array(code)).otherwise(_none()), _none(), _none())
    made = F.array_compact(
        F.when(kind == "Exec", F.array(ran))
        .when(((kind == "FileOpen") | mapped) & system, F.array(state))
        .when(kind == "FileOpen", F.array(F.when(can_read(flags), reads), write))
        .when(mapped, F.array(reads, write))
        .when(kind == "FileRename", F.array(moved))
        .when(kind == "FileUnlink", F.array(gone))
        .when(kind == "Exit", F.array(left))
    )
    # Logical numbers of process instances: the root 0, others as they first appear.
    appears = ~outside & (kind.isin("Exec", "FileOpen", "FileRename", "FileUnlink") | mapped)
    seen = events.where(appears).groupBy("run_id", "process").agg(F.min("seq").alias("_first"))
    roots_of = _with_root(seen.withColumn("external", F.lit(False)), roots)
    seen = roots_of.withColumn("_own_root", F.coalesce(F.col("process") == F.col("root"), F.lit(False)))
    others = numbered(seen.where("NOT _own_root"), ["run_id"], F.floor(F.col("_first") / SLOT), ["_first"], "_index")
    others = others.withColumn("_index", F.col("_index") - (1 if roots is None else 0))
    seen = others.unionByName(seen.where("_own_root").withColumn("_index", F.lit(0).cast("long"))).select("run_id", "process", "_first", "_index")
    events = events.withColumn("_made", made).where(F.size("_made") > 0).join(seen, ["run_id", "process"], "left")
    is_root_instance = F.coalesce(F.col("process") == F.col("root"), F.lit(False))
    known = (kind != "Exit") | is_root_instance | F.coalesce(F.col("_first") < F.col("seq"), F.lit(False))
    index = F.when(outside, F.lit(schema.NO_PROCESS)).when(is_root_instance, F.lit(0).cast("long")).otherwise(F.col("_index"))
    rows = events.where(known).select("run_id", "seq", index.cast("long").alias("process_index"), F.explode("_made").alias("o"))
    rows = rows.select("run_id", "seq", "process_index", "o.*")
    rows = rows.withColumns({c: F.array_sort(c) for c in ("args", "input_hashes", "output_hashes")})
    return rows.withColumn("leaf", op_hash(F.col("op_type"), F.col("tool_hash"), F.col("args"), F.col("input_hashes"), F.col("output_hashes")))


def finalize(ops: DataFrame) -> DataFrame:
    """One operation of each leaf and run: the first emitted."""
    first = F.struct("seq", "rank", "op_type", "process_index", "tool_hash", "args", "input_hashes", "output_hashes")
    df = ops.groupBy("run_id", "leaf").agg(F.min(first).alias("o"))
    return df.select("run_id", "leaf", *(F.col(f"o.{c}").alias(c) for c in ("op_type", "process_index", "tool_hash", "args", "input_hashes", "output_hashes")))


def canonicalize(traced: DataFrame, roots: DataFrame | None = None, watch: list[str] = ()) -> DataFrame:
    return finalize(operations(traced, roots, watch))


def op_summary(ops: DataFrame) -> DataFrame:
    """Counts by run and type, with distinct tools and file operations without one."""
    file_op = F.col("op_type").isin("FileRead", "FileWrite")
    return ops.groupBy("run_id", "op_type").agg(F.count("*").alias("ops"), F.count_distinct("tool_hash").alias("tools"), F.count_if(file_op & F.col("tool_hash").isNull()).alias("without_tool"))


def trace_summary(ops: DataFrame) -> DataFrame:
    """A run's operations in one row: how many, written files, exits, distinct tools, file operations without a tool, and outputs that nobody was found to have written."""
    kind = F.col("op_type")
    orphan = (kind == "FileWrite") & (F.col("process_index") == schema.NO_PROCESS) & F.array_contains("args", "output")
    return ops.groupBy("run_id").agg(
        F.count("*").alias("ops"), F.count_if(kind == "FileWrite").alias("writes"), F.count_if(kind == "Exit").alias("exits"), F.count_distinct("tool_hash").alias("tools"),
        F.count_if(kind.isin("FileRead", "FileWrite") & F.col("tool_hash").isNull()).alias("without_tool"), F.count_if(orphan).alias("orphans"),
    )
