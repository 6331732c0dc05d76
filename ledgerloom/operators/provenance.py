"""The part of a trace that explains selected outputs: flows, rename aliases, backward closure, sliced operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.hashing import op_hash
from ..functions.paths import can_read, can_write, content_hash, identity, is_system_state, maps_writes
from ..tables import materialize
from . import descriptors, moves
from .canonical import finalize
from .process import inherited_tools, numbered


def aliases(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """All paths by which writers are known after renames: ``run_id``, ``path``, ``writer``.

    ``rows``: run_id, path, writer, avail (the seq from which renames apply);
    ``renames``: run_id, seq, from_path, to_path.  First renames apply to what
    was there before them; then once more, in order, to everything that has
    come about, for writes that were recorded late.  A path meets a rename
    through its ancestors, which makes the prefix condition an equality.
    """
    chunks = moves.listed(renames)

    def pass_(rows: DataFrame, who: list[str]) -> DataFrame:
        """Rows and what they become, each path with the least time from which it holds; every round looks at new or earlier ones only."""
        least = lambda df: df.groupBy("run_id", "path", *who).agg(F.min("avail").alias("avail"))
        front = state = materialize(least(rows), "aliases")
        while True:
            met = moves.next_renames(front, chunks, "path", "avail")
            new = least(met.select("run_id", moves.renamed("path").alias("path"), *who, F.col("_s").alias("avail")))
            known = least(state).withColumnRenamed("avail", "_known")
            new = new.join(known, ["run_id", "path", *who], "left").where(F.col("_known").isNull() | (F.col("avail") < F.col("_known"))).drop("_known")
            front = materialize(new, "aliases")
            if front.isEmpty():
                return state
            state = state.unionByName(front)

    first = materialize(pass_(rows.select("run_id", "path", "writer", "avail"), ["writer"]).select("run_id", "path", "writer").distinct(), "aliases")
    # The second time all start together, so that paths suffice, whoever wrote them.
    again = first.select("run_id", "path", F.col("path").alias("origin"), F.lit(-1).cast("long").alias("avail")).distinct()
    names = pass_(again, ["origin"]).select("run_id", "path", "origin").distinct()
    return names.join(first.select("run_id", F.col("path").alias("origin"), "writer"), ["run_id", "origin"]).select("run_id", "path", "writer").distinct()


def closure(reads: DataFrame, by_hash: DataFrame, by_path: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Included processes (``run_id``, ``process``) and relevant hashes (``run_id``, ``hash``).

    ``reads``: run_id, process, hash; ``by_hash``: run_id, hash, process;
    ``by_path``: run_id, path, process; ``outputs``: run_id, path, hash.
    Starts from the writers of each output path and follows what they read to
    those who wrote it; the outputs' own contents aren't followed.  Each round
    looks only at processes found in the last one.
    """
    relevant = materialize(outputs.select("run_id", "hash").distinct(), "relevant")
    front = materialize(outputs.select("run_id", "path").distinct().join(by_path, ["run_id", "path"]).select("run_id", "process").distinct(), "front")
    included = front
    while not front.isEmpty():
        new = materialize(reads.join(front, ["run_id", "process"]).select("run_id", "hash").distinct().join(relevant, ["run_id", "hash"], "left_anti"), "new")
        relevant = relevant.unionByName(new)
        writers = by_hash.join(new, ["run_id", "hash"]).select("run_id", "process").distinct()
        front = materialize(writers.join(included, ["run_id", "process"], "left_anti"), "front")
        included = included.unionByName(front)
    return included, relevant


def sliced(flows: DataFrame, reads: DataFrame, writes: DataFrame, renamed: DataFrame, by_path: DataFrame, outputs: DataFrame, exits: DataFrame | None = None) -> DataFrame:
    """The operations (as from ``canonical.operations``) of all processes that outputs depend on.

    ``flows``: run_id, process, tool_hash, has_exec; ``reads``, ``writes``,
    ``renamed``: run_id, process, hash; ``exits``: run_id, process, exit_code of
    each root.  An output that no included process wrote is credited to the
    least process that did, or to none.
    """
    by_hash = writes.unionByName(renamed).select("run_id", "hash", "process").distinct()
    included, relevant = closure(reads, by_hash, by_path, outputs)
    acting = included.join(flows, ["run_id", "process"])
    none = F.array().cast("array<string>")

    def ops(df: DataFrame, kind: str, rank: int, inputs: Column, result: Column, tool: str = "tool_hash", args: Column = none) -> DataFrame:
        return df.select(
            "run_id", F.lit(0).cast("long").alias("seq"), F.lit(rank).alias("rank"), F.lit(kind).alias("op_type"), "process", F.col(tool).alias("tool_hash"),
            args.cast("array<string>").alias("args"), inputs.cast("array<string>").alias("input_hashes"), result.cast("array<string>").alias("output_hashes"),
        )

    one = F.array("hash")
    ran = ops(acting.where("has_exec AND tool_hash IS NOT NULL"), "Exec", 0, none, none)
    read = ops(reads.distinct().join(acting, ["run_id", "process"]), "FileRead", 1, one, none)
    mine = lambda df: df.distinct().join(acting, ["run_id", "process"]).join(relevant, ["run_id", "hash"], "left_semi")
    wrote, moved = mine(writes), mine(renamed)
    done = wrote.select("run_id", "hash").unionByName(moved.select("run_id", "hash")).distinct()
    orphans = outputs.select("run_id", "hash").distinct().join(done, ["run_id", "hash"], "left_anti")
    # By any writer of the same content; the least, so that runs agree.
    least = by_hash.groupBy("run_id", "hash").agg(F.min("process").alias("process"))
    orphans = orphans.join(least, ["run_id", "hash"], "left").join(flows, ["run_id", "process"], "left")
    credited = ops(orphans.where("process IS NOT NULL"), "FileWrite", 3, none, one)
    lost = ops(orphans.where("process IS NULL").withColumn("tool_hash", F.lit(None).cast("string")), "FileWrite", 4, none, one, args=F.array(F.lit("output")))
    every = ran.unionByName(read).unionByName(ops(wrote, "FileWrite", 2, none, one)).unionByName(ops(moved, "FileRename", 2, one, one)).unionByName(credited).unionByName(lost)
    if exits is not None:
        ended = exits.join(outputs.select("run_id").distinct(), "run_id", "left_semi").join(flows, ["run_id", "process"], "left")
        every = every.unionByName(ops(ended, "Exit", 5, none, none, args=F.array(F.concat(F.lit("exit:"), F.col("exit_code").cast("string")))))
    return every.withColumn("leaf", op_hash(F.col("op_type"), F.col("tool_hash"), F.col("args"), F.col("input_hashes"), F.col("output_hashes")))


def flows_of(traced: DataFrame) -> dict[str, DataFrame]:
    """Flows, reads, writes, renames and rows for ``aliases`` from the events of TRACED_EVENT; external events don't count."""
    events = traced.where(~F.coalesce("external", F.lit(False)))
    kind, flags, prot = F.col("kind"), F.coalesce("flags", F.lit(0).cast("long")), F.coalesce("prot", F.lit(0).cast("long"))
    content = content_hash(F.col("obs"))
    execs = events.where("kind = 'Exec'").groupBy("run_id", "process").agg(F.max_by(identity(F.col("obs")), "seq").alias("own"))
    actors = events.where(kind != "FileUnlink").select("run_id", "process").distinct()
    flows = actors.join(execs, ["run_id", "process"], "left")
    born = events.where("kind = 'Fork'").select("run_id", F.col("child").alias("process"))
    if not born.isEmpty():
        above = inherited_tools(events).select("run_id", F.col("child").alias("process"), "inherited")
        flows = actors.unionByName(born).distinct().join(execs, ["run_id", "process"], "left").join(above, ["run_id", "process"], "left")
    else:
        flows = flows.withColumn("inherited", F.lit(None).cast("string"))
    flows = flows.select("run_id", "process", F.coalesce("own", "inherited").alias("tool_hash"), F.col("own").isNotNull().alias("has_exec"))

    mapped = (kind == "FileMmap") & F.col("path").isNotNull() & F.col("obs").isNotNull()
    seen = F.when(is_system_state(F.col("path")), F.lit(schema.SYSTEM_STATE)).otherwise(content)
    reads = events.where(((kind == "FileOpen") & can_read(flags)) | mapped).select("run_id", "process", seen.alias("hash"))
    moves = events.where("kind = 'FileRename'")
    renames = moves.select("run_id", "seq", "from_path", "to_path")
    renamed = moves.select("run_id", "process", content.alias("hash")).where("hash IS NOT NULL").distinct()
    reads = reads.where("hash IS NOT NULL").unionByName(renamed).distinct()

    # Here a writable mapping takes the descriptor like an open, and any close frees it.
    opens = ((kind == "FileOpen") & can_write(flags)) | (mapped & maps_writes(prot, flags))
    closes = kind == "FileClose"
    marks = events.where(opens | closes).select(
        "run_id", F.lit("tree").alias("space"), "process.pid", "process.generation", "fd", "seq", F.lit(0).alias("rank"),
        F.when(closes, "close").otherwise("open").alias("action"), F.when(~closes, F.struct("seq", "process", "path")).alias("op"), F.col("path").alias("closed_path"), "obs",
    )
    forks = events.where("kind = 'Fork'").select("run_id", "seq", "process.pid", "process.generation", F.col("child.pid").alias("child_pid"), F.col("child.generation").alias("child_generation"))
    ended = descriptors.match(marks, forks).where("action = 'close' AND pending IS NOT NULL AND obs IS NOT NULL")
    # A close without a path has that of the open, as renamed meanwhile.
    ended = materialize(ended.select("run_id", "seq", "pending", "closed_path", "obs"), "ended")
    bare = ended.where("closed_path IS NULL").select("run_id", "seq", "pending.path", F.col("pending.seq").alias("since"))
    now = F.col("pending.path")
    if not bare.isEmpty():
        ended = ended.join(moves.followed(bare, renames).withColumnRenamed("path", "_now"), ["run_id", "seq"], "left")
        now = F.coalesce("_now", "pending.path")
    ended = ended.select("run_id", F.col("pending.process").alias("process"), F.coalesce("closed_path", now).alias("path"), content.alias("hash"), "seq")
    writes = ended.where("hash IS NOT NULL").select("run_id", "process", "hash").distinct()
    rows = ended.select("run_id", "path", F.col("process").alias("writer"), F.col("seq").alias("avail")).unionByName(moves.select("run_id", F.col("to_path").alias("path"), F.col("process").alias("writer"), F.col("seq").alias("avail")))
    return {"flows": flows, "reads": reads, "writes": writes, "renamed": renamed, "paths": rows, "renames": renames}


def canonicalize_slice(traced: DataFrame, roots: DataFrame, outputs: DataFrame) -> DataFrame:
    """CANONICAL_OP rows of what the outputs (run_id, path, hash) depend on; none for a run without outputs."""
    f = flows_of(traced)
    by_path = aliases(f["paths"], f["renames"]).withColumnRenamed("writer", "process")
    mine = roots.select("run_id", "root")
    last = traced.where("kind = 'Exit'").join(mine, "run_id").where((F.col("process.pid") == F.col("root.pid")) & (F.col("process.generation") == F.col("root.generation")))
    exits = last.groupBy("run_id").agg(F.max_by(F.struct("process", F.coalesce("exit_code", F.lit(0)).alias("exit_code")), "seq").alias("e")).select("run_id", "e.*")
    ops = sliced(f["flows"], f["reads"], f["writes"], f["renamed"], by_path, outputs, exits)
    others = ops.where("process IS NOT NULL AND op_type <> 'Exit'").select("run_id", "process").distinct().join(mine.select("run_id", F.col("root").alias("process")), ["run_id", "process"], "left_anti")
    number = numbered(others, ["run_id"], F.floor(F.col("process.pid") / 1024), ["process"], "process_index")
    number = number.unionByName(mine.select("run_id", F.col("root").alias("process"), F.lit(0).cast("long").alias("process_index")))
    ops = ops.join(number, ["run_id", "process"], "left").withColumn("process_index", F.coalesce("process_index", F.lit(schema.NO_PROCESS)))
    return finalize(ops)
