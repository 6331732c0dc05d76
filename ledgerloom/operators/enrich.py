"""From raw kernel events to traced events: renames joined, descriptors named, external events filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.paths import can_write, decode, keeps_untracked_open, keeps_untracked_rename, keeps_untracked_unlink, resolve, watched
from ..tables import materialize
from . import descriptors, moves
from .process import inherited, lifetimes, sequence


def rename_pairs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Renames (``run_id``, ``seq``, ``pid``, ``operation_id``, ``flags``, ``from_path``, ``to_path``, ``part``) and unmatched halves.

    Source and destination meet by process and operation.  An exchange gives
    a second rename, the other way.  ``seq`` is the destination's.
    """
    keys = ["run_id", "pid", "operation_id"]
    source = raw.where("kind = 6").select(*keys, F.col("path").alias("from_path"), F.col("seq").alias("_s"))
    target = raw.where("kind = 7").select(*keys, F.col("path").alias("to_path"), "seq", "flags")
    both = source.join(target, keys, "full")
    lost = both.where(F.col("from_path").isNull() | F.col("to_path").isNull()).select(*keys)
    good = both.where(F.col("from_path").isNotNull() & F.col("to_path").isNotNull())
    forth = F.struct(F.lit(0).alias("part"), "from_path", "to_path")
    back = F.when(F.col("flags").bitwiseAND(F.lit(schema.RENAME_EXCHANGE)) != 0, F.struct(F.lit(1).alias("part"), F.col("to_path").alias("from_path"), F.col("from_path").alias("to_path")))
    good = good.withColumn("_r", F.explode(F.array_compact(F.array(forth, back))))
    return good.select(*keys, "seq", "flags", "_r.part", "_r.from_path", "_r.to_path"), lost


def tracked(raw: DataFrame, roots: DataFrame) -> DataFrame:
    """Events of the traced tree (source 0) only if their process is the root (``roots``: run_id, pid) or was forked below it; others as they are.

    Each round looks at the children of the processes found in the last one.
    """
    forks = raw.where("kind = 9").select("run_id", F.col("parent_pid").alias("pid"), "child_pid").distinct()
    front = known = materialize(roots.select("run_id", "pid").distinct(), "tracked")
    while not front.isEmpty():
        children = forks.join(front, ["run_id", "pid"]).select("run_id", F.col("child_pid").alias("pid")).distinct()
        front = materialize(children.join(known, ["run_id", "pid"], "left_anti"), "tracked")
        known = known.unionByName(front)
    own = F.coalesce(F.col("source"), F.lit(0)) == 0
    acting = F.when(F.col("kind") == 9, F.col("parent_pid")).otherwise(F.coalesce("tgid", "pid"))
    inside = raw.where(own).withColumn("_p", acting).join(known.select("run_id", F.col("pid").alias("_p")), ["run_id", "_p"], "left_semi").drop("_p")
    return inside.unionByName(raw.where(~own))


def admitted(raw: DataFrame, watch: list[str] = ()) -> DataFrame:
    """What a source passes on: opens and mappings of a descriptor that exists and, of untracked processes, opens and unlinks near the watched paths."""
    kind, untracked = F.col("kind"), F.coalesce(F.col("source") == 1, F.lit(False))
    flags, prefixes = F.coalesce("flags", F.lit(0).cast("long")), list(watch)
    failed = kind.isin(1, 5) & (F.col("fd") < 0)
    far = untracked & F.col("path").isNotNull() & (((kind == 1) & ~keeps_untracked_open(F.col("path"), flags, prefixes)) | ((kind == 8) & ~keeps_untracked_unlink(F.col("path"), prefixes)))
    return raw.where(~F.coalesce(failed | far, F.lit(False)))


def with_folders(events: DataFrame, root_cwd: Column) -> DataFrame:
    """Add ``home``, the working folder of an event's process, and ``base``, the folder that its relative path starts from.

    What the system said of it at the event (``cwd``) comes first.  Paths below
    the working folder take that of the process's last event that said it, or
    what its parent had at the fork, or the root's.
    """
    below_cwd = F.coalesce(F.col("dfd"), F.lit(schema.AT_FDCWD)) == schema.AT_FDCWD
    said = F.when(below_cwd & F.coalesce(~F.startswith(F.coalesce("path", "from_path"), F.lit("/")), F.lit(False)), F.col("cwd"))
    life = F.struct("process.pid", "process.generation")
    events = events.withColumns({"_said": said, "_life": life})
    upto = Window.partitionBy("run_id", "_life").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("_own", F.last("_said", ignorenulls=True).over(upto))
    forks = events.where((F.col("kind") == "Fork") & F.col("child").isNotNull()).select("run_id", "seq", F.col("_life").alias("who"), F.struct("child.pid", "child.generation").alias("child"))
    values = events.where(F.col("_said").isNotNull()).select("run_id", "seq", F.col("_life").alias("who"), F.col("_said").alias("value"))
    if values.isEmpty():
        events = events.withColumn("_above", F.lit(None).cast("string"))
    else:
        above = inherited(values, forks).select("run_id", F.col("child").alias("_life"), F.col("inherited").alias("_above"))
        events = events.join(above, ["run_id", "_life"], "left")
    events = events.withColumn("home", F.coalesce("_own", "_above", root_cwd))
    return events.withColumn("base", F.coalesce("cwd", F.when(below_cwd, F.col("home")))).drop("_said", "_life", "_own", "_above")


def descriptor_paths(events: DataFrame) -> DataFrame:
    """Closes and mappings with ``opened``: path, flags and observation of the open that their descriptor has, or null.

    A descriptor is the process's own or inherited at its fork; its path
    follows the renames that happened between the open and the event.
    """
    kind = F.col("kind")
    opens = (kind == "FileOpen") & (F.col("fd") >= 0)
    asks = kind.isin("FileClose", "FileMmap")
    held = F.struct("seq", "path", "flags", "obs")
    marks = events.where(opens | asks).select(
        "run_id", F.lit("tree").alias("space"), "process.pid", "process.generation", "fd", "seq", F.lit(0).alias("rank"),
        F.when(opens, "open").when(kind == "FileClose", "close").otherwise("look").alias("action"), F.when(opens, held).alias("op"),
    )
    forks = events.where((kind == "Fork") & F.col("child").isNotNull()).select("run_id", "seq", "process.pid", "process.generation", F.col("child.pid").alias("child_pid"), F.col("child.generation").alias("child_generation"))
    found = descriptors.match(marks, forks).where(F.col("action").isin("close", "look") & F.col("pending").isNotNull())
    found = materialize(found.select("run_id", "seq", F.col("pending").alias("opened")), "opened")
    # Both halves of an exchange happen at once.
    renames = events.where(kind == "FileRename").select("run_id", (F.floor(F.col("seq") / 2) * 2).alias("seq"), "from_path", "to_path")
    names = moves.followed(found.select("run_id", "seq", "opened.path", F.col("opened.seq").alias("since")), renames)
    now = F.struct(F.coalesce("path", "opened.path").alias("path"), F.col("opened.flags").alias("flags"), F.col("opened.obs").alias("obs"))
    return found.join(names, ["run_id", "seq"], "left").select("run_id", "seq", now.alias("opened"))


def traced(raw: DataFrame, observations: DataFrame | None = None, roots: DataFrame | None = None, watch: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of TRACED_EVENT, and per run the number of events that were dropped as malformed.

    ``raw`` has the columns of RAW_EVENT; ``observations`` (run_id,
    timestamp_ns, pid, kind, obs) is what was seen of the files; ``roots``
    (run_id, pid, cwd) the process that was started, whose first exec is the
    start itself and leaves.  Closes and mappings are named by the open that
    their descriptor has, own or inherited, as renamed since; a mapping sees
    what that open saw, and only the close of a descriptor that can write
    sees anything.  Opens that truncate see empty contents.  External events
    outside the watched paths are dropped; so are external closes and mappings
    of descriptors that nothing opened.
    """
    watch = list(watch)
    raw = sequence(raw.withColumn("path", decode(F.col("path"))))
    names = F.create_map(*[F.lit(x) for item in schema.EVENT_KINDS.items() for x in item])
    pathless = F.col("kind").isin(1, 3, 6, 7, 8) & F.col("path").isNull()
    bad = F.coalesce(F.col("kind").isNull() | ~F.col("kind").between(1, 9) | pathless, F.lit(True))
    raw = materialize(raw.withColumn("_bad", bad), "raw")
    good = admitted(raw.where("NOT _bad"), watch)
    renames, lost = rename_pairs(good)
    dropped = raw.where("_bad").select("run_id").unionByName(lost.select("run_id")).groupBy("run_id").agg(F.count("*").alias("dropped"))
    none = lambda kind: F.lit(None).cast(kind)
    plain = good.where(~F.col("kind").isin(6, 7)).select(
        "run_id", "seq", F.lit(0).alias("part"), names[F.col("kind")].alias("kind"), F.when(F.col("kind") == 9, F.col("parent_pid")).otherwise(F.coalesce("tgid", "pid")).alias("pid"), "child_pid", "path",
        none("string").alias("from_path"), none("string").alias("to_path"), "flags", "prot", "fd", (F.coalesce(F.col("source") == 1, F.lit(False)) & F.col("kind").isin(1, 2, 5, 8)).alias("external"), "exit_code", F.when(F.col("kind") != 3, F.col("dfd")).alias("dfd"), "proc_target", "cwd",
        none("int").alias("_to_dfd"), none("string").alias("_to_cwd"), "timestamp_ns", F.col("pid").alias("_raw_pid"), F.col("kind").alias("_raw_kind"),
    )
    source = good.where("kind = 6").select("run_id", F.col("pid").alias("_p"), "operation_id", F.col("source").alias("_from_source"), F.col("dfd").alias("_from_dfd"), F.col("cwd").alias("_from_cwd"))
    target = good.where("kind = 7").select("run_id", "seq", "tgid", "source", "dfd", "cwd", "timestamp_ns")
    moved = renames.join(target, ["run_id", "seq"]).join(source.withColumnRenamed("_p", "pid"), ["run_id", "pid", "operation_id"])
    external = (F.coalesce("source", F.lit(0)) == 1) | (F.coalesce("_from_source", F.lit(0)) == 1)
    moved = moved.where(~(external & ~keeps_untracked_rename(F.col("from_path"), F.col("to_path"), watch)))
    # An exchange's second half goes the other way: its paths have changed places, and so have their folders.
    swap = lambda a, b: F.when(F.col("part") == 0, F.col(a)).otherwise(F.col(b))
    moved = moved.select(
        "run_id", "seq", "part", F.lit("FileRename").alias("kind"), F.coalesce("tgid", "pid").alias("pid"), none("long").alias("child_pid"), none("string").alias("path"), "from_path", "to_path", "flags",
        none("long").alias("prot"), none("int").alias("fd"), external.alias("external"), none("int").alias("exit_code"), swap("_from_dfd", "dfd").alias("dfd"), none("string").alias("proc_target"), swap("_from_cwd", "cwd").alias("cwd"),
        swap("dfd", "_from_dfd").alias("_to_dfd"), swap("cwd", "_from_cwd").alias("_to_cwd"), "timestamp_ns", F.col("pid").alias("_raw_pid"), F.lit(7).alias("_raw_kind"),
    )
    events = plain.unionByName(moved)
    # An exchange's second half follows the first.
    events = events.withColumn("seq", F.col("seq") * 2 + F.col("part")).drop("part")
    events = lifetimes(events, roots)
    homed = roots is not None and "cwd" in roots.columns
    events = events.join(roots.select("run_id", F.col("cwd").alias("_root_cwd")), "run_id", "left") if homed else events.withColumn("_root_cwd", none("string"))
    if roots is not None:  # the start itself
        start = events.where("kind = 'Exec'").join(roots.select("run_id", "pid"), ["run_id", "pid"], "left_semi").groupBy("run_id").agg(F.min("seq").alias("seq"))
        events = events.join(start, ["run_id", "seq"], "left_anti")
    events = materialize(events, "identified")
    events = with_folders(events, F.col("_root_cwd"))
    for c, base, seen in (("path", F.col("base"), F.col("proc_target")), ("from_path", F.col("base"), none("string")), ("to_path", F.coalesce("_to_cwd", F.when(F.coalesce("_to_dfd", F.lit(schema.AT_FDCWD)) == schema.AT_FDCWD, F.col("home"))), none("string"))):
        events = events.withColumn(c, F.when(F.col(c).isNotNull(), resolve(F.col(c), seen, base)))
    near = watched(F.col("path"), watch) | watched(F.col("from_path"), watch) | watched(F.col("to_path"), watch)
    events = events.where(~(F.coalesce("external", F.lit(False)) & F.col("kind").isin("FileOpen", "FileRename", "FileUnlink") & ~near))
    if observations is None:
        events = events.withColumn("obs", none(schema.OBSERVATION))
    else:
        seen = observations.select("run_id", "timestamp_ns", F.col("pid").alias("_raw_pid"), F.col("kind").alias("_raw_kind"), "obs")
        events = events.join(seen, ["run_id", "timestamp_ns", "_raw_pid", "_raw_kind"], "left")
    cut = (F.col("kind") == "FileOpen") & (F.col("fd") >= 0) & (F.col("flags").bitwiseAND(F.lit(schema.O_TRUNC)) != 0)
    empty = F.struct(F.lit("content").alias("kind"), F.lit(schema.EMPTY_CONTENT).alias("hash"))
    events = materialize(events.withColumn("obs", F.when(cut, empty).otherwise(F.col("obs"))), "resolved")
    events = events.join(descriptor_paths(events), ["run_id", "seq"], "left")
    closes, maps = F.col("kind") == "FileClose", F.col("kind") == "FileMmap"
    events = events.where(~(F.coalesce("external", F.lit(False)) & (closes | maps) & F.col("opened").isNull()))
    writes = can_write(F.coalesce("opened.flags", F.lit(0).cast("long")))
    obs = F.when(closes, F.when(writes, F.col("obs"))).when(maps, F.when(F.col("opened").isNotNull(), F.coalesce("opened.obs", "obs"))).otherwise(F.col("obs"))
    events = events.withColumns({"path": F.when(closes | maps, F.col("opened.path")).otherwise(F.col("path")), "obs": obs})
    columns = [f.split(" ")[0] for f in schema.TRACED_EVENT.replace(schema.PROCESS, "X").replace(schema.OBSERVATION, "X").split(", ")]
    return events.select(*columns), dropped


def with_root_exec(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Put the root's own exec in front of each run; ``roots``: run_id, root, obs (of its binary)."""
    first = roots.select("run_id", F.lit(-1).cast("long").alias("seq"), F.lit("Exec").alias("kind"), F.col("root").alias("process"), "obs", F.lit(False).alias("external"))
    return events.unionByName(first, allowMissingColumns=True)


def exit_code(status: int) -> int:
    """A wait status as a code: the exit code, or 128 and the signal's number."""
    return 128 + (status & 0x7F) if status & 0x7F else status >> 8 & 0xFF


def wait_code(status: Column) -> Column:
    """``exit_code`` of a column."""
    signal = status.bitwiseAND(F.lit(0x7F))
    return F.when(signal != 0, signal + 128).otherwise(F.shiftright(status, 8).bitwiseAND(F.lit(0xFF))).cast("int")


def with_root_exit(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Give the root's last exit the code of its wait status (``roots``: run_id, root, status); a run without such an exit gets one at its end.

    What the kernel says of exits has no code.  Runs without a status stay as they are.
    """
    known = roots.where(F.col("status").isNotNull()).select("run_id", F.col("root.pid").alias("_pid"), wait_code(F.col("status")).alias("_code"), F.col("root").alias("_root"))
    own = (F.col("kind") == "Exit") & (F.col("process.pid") == F.col("_pid"))
    spans = events.join(known, "run_id").groupBy("run_id").agg(F.max("seq").alias("_end"), F.max(F.when(own, F.col("seq"))).alias("_exit"), F.max(F.when(F.col("process.pid") == F.col("_pid"), F.struct("seq", "process"))).alias("_last"))
    spans = known.join(spans, "run_id", "left")
    marks = spans.where(F.col("_exit").isNotNull()).select("run_id", F.col("_exit").alias("seq"), "_code")
    ended = events.join(marks, ["run_id", "seq"], "left").withColumn("exit_code", F.coalesce("_code", "exit_code")).drop("_code")
    missing = spans.where(F.col("_exit").isNull()).select(
        "run_id", (F.coalesce("_end", F.lit(0).cast("long")) + 1).alias("seq"), F.lit("Exit").alias("kind"), F.coalesce("_last.process", "_root").alias("process"), F.lit(False).alias("external"), F.col("_code").alias("exit_code")
    )
    return ended.unionByName(missing, allowMissingColumns=True)
