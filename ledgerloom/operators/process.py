"""Process identity: sequence numbers, generations, exec epochs, and the tool of each process instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import identity
from ..tables import materialize


#: About how many rows are numbered together.
SLOT = 1 << 16


def numbered(df: DataFrame, keys: list[str], slot: Column, order: list, name: str) -> DataFrame:
    """Add ``name``: each row's number from 1 within its ``keys`` by ``order``, without a window over all rows of a key.

    ``slot`` rises with the order and deals a key's rows to ranges; each is
    numbered by itself, and moved by what the ranges before it hold.
    """
    df = df.withColumn("_slot", F.coalesce(slot.cast("long"), F.lit(-1).cast("long")))
    counts = df.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_slot").orderBy(*order)
    df = df.withColumn("_nth", F.row_number().over(within)).join(counts, [*keys, "_slot"])
    return df.withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_slot", "_nth", "_before")


def by_time(df: DataFrame, time: Column, order: list, name: str = "seq") -> DataFrame:
    """``numbered`` within each run, in ranges of equal time; a run has as many as its number of events asks for."""
    df = df.withColumn("_time", time)
    spans = df.groupBy("run_id").agg(F.min("_time").alias("_least"), F.greatest(F.lit(1.0), (F.max("_time") - F.min("_time")).cast("double") * SLOT / F.count("*")).alias("_width"))
    df = df.join(spans, "run_id")
    slot = F.floor((F.col("_time") - F.col("_least")).cast("double") / F.col("_width"))
    return numbered(df, ["run_id"], slot, order, name).drop("_time", "_least", "_width")


def sequence(raw: DataFrame) -> DataFrame:
    """Add ``seq``: raw events of a run by time, then kind, process and operation."""
    return by_time(raw, F.col("timestamp_ns"), ["timestamp_ns", "kind", "pid", "operation_id"])


def lifetimes(events: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Add ``generation`` and ``exec_epoch`` to rows of ``run_id``, ``seq``, ``kind``, ``pid``, ``child_pid`` (forks).

    A fork starts a generation of the child; so does a process first seen
    otherwise, and the root (``roots``: run_id, pid), whose first exec is the
    one it was started with and doesn't count.  Forks also get the child's.
    """
    own = events.withColumns({"_pid": F.col("pid"), "_fork": F.lit(0)})
    child = events.where((F.col("kind") == "Fork") & F.col("child_pid").isNotNull()).withColumns({"_pid": F.col("child_pid"), "_fork": F.lit(1)})
    sights = own.unionByName(child)
    sights = sights.withColumn("_root", F.lit(False)) if roots is None else sights.join(roots.select("run_id", F.col("pid").alias("_p")), "run_id", "left").withColumn("_root", F.coalesce(F.col("_pid") == F.col("_p"), F.lit(False))).drop("_p")
    order = Window.partitionBy("run_id", "_pid").orderBy("seq", "_fork")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("_fork").over(upto)
    generation = F.sum("_fork").over(upto) + F.when((first == 0) | F.col("_root"), 1).otherwise(0) - 1
    sights = sights.withColumn("generation", generation.cast("int"))
    execs = (F.col("kind") == "Exec") & (F.col("_fork") == 0)
    sights = sights.withColumn("_nth", F.sum(execs.cast("int")).over(upto))
    counted = execs & ~(F.col("_root") & (F.col("_nth") == 1))
    within = Window.partitionBy("run_id", "_pid", "generation").orderBy("seq", "_fork").rowsBetween(Window.unboundedPreceding, 0)
    sights = sights.withColumn("exec_epoch", F.sum(counted.cast("int")).over(within).cast("int"))
    born = sights.where("_fork = 1").select("run_id", "seq", F.col("_pid").alias("child_pid"), F.struct(F.col("_pid").alias("pid"), "generation", "exec_epoch").alias("child"))
    rows = sights.where("_fork = 0").withColumn("process", F.struct(F.col("_pid").alias("pid"), "generation", "exec_epoch"))
    rows = rows.drop("_pid", "_fork", "_root", "_nth")
    return rows.join(born, ["run_id", "seq", "child_pid"], "left")


def inherited(values: DataFrame, forks: DataFrame) -> DataFrame:
    """``run_id``, ``child``, ``inherited``: the value that each child takes from its parent at the fork.

    ``values``: run_id, seq, who, value; ``forks``: run_id, seq, who, child.  A
    parent without a value of its own passes on what it inherited; such chains
    are followed by doubling, in as many rounds as the logarithm of the longest.
    """
    kind = values.schema["value"].dataType
    marks = values.select("run_id", "seq", "who", "value").withColumn("child", F.lit(None).cast(forks.schema["child"].dataType))
    marks = marks.unionByName(forks.select("run_id", "seq", "who", F.lit(None).cast(kind).alias("value"), "child"))
    before = Window.partitionBy("run_id", "who").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    found = marks.withColumn("value", F.last("value", ignorenulls=True).over(before)).where(F.col("child").isNotNull())
    links = found.select("run_id", "child", F.when(F.col("value").isNull(), F.col("who")).alias("up"), "value")
    while True:
        links = materialize(links, "inherited")
        if links.where(F.col("up").isNotNull()).isEmpty():
            return links.select("run_id", "child", F.col("value").alias("inherited"))
        above = links.select("run_id", F.col("child").alias("up"), F.col("value").alias("_value"), F.col("up").alias("_up"))
        links = links.join(above, ["run_id", "up"], "left").select("run_id", "child", F.col("_up").alias("up"), F.coalesce("value", "_value").alias("value"))


def inherited_tools(events: DataFrame) -> DataFrame:
    """``run_id``, ``child``, ``inherited``: the tool that each forked instance takes from its parent."""
    forks = events.where(F.col("kind") == "Fork").select("run_id", "seq", F.col("process").alias("who"), "child")
    execs = events.where(F.col("kind") == "Exec").select("run_id", "seq", F.col("process").alias("who"), identity(F.col("obs")).alias("value"))
    return inherited(execs, forks)


def with_tools(events: DataFrame) -> DataFrame:
    """Add ``tool``: what the event's process instance runs at that event, its own exec or what it inherited."""
    upto = Window.partitionBy("run_id", "process").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("kind") == "Exec", identity(F.col("obs"))), ignorenulls=True).over(upto)
    # Written, as it is looked through for forks before it is used.
    df = materialize(events.withColumn("tool", own), "tooled")
    if df.where(F.col("kind") == "Fork").isEmpty():
        return df
    above = inherited_tools(df).select("run_id", F.col("child").alias("process"), "inherited")
    return df.join(above, ["run_id", "process"], "left").withColumn("tool", F.coalesce("tool", "inherited")).drop("inherited")
