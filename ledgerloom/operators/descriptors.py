"""Which open or mapping each close belongs to: intervals of pending writes by descriptor, inherited at forks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize

LIFE = ("run_id", "pid", "generation")
KEY = ("run_id", "space", "pid", "generation", "fd")


def _pending(marks: DataFrame) -> DataFrame:
    """Add ``pending``: what is pending just before each mark, ``governs``: what is from it on, ``decided``: whether an earlier mark has settled that.

    An open or an inheritance always takes the descriptor; a mapping only if
    nothing is pending; a close frees it; a look changes nothing.
    """
    order = Window.partitionBy(*KEY).orderBy("seq", "rank")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    takes = F.col("action").isin("open", "inherit", "close").cast("int")
    marks = marks.withColumn("_group", F.sum(takes).over(upto))
    group = Window.partitionBy(*KEY, "_group").orderBy("seq", "rank").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("governs", F.first("op", ignorenulls=True).over(group))
    return marks.withColumns({"pending": F.lag("governs").over(order), "decided": F.coalesce(F.lag("_group").over(order), F.lit(0)) > 0}).drop("_group")


def inherited(marks: DataFrame, forks: DataFrame) -> DataFrame:
    """What descriptors hold when a process begins: marks of action "inherit", for those descriptors that need one.

    Only a descriptor whose first mark isn't an open needs to know.  It looks
    into the parent at the time of the fork; where the parent has no earlier
    mark that settles it, the look goes on to the parent's parent, with what a
    mapping on the way has taken, should nothing be found above.  So rounds
    follow the distance to the open, and each looks only at what is still
    unknown: its end depends on that, not on how many were found.
    """
    mine = marks.where("space = 'tree'")
    first = mine.groupBy(*LIFE, "fd").agg(F.min_by("action", F.struct("seq", "rank")).alias("action"))
    born = forks.select("run_id", F.col("child_pid").alias("pid"), F.col("child_generation").alias("generation"), F.col("pid").alias("_pid"), F.col("generation").alias("_generation"), F.col("seq").alias("_at")).dropDuplicates(["run_id", "pid", "generation"])
    born = materialize(born, "born")
    wanted = first.where("action <> 'open'").join(born, list(LIFE))
    held = mine.schema["op"].dataType
    # Who asks: for_pid, for_generation, born; where it looks: pid, generation, at.
    front = wanted.select("run_id", "fd", F.col("pid").alias("for_pid"), F.col("generation").alias("for_generation"), F.col("_at").alias("born"), F.col("_pid").alias("pid"), F.col("_generation").alias("generation"), F.col("_at").alias("at"), F.lit(None).cast(held).alias("op"))
    found, front = None, materialize(front, "looks")
    while not front.isEmpty():
        looks = front.select(*LIFE, "fd", F.lit("tree").alias("space"), F.col("at").alias("seq"), F.lit(-2).alias("rank"), F.lit("look").alias("action"), F.lit(None).cast(held).alias("op"), "for_pid", "for_generation", "born", F.col("op").alias("below"))
        near = mine.select(*LIFE, "fd", "space", "seq", "rank", "action", "op").join(front.select(*LIFE, "fd").distinct(), [*LIFE, "fd"], "left_semi")
        seen = _pending(near.unionByName(looks, allowMissingColumns=True)).where("action = 'look'")
        seen = seen.select("run_id", "fd", "pid", "generation", "for_pid", "for_generation", "born", "decided", F.coalesce("pending", "below").alias("op"))
        seen = materialize(seen.join(born, list(LIFE), "left"), "seen")
        ends = F.col("decided") | F.col("_pid").isNull()
        got = seen.where(ends & F.col("op").isNotNull()).select("run_id", F.lit("tree").alias("space"), F.col("for_pid").alias("pid"), F.col("for_generation").alias("generation"), "fd", F.col("born").alias("seq"), F.lit(-1).alias("rank"), F.lit("inherit").alias("action"), "op")
        found = got if found is None else found.unionByName(got)
        front = seen.where(~ends).select("run_id", "fd", "for_pid", "for_generation", "born", F.col("_pid").alias("pid"), F.col("_generation").alias("generation"), F.col("_at").alias("at"), "op")
    return found


def match(marks: DataFrame, forks: DataFrame) -> DataFrame:
    """Marks with what is pending before each, inheritances included.

    ``marks``: run_id, space, pid, generation, fd, seq, rank, action (open,
    map, look, close), op (of opens and maps), and anything else; ``forks``:
    run_id, seq, pid, generation, child_pid, child_generation.  Only
    descriptors of space "tree" are inherited.
    """
    marks = marks.where(F.col("fd").isNotNull())
    if not forks.isEmpty():
        marks = materialize(marks, "marks")
        more = inherited(marks, forks)
        if more is not None:
            marks = marks.unionByName(more, allowMissingColumns=True)
    return _pending(marks).drop("decided")
