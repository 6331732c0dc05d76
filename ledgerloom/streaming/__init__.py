"""Incremental canonicalization: events arrive as a stream, a run's operations leave when the run has ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import canonical, enrich, merkle
from ..tables import materialize


def _exists(df: DataFrame, path: str) -> bool:
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def _delete(df: DataFrame, path: str) -> None:
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def _run(events: DataFrame, path: str, checkpoint: str, roots: DataFrame, ends: Column, operations: Callable[[DataFrame], DataFrame], emit: Callable[[DataFrame, int], None] | None):
    """The streaming query behind both forms: ``ends`` says which event (joined with roots) is a run's end marker."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        columns = df.columns
        mine = f"{path}/ended/batch={number}"
        # What the last batch has finished is let go: it is sure to be emitted by now.
        if number and _exists(df, f"{path}/ended/batch={number - 1}"):
            for row in spark.read.schema("run_id long").parquet(f"{path}/ended/batch={number - 1}").toLocalIterator():
                for n in range(number):
                    _delete(df, f"{path}/events/batch={n}/run_id={row.run_id}")
        before = [f"{path}/ended/batch={n}" for n in range(number) if _exists(df, f"{path}/ended/batch={n}")]
        done = spark.read.schema("run_id long").parquet(*before) if before else None
        fresh = df if done is None else df.join(done.distinct(), "run_id", "left_anti").select(*columns)
        if done is not None:
            late = df.join(done.distinct(), "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("late"))
            late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        fresh.write.mode("overwrite").partitionBy("run_id").parquet(f"{path}/events/batch={number}")
        marks = fresh.join(roots.select("run_id", "root"), "run_id").where(ends).select("run_id").distinct()
        marks.write.mode("overwrite").parquet(mine)
        ended = spark.read.schema("run_id long").parquet(mine)
        if ended.isEmpty():
            return
        # Stored by run, so that only the ended runs' folders are read.
        runs = [r.run_id for r in ended.limit(MOST_RUNS + 1).collect()]
        stored = spark.read.schema(df.schema).parquet(f"{path}/events")
        stored = stored.where(F.col("run_id").isin(runs)) if len(runs) <= MOST_RUNS else stored.join(ended, "run_id", "left_semi")
        out = merkle.roots(operations(materialize(stored.select(*columns), "ended")))
        out.write.mode("overwrite").parquet(f"{path}/roots/batch={number}")
        if emit is not None:
            emit(out, number)

    return lambda events_: events_.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


#: Up to so many runs that end in one batch are named to the scan; beyond, they are joined with it.
MOST_RUNS = 1000


def canonicalize_stream(events: DataFrame, path: str, checkpoint: str, roots: DataFrame, watch: list[str] = (), emit: Callable[[DataFrame, int], None] | None = None):
    """A streaming query that keeps traced events in a table by run and, as soon as a run's root has exited, emits its roots.

    State is the table itself (``path``/events, by batch and run), so it may
    exceed any memory and survives restarts; a batch that is repeated writes
    the same folders again, and a run's events are deleted in the batch after
    the one that emitted it.  The exit of the root process is the end marker.
    Events that come for a run after its end are counted in ``path``/late and
    change nothing; ``late_events`` sums them, so that a caller can fail closed.
    """
    ends = (F.col("kind") == "Exit") & (F.col("process.pid") == F.col("root.pid")) & (F.col("process.generation") == F.col("root.generation"))
    return _run(events, path, checkpoint, roots, ends, lambda stored: canonical.canonicalize(stored, roots, watch), emit)(events)


def trace_stream(raw: DataFrame, path: str, checkpoint: str, roots: DataFrame, observations: DataFrame | None = None, watch: list[str] = (), emit: Callable[[DataFrame, int], None] | None = None):
    """The same from raw events (RAW_EVENT): a run is enriched and canonicalized as a whole when its root has exited."""

    def operations(stored: DataFrame) -> DataFrame:
        mine = roots.join(stored.select("run_id").distinct(), "run_id", "left_semi")
        traced, _ = enrich.traced(stored, observations, mine, watch)
        return canonical.canonicalize(enrich.with_root_exec(traced, mine) if "obs" in roots.columns else traced, mine, watch)

    ends = (F.col("kind") == 4) & (F.coalesce("tgid", "pid") == F.col("root.pid"))
    return _run(raw, path, checkpoint, roots, ends, operations, emit)(raw)


def late_events(df: DataFrame, path: str) -> DataFrame:
    """``run_id``, ``dropped``: events that came after their run's end, for ``plans.check_drops``; ``df`` names the session."""
    spark = df.sparkSession
    if not _exists(df, f"{path}/late"):
        return spark.createDataFrame([], "run_id long, dropped long")
    return spark.read.schema("run_id long, late long").parquet(f"{path}/late/*").groupBy("run_id").agg(F.sum("late").alias("dropped"))
