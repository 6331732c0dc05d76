"""Mixing sources to target weights by entropy balancing.

Every document has a rate, how often it is taken.  Of all rates that give each
source its target number of words and take no document more than ``cap`` times,
those nearest to 1 in relative entropy are tilted exponentially by the
document's size: ``min(cap, exp(multiplier of the source * size))``.  The
multipliers solve the convex dual.  Newton's steps for all sources at once are
sums over the documents, made by the cluster; the multipliers stay in a table.
Rates are then rounded into whole copies.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Newton's steps end when every source is as near to its target as this, relatively; real corpora take about five.
PRECISION, STEPS = 1e-9, 100
GROUP = 4096
_BLOCK = 10_000


def words_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(per: DataFrame) -> DataFrame:
    """Add ``_rank``, from 0: the place of each source by code point, null last; ranges of sources are numbered side by side."""
    n = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = F.col("source").asc_nulls_last()
    dealt = materialize(per.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn("_nth", nth).join(counts, "_part").withColumn("_rank", F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """``source``, ``source_size``, ``n_docs``, ``target`` from rows of ``source``, ``size``, ``n`` (documents).

    Sources by code point, null last, have the weights in turn and share all
    words; a target stops at ``cap`` times its source's size, and the excess is
    shared again by weight until none is above.  Each time, two sums give the
    share of one unit of weight, and only sources that it fills come to be full.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    per = _ranked(per).withColumn("_w", F.get(F.array(*map(F.lit, weights)), F.pmod("_rank", F.lit(len(weights))).cast("int")).cast("double"))
    per = materialize(per.withColumn("_cap", cap * F.col("source_size")), "targets")
    share, full = 0.0, -1
    while True:
        above = F.col("_w") * F.lit(share) >= F.col("_cap")
        r = per.agg(F.sum("source_size").alias("total"), F.sum(F.when(above, F.col("_cap")).otherwise(0.0)).alias("taken"), F.sum(F.when(above, 0.0).otherwise(F.col("_w"))).alias("rest"), F.count_if(above).alias("full")).first()
        if r.full == full or not r.rest:
            break
        share, full = (r.total - r.taken) / r.rest, r.full
    return per.select("source", "source_size", "n_docs", F.least("_cap", F.col("_w") * F.lit(share)).alias("target"))


def rate(multiplier: Column, size: Column, cap: float) -> Column:
    return F.exp(F.least(multiplier * size, F.lit(math.log(cap))))


def solve(sizes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``targets`` with ``multiplier``; ``sizes``: source, size, n (documents of that size).

    A step needs, of every source, the words that its rates take and their
    derivative.  It is Newton's step for the logarithm of the words, within the
    bounds that earlier steps have set; past them the interval is halved (or the
    multiplier doubled, as long as there is no bound on that side).  A
    source that must be full has all rates at ``cap``, whatever its multiplier.
    """
    sizes = sizes.where("size > 0")
    start = sizes.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")).alias("_squares"))
    state = targets.join(start, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    open_ = (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - PRECISION))
    first = F.log(F.col("target") / F.col("source_size")) * F.col("source_size") / F.col("_squares")
    full = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.lit(float("inf"))).otherwise(float("-inf"))
    low, high = F.when(F.col("target") > F.col("source_size"), 0.0), F.when(F.col("target") < F.col("source_size"), 0.0)
    state = materialize(state.select("source", "source_size", "n_docs", "target", F.when(open_, first).otherwise(full).alias("multiplier"), low.alias("low"), high.alias("high"), open_.alias("open")), "duals")
    for _ in range(STEPS):
        if state.where("open").isEmpty():
            break
        now = state.where("open").select(F.col("source").alias("_s"), F.col("multiplier").alias("_m"))
        tilted = F.col("n") * F.col("size") * rate(F.col("_m"), F.col("size"), cap)
        below = F.col("_m") * F.col("size") < math.log(cap)
        sums = sizes.join(now, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s").agg(F.sum(tilted).alias("_f"), F.sum(F.when(below, tilted * F.col("size")).otherwise(0.0)).alias("_g"))
        state = state.join(sums, F.col("source").eqNullSafe(F.col("_s")) & F.col("open"), "left")
        m, short = F.col("multiplier"), F.col("_f") < F.col("target")
        low, high = F.when(short, F.greatest("low", m)).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.least("high", m))
        newton = F.when(F.col("_g") > 0, m + F.log(F.col("target") / F.col("_f")) * F.col("_f") / F.col("_g"))
        inside = newton.isNotNull() & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        halved = F.coalesce((low + high) / 2, 2 * m)
        done = F.abs(F.col("_f") - F.col("target")) <= PRECISION * F.col("target")
        step = F.when(F.col("open") & ~done, F.when(inside, newton).otherwise(halved)).otherwise(m)
        state = materialize(state.select("source", "source_size", "n_docs", "target", step.alias("multiplier"), low.alias("low"), high.alias("high"), (F.col("open") & ~F.coalesce(done, F.lit(True))).alias("open")), "duals")
    return state.select("source", "source_size", "n_docs", "target", "multiplier")


def _rounded(cap: int):
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole copies, largest documents first; what one has too much or too little is carried to the next."""
        pdf = pdf.sort_values(["size", "doc_id", "key"], ascending=[False, True, True], kind="stable", na_position="first")
        copies, carry = np.zeros(len(pdf), dtype=np.int64), 0.0
        for i, (size, n, rate) in enumerate(zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True)):
            if size:
                wanted = rate * size * n + carry
                copies[i] = c = min(cap * n, max(0, int(math.floor(wanted / size + 0.5))))
                carry = wanted - c * size
        return pdf.assign(copies=copies)[["doc_id", "size", "source_size", "target", "n", "copies", "key"]]

    return group


def row_key(df: DataFrame) -> Column:
    """A hash of the whole row."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema])


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``n``, ``copies``, ``key``: of ``n`` wholly equal rows (``key`` is their hash) the copies of all together.

    A source is rounded in groups of about ``GROUP`` documents dealt by a hash,
    so a source of any size is spread over many tasks; what each group misses
    is less than its smallest documents.  Rows that repeat are one row here,
    counted.  Null texts and texts without words have size 0 and no copies;
    null is a source like any other; an empty table gives an empty result.
    """
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of("text").alias("size"), row_key(docs).alias("key"))
    rows = materialize(one.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n")), "sizes")
    # Documents of one size have one rate, so the sums go over sizes.
    sizes = materialize(rows.groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
    duals = solve(sizes, source_targets(sizes, weights, cap), float(cap))
    duals = duals.select(F.col("source").alias("_s"), "source_size", "target", "multiplier", F.ceil(F.col("n_docs") / GROUP).alias("_groups"))
    df = rows.join(duals, F.col("source").eqNullSafe(F.col("_s")))
    df = df.withColumn("rate", F.when(F.col("size") > 0, F.round(rate(F.col("multiplier"), F.col("size"), float(cap)), 9)).otherwise(0.0))
    df = df.withColumn("_group", F.pmod(F.xxhash64("doc_id", "size", "key"), F.greatest(F.col("_groups"), F.lit(1))))
    return df.groupBy("_s", "_group").applyInPandas(_rounded(cap), "doc_id long, size long, source_size long, target double, n long, copies long, key long")


def repeated(df: DataFrame, times: Column, name: str = "_nth") -> DataFrame:
    """Each row ``times`` times, numbered from 0; no array is longer than a block or the number of blocks."""
    df = df.withColumn("_times", times.cast("long")).where("_times > 0")
    df = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / _BLOCK))))
    last = F.least(F.lit(_BLOCK).cast("long"), F.col("_times") - F.col("_block") * _BLOCK) - 1
    df = df.withColumn("_in", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return df.withColumn(name, F.col("_block") * _BLOCK + F.col("_in")).drop("_times", "_block", "_in")


def repeat_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mixed corpus itself: each row as often as it has copies, with the columns it had, whatever these are called.

    Rows that are wholly equal are taken as one, and repeated as often as mix
    decided for all of them together.
    """
    copies = materialize(mix(docs, weights, cap).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "n", "copies"), "copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), row_key(docs).alias("key"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    single = rows.join(copies.where("n = 1"), same).select("row", "copies")
    # Equal rows meet as one in each task before they are moved.
    several = rows.join(copies.where("n > 1"), same).groupBy("_id", "_key").agg(F.first("row").alias("row"), F.first("copies").alias("copies")).select("row", "copies")
    return repeated(single.unionByName(several), F.col("copies")).select("row.*")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` for every row; equal rows share their copies as evenly as whole numbers can."""
    df = repeated(mix(docs, weights, cap), F.col("n"))
    own = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("_nth") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return df.select("doc_id", "size", "source_size", "target", (own * F.col("size")).alias("taken"))
