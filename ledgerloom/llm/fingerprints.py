"""Document fingerprints by winnowing, with DataFrame functions only.

The texts' words are hashed, ``k`` consecutive word hashes are joined by a
cyclic-polynomial rolling hash, and in each window of ``w`` consecutive k-gram
hashes the least one is chosen, the rightmost on ties.  Any passage of
``w + k - 1`` words that two texts share therefore gives both the same hash;
the place of each chosen k-gram is kept beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

K, W = 4, 6


def _rotate(x: Column, by: int) -> Column:
    return x if not by else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(7).cast("long"))


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = K, w: int = W) -> DataFrame:
    """Add ``name``: array of chosen hashes, and ``name_at``: their places (k-gram number), for the string column ``text``.

    Null and empty texts, and texts without words, have no hashes.  A text of
    fewer than ``k`` words is one k-gram; one of fewer than ``w`` k-grams is one window.
    """
    assert 2 <= k and 2 <= w <= 8
    words, grams, least, kept = f"{name}__h", f"{name}__g", f"{name}__m", f"{name}__i"
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    df = df.withColumn(words, F.transform(found, lambda x: F.xxhash64(x)))

    def rolled(i: Column) -> Column:
        value = F.col(words)[i]
        for j in range(1, k):
            value = _rotate(value, 1).bitwiseXOR(F.get(F.col(words), i + F.lit(j)))
        return value

    whole = F.array(F.aggregate(F.col(words), F.lit(0).cast("long"), lambda a, x: _rotate(a, 1).bitwiseXOR(x)))
    n = F.size(words)
    places = F.when(n >= k, F.sequence(F.lit(0), F.greatest(n - F.lit(k), F.lit(0))))
    empty = F.array().cast("array<bigint>")
    df = df.withColumn(grams, F.when(n >= k, F.transform(places, rolled)).when(n > 0, whole).otherwise(empty))
    # The low three bits make way for the place within the window, so that the least value is also the rightmost.
    df = df.withColumn(grams, F.transform(grams, lambda x: x.bitwiseAND(F.lit(-8).cast("long"))))
    m = F.size(grams)
    tied = lambda i: F.least(*(F.get(F.col(grams), i + F.lit(j)) + F.lit(w - 1 - j).cast("long") for j in range(w)))
    windows = F.when(m > 0, F.sequence(F.lit(0), F.greatest(m - F.lit(w), F.lit(0))))
    df = df.withColumn(least, F.when(m > 0, F.transform(windows, tied)).otherwise(empty))
    # The next window chose the same k-gram again if its place there is one to the left.
    fresh = lambda i: (i == 0) | (_low(F.col(least)[i]) != _low(F.get(F.col(least), i - F.lit(1))) + F.lit(1))
    df = df.withColumn(kept, F.when(m > 0, F.filter(F.sequence(F.lit(0), F.greatest(F.size(least) - F.lit(1), F.lit(0))), fresh)).otherwise(F.array().cast("array<int>")))
    df = df.withColumn(name, F.transform(kept, lambda i: F.col(least)[i].bitwiseAND(F.lit(-8).cast("long"))))
    df = df.withColumn(f"{name}_at", F.transform(kept, lambda i: i + F.lit(w - 1) - _low(F.col(least)[i]).cast("int")))
    return df.drop(words, grams, least, kept)


def as_string(hashes: str, places: str) -> Column:
    """``hash@place`` of each chosen k-gram, in order; 12 hexadecimal digits of the hash."""
    one = lambda h, p: F.concat(F.lpad(F.lower(F.hex(F.shiftrightunsigned(h, 16))), 12, "0"), F.lit("@"), p.cast("string"))
    return F.array_join(F.zip_with(hashes, places, one), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of the sets of chosen hashes; 1 for two empty fingerprints."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(F.col(a))) + F.size(F.array_distinct(F.col(b))) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common.cast("double") / union)


def with_next(df: DataFrame, order: str, buckets: int | None = None) -> tuple[DataFrame, Window]:
    """Deal the rows into ranges of ``order``; each range also gets the first rows of the next one, marked ``_halo``.

    The row after each row is then found within its range: one exchange, and
    no window over all rows.  The bounds are ids at approximate quantiles;
    their number follows the number of shuffle partitions.  After the last
    row comes the first (its halo has ``_turn`` 1).
    """
    spark = df.sparkSession
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.min(order).alias("first"), F.percentile_approx(order, shares, 10 * buckets).alias("at")).first()
    bounds = sorted({x for x in found.at or [] if x > found.first})
    side = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    literal = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    if blocks:
        # Two levels: bounds' blocks, then the bounds in the block.
        block = F.size(F.filter(literal([b[0] for b in blocks]), lambda x: x <= F.col(order)))
        inner = F.array(literal([]), *map(literal, blocks))
        within = F.size(F.filter(F.get(inner, block), lambda x: x <= F.col(order)))
        bucket = F.when(F.col(order).isNull(), F.lit(0)).otherwise(F.when(block == 0, F.lit(0)).otherwise((block - 1) * side + within))
        bound = F.array_contains(F.get(inner, block), F.col(order))
    else:
        bucket, bound = F.lit(0), F.lit(False)
    has_null = df.where(F.col(order).isNull()).limit(1).count() > 0
    first = F.col(order).isNull() if has_null or found.first is None else F.col(order) == F.lit(found.first)
    df = df.withColumn("_b", bucket)
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("turn"), F.lit(False).alias("halo"))
    left = F.when(F.coalesce(bound, F.lit(False)), F.struct((F.col("_b") - 1).alias("b"), F.lit(0).alias("turn"), F.lit(True).alias("halo")))
    last = F.when(first, F.struct(F.lit(len(bounds)).alias("b"), F.lit(1).alias("turn"), F.lit(True).alias("halo")))
    df = df.withColumn("_e", F.explode(F.array_compact(F.array(own, left, last))))
    df = df.withColumns({"_b": F.col("_e.b"), "_turn": F.col("_e.turn"), "_halo": F.col("_e.halo")}).drop("_e")
    return df, Window.partitionBy("_b").orderBy("_turn", F.col(order).asc_nulls_first())


def fingerprint_edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text has the last floor(n/2) code points replaced by the first
    as many (or all) of the next document in ascending doc_id.  A null text is
    empty; a null doc_id comes first; rows that share a doc_id follow one
    another by text; other columns are ignored.  An empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df, order = with_next(base, "doc_id")
    order = order.orderBy("_turn", F.col("doc_id").asc_nulls_first(), "text", "_halo")
    df = df.withColumn("_next", F.coalesce(F.lead("text").over(order), F.lit("")))
    df = with_fingerprint(df, "text", "_fp", k, w)
    df = df.withColumns({"_next_fp": F.lead("_fp").over(order)}).where(~F.col("_halo"))
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    df = df.withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("_next", F.lit(1), cut)))
    df = with_fingerprint(df, "_edited", "_efp", k, w)
    return df.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_string("_fp", "_fp_at").alias("fingerprint"),
        as_string("_efp", "_efp_at").alias("edited_fingerprint"),
        likeness("_fp", "_efp").alias("near_edited"),
        likeness("_fp", "_next_fp").alias("near_next"),
    )
