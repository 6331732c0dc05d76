"""Near-duplicate documents by b-bit MinHash.

Each document's set of 4-word shingles gets 128 minima.  Bands of four minima
find candidates; of each minimum the low four bits are kept, packed into eight
longs, whose agreement (corrected for chance) estimates the similarity of
candidates; full sets confirm what passes.  Links become components.

Documents of equal sets are one class and send one row.  In a bucket each
member is first compared with the least one only, so a group of copies costs
its size, not its square.  A second pass then compares, in buckets that still
hold several components, the members outside the least one's component with
all others: no link between components is lost, and none is tested inside one.
There 1024 minima tell apart what is just below the limit, each pair meets in
the first band that it shares, and what passes is within 4.5 standard
deviations of the limit or above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IdBitmap, as_bytes, hash_words, materialize, mix64, spread

BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
#: For the second pass: more minima, so that families of documents just below the limit are told apart by their bits.
FINE = 1024
#: Rows of a bucket that meet as many others in one task.
BLOCK = 256
_U = np.uint64


def _odd(n: int, salt: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt)) | _U(1)


def shingles(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; its whole sequence if it has fewer words."""
    words, at = hash_words(texts, lower=True)
    factor = _odd(size, 11)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - size + 1)
        total = np.full(n, size, dtype=_U)
        for j in range(size):
            total += words[j : j + n] * factor[j]
        whole = mix64(total)
        out = []
        for i in range(len(texts)):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= size:
                out.append(np.unique(whole[a : b - size + 1]))
            elif b > a:
                out.append(mix64(np.array([(words[a:b] * factor[: b - a]).sum(dtype=_U) + _U(b - a)], dtype=_U)))
            else:
                out.append(np.zeros(0, dtype=_U))
    return out


def _minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The least of each of n hashes over each of the sets, none of which is empty."""
    start = np.cumsum([0, *(len(s) for s in sets[:-1])])
    every = np.concatenate(sets)
    minima = np.empty((n, len(sets)), dtype=_U)
    for k, (a, b) in enumerate(zip(_odd(n, 1), _odd(n, 2), strict=True)):
        minima[k] = np.minimum.reduceat(every * a + b, start)
    return mix64(minima)


def _packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of each set's minima, as many to a long as fit."""
    low, per = minima & _U((1 << BITS) - 1), 64 // BITS
    packed = np.zeros((len(minima) // per, minima.shape[1]), dtype=_U)
    for j in range(per):
        packed |= low[j::per] << _U(BITS * j)
    return packed.T


def _sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of the minima of each of the sets."""
    minima = _minima(sets, MINIMA)
    bands = np.zeros((BANDS, len(sets)), dtype=_U)
    for r in range(ROWS):
        bands = mix64(bands + minima[r::ROWS])
    bands = mix64(bands + np.arange(BANDS, dtype=_U)[:, None])
    return bands.T, _packed(minima)


def _in_groups(sets: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of sets that aren't empty, in groups of bounded size (or of one)."""
    group: list[int] = []
    for i in range(len(sets)):
        if len(sets[i]):
            if group and sum(len(sets[g]) for g in group) + len(sets[i]) > 60_000:
                yield group
                group = []
            group.append(i)
    if group:
        yield group


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).view(np.int64).ravel()))


SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, bits array<long>"


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingles(as_bytes(part.column(1)), size)
                bands, bits = np.zeros((len(sets), BANDS), _U), np.zeros((len(sets), MINIMA * BITS // 64), _U)
                for group in _in_groups(sets):
                    bands[group], bits[group] = _sketches([sets[g] for g in group])
                key = [np.array([mix64(s ^ _U(salt)).sum(dtype=_U) if len(s) else _U(0) for s in sets], dtype=_U).view(np.int64) for salt in (3, 0x5851F42D4C957F2D)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(key[0]), pa.array(key[1]), _lists(bands), _lists(bits)], names=["doc_id", "n_shingles", "k1", "k2", "bands", "bits"])

    return run


def _fine(size: int):
    """More bits of some documents: ``doc_id``, ``fine``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingles(as_bytes(part.column(1)), size)
                bits = np.zeros((len(sets), FINE * BITS // 64), _U)
                for group in _in_groups(sets):
                    bits[group] = _packed(_minima([sets[g] for g in group], FINE))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(bits)], names=["doc_id", "fine"])

    return run


def _unequal(x: Column, y: Column) -> Column:
    """In how many fields two packed longs differ."""
    field = sum(1 << i for i in range(0, 64, BITS))
    x, shift = x.bitwiseXOR(y), BITS
    while shift > 1:
        shift //= 2
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
    return F.bit_count(x.bitwiseAND(F.lit(field - (1 << 64) if field >> 63 else field).cast("long")))


def estimate(a: str, b: str, minima: int = MINIMA) -> Column:
    """Similarity from packed low bits: the share of equal fields, less what chance gives."""
    if minima == MINIMA:
        differ = F.lit(0)
        for i in range(minima * BITS // 64):
            differ = differ + _unequal(F.col(a)[i], F.col(b)[i])
    else:  # too many to write out
        differ = F.aggregate(F.zip_with(a, b, _unequal), F.lit(0), lambda n, x: n + x)
    equal, chance = 1 - differ / minima, 2.0**-BITS
    return (equal - chance) / (1 - chance)


def _confirm(percent: int, size: int):
    """Pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                a, b = (shingles(as_bytes(part.column(c)), size) for c in ("ta", "tb"))
                good = []
                for x, y in zip(a, b, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    ids = pairs.select("a").union(pairs.select("b")).distinct()
    texts = IdBitmap(ids).keep(texts, "doc_id")
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(_confirm(percent, size), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (its least id) of every id in ``a``, ``b``: large and small stars in turn until nothing changes.

    Every round ends in the shared folder.  A hub of any degree is met by sums
    and by joins on its id with a table that was written, so its edges can be
    split over tasks.
    """
    edges = edges.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = materialize(large.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
        least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialize(small.where(F.col("a") != F.col("b")).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def in_blocks(rows: DataFrame, own: Column) -> tuple[DataFrame, DataFrame]:
    """Two sides of each ``key`` as a grid: rows where ``own`` holds, and all rows, dealt to blocks ``bx``, ``by`` of about ``BLOCK`` rows a side.

    However full a bucket is, no task has more than one block of its pairs.
    """
    counts = rows.groupBy("key").agg(F.ceil(F.count_if(own) / BLOCK).alias("_nx"), F.ceil(F.count("*") / BLOCK).alias("_ny"))
    counts = materialize(counts.where("_nx > 0"), "grid")
    rows = rows.join(counts, "key")
    dealt = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = rows.where(own).withColumn("bx", dealt("_nx", 1)).withColumn("by", each("_ny"))
    y = rows.withColumn("by", dealt("_ny", 2)).withColumn("bx", each("_nx"))
    return x.drop("_nx", "_ny"), y.drop("_nx", "_ny")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 4) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row.

    Words are runs of anything but white space, with A-Z in lower case.  Null
    and empty texts, and texts without words, have empty sets and are linked
    with nothing.  Rows that share a doc_id are one document, linked by each
    of its texts; a null doc_id is linked with nothing and kept.  Other
    columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialize(spread(texts).mapInArrow(_sketch(size), SKETCH), "sketches")
    full = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # Written, so that the join's sides are plain exchanges and a class of very many copies can be split.
    classes = materialize(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    members = full.join(classes, ["k1", "k2"])
    same = members.where(F.col("doc_id") > F.col("rep")).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    reps = materialize(members.where(F.col("doc_id") == F.col("rep")).select("doc_id", "n_shingles", "bands", "bits"), "reps")

    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where(F.col("least") < F.col("most"))
    shared = materialize(shared.select("key", "least"), "shared")
    buckets = materialize(banded.join(shared, "key").select("key", "band", "doc_id", "least"), "buckets")

    signed = reps.select("doc_id", "n_shingles", "bits")
    floor = percent / 100 - 0.19  # five standard deviations of the estimate

    def passing(pairs: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            pairs = pairs.join(signed.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("bits").alias(f"s{c}")), c)
        near = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate("sa", "sb") >= floor)
        return pairs.where(near).select("a", "b").distinct()

    stars = buckets.where(F.col("doc_id") > F.col("least")).select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    tested = materialize(passing(stars), "candidates")
    links = materialize(_confirmed(tested, texts, percent, size).union(same), "links")
    found = materialize(components(links), "components")

    # Second pass: buckets with members outside the component of their least one.
    label = lambda of, to: found.select(F.col("id").alias(of), F.col("component").alias(to))
    rows = buckets.join(label("doc_id", "own"), "doc_id", "left").withColumn("own", F.coalesce("own", "doc_id"))
    rows = rows.join(label("least", "main"), "least", "left").withColumn("main", F.coalesce("main", "least"))
    rows = materialize(rows.select("key", "band", "doc_id", "own", "main"), "labelled")
    outer = F.col("own") != F.col("main")
    mixed = rows.where(outer).select("key").distinct()
    every = materialize(rows.join(mixed, "key", "left_semi"), "mixed")
    ids = every.select("doc_id").distinct()
    fine = IdBitmap(ids).keep(texts, "doc_id").join(ids, "doc_id").select("doc_id", "text").mapInArrow(_fine(size), "doc_id long, fine array<long>")
    # With all keys of a document, the first band that two documents share can be told: there alone they are compared.
    bits = materialize(reps.select("doc_id", "n_shingles", "bits", "bands").join(ids, "doc_id").join(fine, "doc_id"), "fine")

    def side(df: DataFrame, a: str) -> DataFrame:
        df = df.join(bits, "doc_id")
        return df.select("key", "bx", "by", "band", F.col("doc_id").alias(a), F.col("own").alias(f"o{a}"), (~outer).alias(f"m{a}"), F.col("n_shingles").alias(f"n{a}"), F.col("bits").alias(f"s{a}"), F.col("fine").alias(f"f{a}"), F.col("bands").alias(f"b{a}_"))

    x, y = (side(df, a) for df, a in zip(in_blocks(every, outer), "xy", strict=True))
    y = y.drop("band")
    common = F.when(F.col("bx_")[0] == F.col("by_")[0], 0)
    for i in range(1, BANDS):
        common = common.when(F.col("bx_")[i] == F.col("by_")[i], i)
    near = (F.col("ox") != F.col("oy")) & (F.col("my") | (F.col("x") < F.col("y"))) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    near = near & (common == F.col("band")) & (estimate("sx", "sy") >= floor) & (estimate("fx", "fy", FINE) >= percent / 100 - 0.06)
    pairs = x.join(y, (x.key == y.key) & (x.bx == y.bx) & (x.by == y.by) & near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        links = links.union(materialize(_confirmed(more, texts, percent, size), "links"))
        found = materialize(components(links), "components")
    result = sketches.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
flat AS (SELECT doc_id, unnest(s) AS sh FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM flat a JOIN flat b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS x, a AS y FROM sym UNION SELECT reach.x, sym.b FROM reach JOIN sym ON reach.y = sym.a),
least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT doc_id, n AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM sizes LEFT JOIN least ON x = doc_id
"""
