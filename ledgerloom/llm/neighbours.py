"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by three rounds of random signs and the fast
Hadamard transform and assigns each to the nearest signed axis; several such
hashes are strung together, the last of them over as few axes as make buckets
of about ``fill`` rows, so buckets grow in number with the table, not in size.
A query looks into the buckets that lie nearest to it by all hashes together,
in every table; what it finds there is ranked by exact inner products.  How many
buckets that takes is measured: for a bounded sample of queries the exact
neighbours are found, and the least share of buckets is taken that holds the
recall asked for.  This is the same at every size.

Vectors of unequal length are hashed by direction in bands of similar length,
each with buckets of its own, and a query looks into every band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spread

DATA_BLOCK, QUERY_BLOCK = 4096, 1024
#: The longest vector of a level is at most so many times the shortest.
LEVEL = 1.25
#: Queries whose exact neighbours are found to measure how many buckets are needed.
SAMPLE = 100
#: Buckets that share their leading hashes are read together, as a cell; rows of a cell, where more than one hash names it.
CELL = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; its length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def polytopes(rows: int, width: int, fill: int) -> list[int]:
    """The axes (without signs) of each hash, so that ``rows`` have buckets of about ``fill``: all of them as often as it goes, then fewer."""
    bits, most, out = max(0, round(math.log2(max(1, rows) / fill))), width.bit_length(), []
    while bits > 0:
        out.append(1 << (min(bits, most) - 1))
        bits -= most
    return out


def axis_scores(x: np.ndarray, table: int, part: int, axes: int, seed: int) -> np.ndarray:
    """How near each row is to each of the signed axes after a rotation of its own for every table and hash."""
    rng = np.random.default_rng([seed, table, part])
    for signs in rng.choice([-1.0, 1.0], (3, x.shape[1])):
        x = hadamard(x * signs)
    return np.concatenate([x[:, :axes], -x[:, :axes]], axis=1)


def bucket_of(x: np.ndarray, parts: list[int], table: int, seed: int) -> np.ndarray:
    """The bucket of each row: its nearest signed axis of every hash."""
    bucket = np.zeros(len(x), dtype=np.int64)
    for i, axes in enumerate(parts):
        bucket = bucket * (2 * axes) + axis_scores(x, table, i, axes, seed).argmax(axis=1)
    return bucket


def cells_of(rows: int, parts: list[int]) -> int:
    """How many of the buckets' codes lie in one cell: the leading hashes, as many as leave cells of about ``CELL`` rows, name the cell."""
    inner, cells = math.prod(2 * axes for axes in parts), 1
    for i, axes in enumerate(parts):
        if i and cells * 2 * axes * CELL > rows:
            break
        cells, inner = cells * 2 * axes, inner // (2 * axes)
    return inner


def nearest_buckets(x: np.ndarray, parts: list[int], table: int, seed: int, n: int) -> np.ndarray:
    """For each row the n nearest buckets, nearest first, by how much less each hash's axis is met than the best one.

    The costs of the hashes add up, so the n best so far are all that the next hash needs.
    """
    cost, bucket = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
    for i, axes in enumerate(parts if len(x) else []):
        scores = axis_scores(x, table, i, axes, seed)
        more = (scores.max(axis=1, keepdims=True) - scores) ** 2
        costs, buckets = [], []
        step = max(1, 2_000_000 // (cost.shape[1] * 2 * axes))
        for at in range(0, len(x), step):
            own = (cost[at : at + step, :, None] + more[at : at + step, None, :]).reshape(len(more[at : at + step]), -1)
            code = (bucket[at : at + step, :, None] * (2 * axes) + np.arange(2 * axes)).reshape(len(own), -1)
            best = np.argsort(own, axis=1, kind="stable")[:, :n]
            costs.append(np.take_along_axis(own, best, 1))
            buckets.append(np.take_along_axis(code, best, 1))
        cost, bucket = np.concatenate(costs), np.concatenate(buckets)
    return bucket


def _valid(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.where(F.col(id_col).isNotNull() & F.forall(vector, number) & F.exists(vector, lambda x: x != 0))
    kind = "array<float>" if df.schema[vector].dataType.elementType.typeName() == "float" else "array<double>"
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))


def _bands(levels: list[tuple[int, int]], least: int) -> tuple[list[int], list[int]]:
    """The first level and the rows of each band, from levels in order with their rows: neighbours are one band while they have at most ``least`` rows."""
    first, rows = [], []
    for level, n in levels:
        if rows and rows[-1] + n <= least:
            rows[-1] += n
        else:
            first.append(level)
            rows.append(n)
    return first, rows


def _best(k: int, kind: str):
    """The k nearest of a block for each query in it, of the codes that the query looks at."""

    def group(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        query, ids = (block.column(c).to_numpy() for c in ("query", "id"))
        codes = block.column("codes").chunk(0)
        v = np.frombuffer(b"".join(block.column("v").to_pylist()), dtype=kind).reshape(len(ids), -1).astype(np.float64)
        code, row = codes.flatten().to_numpy(), np.repeat(np.arange(len(ids)), codes.value_lengths().to_numpy())
        order = np.lexsort((row, code))
        code, row = code[order], row[order]
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = row[a:b]
            asked, at = mine[query[mine]], mine[~query[mine]]
            if len(asked) and len(at):
                r, c, score = nearest_of(v[asked], ids[asked], v[at], ids[at], k)
                found.append((asked[r], at[c], score))
        r, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(found) > 2:  # of several codes the k nearest are taken again
            order = np.lexsort((ids[c], -score, r))
            r, c, score = r[order], c[order], score[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, c, score = r[keep], c[keep], score[keep]
        return pa.table({"query_id": ids[r], "vec_id": ids[c], "score": score})

    return group


def nearest_of(q: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, number of the row, and score, of the k rows of largest product for each query, itself left out."""
    s = q @ x.T
    s[qids[:, None] == ids[None, :]] = -np.inf
    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else s.min(axis=1)
    slack = 1e-12 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
    r, c = np.nonzero((s >= (least - slack)[:, None]) & np.isfinite(s))
    score = (q[r] * x[c]).sum(axis=1)
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], score[keep]


def _ranked(rows: DataFrame, k: int, kind: str) -> DataFrame:
    """Rows of ``cell``, ``query``, ``id``, ``codes``, ``v``: each cell is a grid of blocks of bounded size, however full it is."""
    counts = rows.groupBy("cell").agg(F.count_if(~F.col("query")).alias("_n"), F.count_if("query").alias("_q"))
    counts = counts.where((F.col("_n") > 0) & (F.col("_q") > 0)).select("cell", F.ceil(F.col("_n") / DATA_BLOCK).alias("_n"), F.ceil(F.col("_q") / QUERY_BLOCK).alias("_q"))
    rows = rows.join(counts, "cell")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("query"), F.col("_q")).otherwise(F.col("_n")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("query"), F.col("_n")).otherwise(F.col("_q")) - 1)))
    rows = rows.withColumns({"_x": F.when(F.col("query"), F.col("_other")).otherwise(mine), "_y": F.when(F.col("query"), mine).otherwise(F.col("_other"))})
    found = rows.select("cell", "_x", "_y", "query", "id", "codes", "v").groupBy("cell", "_x", "_y").applyInArrow(_best(k, kind), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _bytes(x: np.ndarray) -> pa.Array:
    """Each row's numbers as bytes."""
    size = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


ROWS = "cell long, query boolean, id long, codes array<int>, v binary"


def _rows(cell: np.ndarray, query: bool, ids: np.ndarray, codes: pa.ListArray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(cell), 8192):  # vectors take room
        part = slice(at, at + 8192)
        yield pa.RecordBatch.from_arrays([pa.array(cell[part], pa.int64()), pa.array(np.full(len(cell[part]), query)), pa.array(ids[part], pa.int64()), codes.slice(at, 8192), _bytes(x[part])], names=["cell", "query", "id", "codes", "v"])


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, pa.int32()))


class Index:
    """Bands by length, the hashes of each, and where its buckets begin."""

    def __init__(self, first: list[int], rows: list[int], width: int, tables: int, fill: int, seed: int):
        self.first, self.width, self.seed = first, width, seed
        self.parts = [polytopes(n, width, fill) for n in rows]
        self.buckets = [math.prod(2 * axes for axes in p) for p in self.parts]
        self.tables = [tables if p else 1 for p in self.parts]
        #: Codes in a cell, and where the cells of each band begin.
        self.inner = [cells_of(n, p) for n, p in zip(rows, self.parts, strict=True)]
        self.cells = [b // i for b, i in zip(self.buckets, self.inner, strict=True)]
        self.begin = np.cumsum([0, *(t * c for t, c in zip(self.tables, self.cells, strict=True))])

    def unit(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        out = np.zeros((len(x), self.width))
        out[:, : x.shape[1]] = x / np.abs(x).max(axis=1, keepdims=True)
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def bands(self, levels: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, levels, side="right") - 1

    def share(self, queries: np.ndarray, near: list[tuple[int, int, list[int]]], recall: float) -> float:
        """The least share of buckets that holds ``recall`` of ``near``: a query's number, the band of a neighbour, its buckets in all tables."""
        if not near:
            return 0.0
        best, n = np.full(len(near), np.inf), 64
        q, band = (np.array([x[i] for x in near]) for i in (0, 1))
        while True:
            for b in np.unique(band[np.isinf(best)]):
                mine = np.flatnonzero(np.isinf(best) & (band == b))
                asked, which = np.unique(q[mine], return_inverse=True)
                ranks = []
                for t in range(self.tables[b]):
                    order = nearest_buckets(queries[asked], self.parts[b], t, self.seed, n)
                    hit = order[which] == np.array([near[i][2][t] for i in mine])[:, None]
                    ranks.append(np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, np.inf))
                best[mine] = np.min(ranks, axis=0) / self.buckets[b]
            found = np.sort(best)[math.ceil(recall * len(best)) - 1]
            if np.isfinite(found):
                return float(found)
            n *= 4


def nearest(df: DataFrame, every: int = 20, k: int = 20, tables: int = 8, recall: float = 0.95, fill: int = 64, least: int = 8192, seed: int = 7, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest found for each row whose id is divisible by ``every``.

    Vectors that are null, zero, or hold null or non-finite numbers take no
    part, nor do those of another length than most; rows that share an id are
    one candidate with its best score, and never their own neighbour.  Where
    lengths (norms) are unequal, neighbouring levels of length are one band
    while they have at most ``least`` rows.  ``recall`` of the neighbours of
    ``SAMPLE`` queries lie in the buckets that every query looks into; what
    that takes follows from the vectors alone.  A query that finds fewer than
    k is compared with all rows, in blocks.  An empty table gives an empty result.
    """
    valid = _valid(df, id_col, vector)
    kind = "<f4" if "float" in valid.schema["v"].dataType.simpleString() else "<f8"
    largest = F.array_max(F.transform("v", F.abs)).cast("double")
    norm = F.log(largest) + F.log(F.aggregate(F.transform("v", lambda x: x / largest), F.lit(0.0), lambda a, x: a + x * x)) / 2
    sizes = valid.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("most")).orderBy(F.col("n").desc(), "d").first()
    d, most = (sizes.d, sizes.most) if sizes else (1, 0.0)
    valid = valid.where(F.size("v") == d).withColumn("level", F.floor((F.lit(most) - norm) / math.log(LEVEL) + 1e-6).cast("long"))
    first, rows = _bands(sorted(map(tuple, valid.groupBy("level").count().collect())), least)
    index = Index(first, rows, 1 << max(0, (d - 1).bit_length()), tables, fill, seed)

    sample = valid.where(F.col("id") % every == 0).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    wanted, ids_of = np.array([r.v for r in sample], dtype=kind).reshape(-1, d), np.array([r.id for r in sample], dtype=np.int64)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest of all rows of the task for each query of the sample, with their buckets."""
        q, kept = wanted.astype(np.float64), None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, ids, level = _matrix(part), part.column(0).to_numpy(), part.column(2).to_numpy()
                r, c, score = nearest_of(q, ids_of, x.astype(np.float64), ids, k)
                new = (r, score, ids[c], level[c], x[c])
                kept = new if kept is None else tuple(np.concatenate(pair) for pair in zip(kept, new, strict=True))
                order = np.lexsort((kept[2], -kept[1], kept[0]))
                kept = tuple(y[order] for y in kept)
                best = np.arange(len(order)) - np.searchsorted(kept[0], kept[0]) < k
                kept = tuple(y[best] for y in kept)
        if kept is not None and len(kept[0]):
            band, unit = index.bands(kept[3]), index.unit(kept[4])
            buckets = np.zeros((len(band), tables), dtype=np.int64)
            for b in np.unique(band):
                for t in range(index.tables[b]):
                    buckets[band == b, t] = bucket_of(unit[band == b], index.parts[b], t, seed)
            yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1]), pa.array(kept[2]), pa.array(band), pa.array(buckets.tolist(), pa.list_(pa.int64()))], names=["q", "score", "id", "band", "buckets"])

    if len(sample):
        near = spread(valid).mapInArrow(exact, "q long, score double, id long, band long, buckets array<long>")
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
        near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
        share = index.share(index.unit(wanted), [(r.q, r.band, r.buckets) for r in near.collect()], recall)
    else:
        share = 0.0
    probes = [max(1, math.ceil(share * n - 1e-9)) for n in index.buckets]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, x = part.column(0).to_numpy(), _matrix(part)
                band, unit, asked = index.bands(part.column(2).to_numpy()), index.unit(x), ids % every == 0
                for b in range(len(index.parts)):
                    mine = band == b
                    for t in range(index.tables[b]):
                        begin, inner = index.begin[b] + t * index.cells[b], index.inner[b]
                        bucket = bucket_of(unit[mine], index.parts[b], t, seed)
                        yield from _rows(begin + bucket // inner, False, ids[mine], _lists(bucket % inner, np.arange(len(bucket))), x[mine])
                        looks = np.sort(nearest_buckets(unit[asked], index.parts[b], t, seed, probes[b]), axis=1)
                        if not looks.size:
                            continue
                        # One row for each cell that a query looks into.
                        cell = looks // inner
                        new = np.concatenate([np.ones((len(cell), 1), bool), cell[:, 1:] != cell[:, :-1]], axis=1)
                        starts = np.flatnonzero(new.ravel())
                        who = np.flatnonzero(asked)[starts // looks.shape[1]]
                        yield from _rows(begin + cell.ravel()[starts], True, ids[who], _lists((looks % inner).ravel(), starts), x[who])

    table = materialize(spread(valid).mapInArrow(hashed, ROWS), "tables")
    best = materialize(_ranked(table, k, kind), "neighbours")
    asked = valid.where(F.col("id") % every == 0).select("id").distinct()
    short = asked.join(best.groupBy(F.col("query_id").alias("id")).count(), "id", "left").where(F.coalesce("count", F.lit(0)) < k).select("id")
    short = materialize(short, "short")
    if short.isEmpty():
        return best

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            yield from _rows(np.zeros(n, np.int64), False, batch.column(0).to_numpy(), _lists(np.zeros(n, np.int64), np.arange(n)), _matrix(batch))

    every_row = spread(valid).mapInArrow(together, ROWS)
    looked = every_row.join(short, "id", "left_semi").withColumn("query", F.lit(True)).select("cell", "query", "id", "codes", "v")
    return best.join(short, best.query_id == short.id, "left_anti").unionByName(_ranked(every_row.unionByName(looked), k, kind))
