"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is parsed against all documents of smaller id.  The reference
has each block of words once, at its first place.  Blocks are cut by content:
of the 43 runs of eight words in each window of 50, the one of least hash
(rightmost on ties) is its anchor, and a block is the words of all neighbouring
windows with one anchor.  Equal windows have equal anchors, so only documents
that share an anchor can share a window, and no window lies across two blocks.

The parse goes through a document from the left.  A factor begins at the first
window that the reference has, and takes block after block, each of which has
one place there, as long as the places follow on one another in the same source:
as the reference has no block twice, that is the longest match.  Blocks at a
factor's boundary, whose anchor is shared but whose words differ, are checked
and followed window by window.  A factor says where its words stand in its
source.  Factors have at least 50 words, and what they cover are the duplicate
spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, IdBitmap, _powers, as_bytes, hash_words, materialize, mix64, spread

ANCHOR = 8
_U = np.uint64
_SLICE = 1 << 18


def _rightmost_least(g: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of the least one, rightmost on ties."""
    value, place, size = g, np.arange(len(g)), 1
    while size < w:
        step = min(size, w - size)
        left, right = value[:-step], value[step:]
        later = right <= left
        value, place = np.where(later, right, left), np.where(later, place[step:], place[:-step])
        size += step
    return place


class Blocks:
    """Blocks of consecutive words of several documents: anchor hash, hash of the words, first and last window."""

    def __init__(self, words: np.ndarray, window: int):
        self.words, self.window = words, window
        up, self.down = _powers(len(words) + 1)
        self.total = np.concatenate([[_U(0)], np.cumsum(words * up[: len(words)], dtype=_U)])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(_U) * _U(0x632BE59BD9B4E019))

    def find(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, anchor, words' hash, first and last window (places in ``words``) of every block."""
        n, w = len(self.words), self.window
        none = np.zeros(0, np.int64)
        if n < w:
            return none, none, none, none, none
        factor = mix64(np.arange(1, ANCHOR + 1, dtype=_U)) | _U(1)
        grams = np.zeros(n - ANCHOR + 1, dtype=_U)
        for j in range(ANCHOR):
            grams += self.words[j : j + len(grams)] * factor[j]
        grams = mix64(grams)
        anchor = _rightmost_least(grams, w - ANCHOR + 1)
        doc = np.searchsorted(at, np.arange(len(anchor)), side="right") - 1
        inside = np.arange(len(anchor)) + w <= at[doc + 1]
        start = np.flatnonzero(inside)
        if not len(start):
            return none, none, none, none, none
        a, d = anchor[start], doc[start]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (start[1:] != start[:-1] + 1)]))
        lo, hi = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
        return d[new], grams[a[new]].view(np.int64), self.hash(lo, hi + w).view(np.int64), lo, hi


def _slices(texts: list[bytes | None], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words in slices of bounded length: word hashes, bounds of the documents in them, documents' numbers, words before.

    A long document comes in several slices, of which each has the words that its last windows need.
    """
    words, at = hash_words(texts)
    group: list[tuple[int, int, int]] = []
    total = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        bounds = np.cumsum([0, *(b - a for _, a, b in group)])
        return np.concatenate([words[a:b] for _, a, b in group]), bounds, np.array([d for d, _, _ in group]), np.array([a - at[d] for d, a, _ in group])

    for d in range(len(texts)):
        a, b = int(at[d]), int(at[d + 1])
        while b - a >= window:
            end = min(b, a + _SLICE)
            if total + end - a > _SLICE and group:
                yield flush()
                group, total = [], 0
            group.append((d, a, end))
            total += end - a
            a = end - window + 1 if end < b else b
    if group:
        yield flush()


BLOCK = "doc_id long, t long, a long, c long, lo int, hi int"


def _blocks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for words, bounds, docs, before in _slices(as_bytes(part.column(2)), window):
                    d, a, c, lo, hi = Blocks(words, window).find(bounds)
                    own, base = pa.array(docs[d]), (before - bounds[:-1])[d]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(a), pa.array(c), pa.array(lo + base, pa.int32()), pa.array(hi + base, pa.int32())], names=["doc_id", "t", "a", "c", "lo", "hi"])

    return run


def _windows(window: int):
    """The hash of every window of the blocks listed beside each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for i in range(batch.num_rows):
                words, _ = hash_words(as_bytes(batch.column("text").slice(i, 1)))
                blocks = batch.column("blocks")[i].as_py()
                start = np.concatenate([np.arange(b["lo"], b["hi"] + 1) for b in blocks])
                anchor = np.repeat(np.array([b["a"] for b in blocks], np.int64), [b["hi"] - b["lo"] + 1 for b in blocks])
                order = np.argsort(start, kind="stable")
                start, anchor, h = start[order], anchor[order], []
                first = 0
                while first < len(start):  # again in slices
                    base = start[first]
                    last = np.searchsorted(start, base + _SLICE)
                    own = Blocks(words[base : start[last - 1] + window], window)
                    h.append(own.hash(start[first:last] - base, start[first:last] - base + window).view(np.int64))
                    first = last
                n = len(start)
                ids = [pa.array([batch.column(c)[i].as_py()] * n, k) for c, k in (("doc_id", pa.int64()), ("t", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(anchor), pa.array(np.concatenate(h)), pa.array(start, pa.int32())], names=["doc_id", "t", "a", "w", "start"])

    return run


def matches(texts: DataFrame, window: int) -> DataFrame:
    """``doc_id``, ``t`` (a hash of the text), ``runs``: windows that smaller documents have, each run with the source and the place of its first window there.

    Of several equal places within one source any may be named.
    """
    blocks = materialize(spread(texts).where(F.col("doc_id").isNotNull()).mapInArrow(_blocks(window), BLOCK), "blocks")
    source = (F.min("doc_id").alias("d0"), F.min_by("lo", "doc_id").alias("p0"))
    anchors = blocks.groupBy("a").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), *source, F.max("doc_id").alias("d1"))
    # What is joined with is written first: both sides are then plain exchanges, and partitions of a very common anchor can be split.
    anchors = materialize(anchors.where(F.col("d0") < F.col("d1")).select("a", (F.col("c0") == F.col("c1")).alias("one"), "d0", "p0"), "anchors")
    shared = materialize(blocks.join(anchors, "a"), "blocks")
    run = lambda df, lo, hi: df.select("doc_id", "t", F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.col("d0").alias("source"), F.col("p0").alias("place")).alias("run"))
    interior = shared.where(F.col("one") & (F.col("doc_id") > F.col("d0")))
    mixed = shared.where(~F.col("one")).drop("d0", "p0")
    first = materialize(mixed.groupBy("a", "c").agg(*source), "first")
    mixed = materialize(mixed.join(first, ["a", "c"]), "boundaries")
    # Of blocks with equal words the least document alone is looked into; the others have them from it.
    edge = mixed.where(F.col("doc_id") == F.col("d0")).groupBy("doc_id", "t").agg(F.collect_list(F.struct("lo", "hi", "a")).alias("blocks"))
    edge = materialize(edge, "edges")
    wanted = IdBitmap(edge.select("doc_id")).keep(texts, "doc_id").dropDuplicates(["doc_id", "t"])
    windows = materialize(wanted.join(edge, ["doc_id", "t"]).mapInArrow(_windows(window), "doc_id long, t long, a long, w long, start int"), "windows")
    seen = windows.groupBy("a", "w").agg(F.min("doc_id").alias("d0"), F.min_by("start", "doc_id").alias("p0"), F.max("doc_id").alias("d1"))
    seen = materialize(seen.where(F.col("d0") < F.col("d1")).drop("d1"), "seen")
    single = windows.join(seen, ["a", "w"]).where(F.col("doc_id") > F.col("d0"))
    runs = run(interior, "lo", "hi").union(run(mixed.where(F.col("doc_id") > F.col("d0")), "lo", "hi")).union(run(single, "start", "start"))
    return runs.groupBy("doc_id", "t").agg(F.collect_list("run").alias("runs"))


_FIND = re.compile(WORD)


Run = tuple[int, int, int, int]


def parse(runs: list[Run], window: int) -> list[Run]:
    """Factors (from, to, source, place; words [from, to) stand at ``place`` in ``source``) from runs of windows (first, last, source, place).

    From left to right, a factor takes the next run as long as that follows on
    the last, in the document and in the source.
    """
    out: list[Run] = []
    for lo, hi, source, place in sorted(set(runs)):
        if out and lo == out[-1][1] - window + 1 and source == out[-1][2] and place - lo == out[-1][3] - out[-1][0]:
            out[-1] = (out[-1][0], hi + window, source, out[-1][3])
        else:
            out.append((lo, hi + window, source, place))
    return out


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans: ranges in order that overlap or touch, put together."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


CLEANED = "factors array<struct<from:int,to:int,source:bigint,place:int>>, spans array<struct<from:int,to:int>>, n_words long, n_removed long, cleaned string"


def _cut(window: int):
    span = [("from", pa.int32()), ("to", pa.int32())]
    kinds = [pa.list_(pa.struct([*span, ("source", pa.int64()), ("place", pa.int32())])), pa.list_(pa.struct(span)), pa.int64(), pa.int64(), pa.string()]

    def cut(text: str | None, runs: list[dict] | None) -> tuple:
        if not runs:
            return [], [], count_words(text or ""), 0, text
        starts = [m.start() for m in _FIND.finditer(text)]
        starts.append(len(text))
        factors = parse([(r["lo"], r["hi"], r["source"], r["place"]) for r in runs], window)
        spans, parts, done = merge([f[:2] for f in factors]), [], 0
        for a, b in spans:
            parts.append(text[done : starts[a]])
            done = starts[b]
        parts.append(text[done:])
        named = [dict(zip(("from", "to", "source", "place"), f, strict=True)) for f in factors]
        return named, [{"from": a, "to": b} for a, b in spans], len(starts) - 1, sum(b - a for a, b in spans), "".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [cut(*x) for x in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["row", "factors", "spans", "n_words", "n_removed", "cleaned"])

    return run


#: White space to str.split() that belongs to words here.
_ODD = re.compile(r"[\x1c-\x1f]")


def count_words(text: str) -> int:
    return len(text.split()) if text.isascii() and not _ODD.search(text) else sum(1 for _ in _FIND.finditer(text))


def remove_duplicates(docs: DataFrame, window: int = 50, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry``, ``factors`` (word ranges, each with its source and place there), ``spans`` (what they cover), ``n_words``, ``n_removed``, ``cleaned`` for every row.

    A span goes from its first word to the next word that stays; all else of
    the text stays as it was.  Null and empty texts have no words and stay as
    they are; a null doc_id is neither smaller nor larger than any, so its
    text stays; rows that share a doc_id don't take words from each other, and
    a source with several texts may mean any of them; other columns are
    ignored; an empty table gives an empty result.
    """
    row = F.struct(*(F.col(c) for c in carry)).alias("row")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"), row)
    runs = materialize(matches(texts.select("doc_id", "t", "text"), window), "runs")
    bitmap = IdBitmap(runs.select("doc_id"))
    touched = bitmap.keep(texts, "doc_id").join(runs, ["doc_id", "t"], "left").select("row", "text", "runs")
    alone = bitmap.keep(texts, "doc_id", others=True).select("row", "text", F.lit(None).cast(touched.schema["runs"].dataType).alias("runs"))
    schema = f"row {touched.schema['row'].dataType.simpleString()}, {CLEANED}"
    found = touched.mapInArrow(_cut(window), schema).union(alone.mapInArrow(_cut(window), schema))
    return found.select("row.*", "factors", "spans", "n_words", "n_removed", "cleaned")


def digests(docs: DataFrame) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("cleaned", F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    found = remove_duplicates(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50)
), firsts AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS d FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM firsts WHERE d < doc_id),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id)
"""
