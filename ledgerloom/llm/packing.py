"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are powers of two: as
many full sequences as fit, then the binary digits of the rest, longest first.
Each piece is a sequence of its own, so none crosses documents and none is
padded; sequences of one length are numbered together, as a bucket.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, locate_words, process_cache, scratch, spread

#: A character that is an id of its own, between words that are encoded together.
_BETWEEN = "\x01"
#: Words remembered in each of two generations.
_MEMO = 200_000
#: ASCII characters that are neither letters nor digits nor white space; letters and digits never join with them.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


#: The steps before the model of the tokenizer that Encoder takes apart.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class WholeTexts:
    """Ids of texts in UTF-8 by all steps of any tokenizer."""

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode("utf-8"))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(texts), 64):
            part = [(t or b"").decode("utf-8") for t in texts[at : at + 64]]
            out += [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out


def encoder_of(definition: bytes) -> WholeTexts | Encoder:
    """Word by word where the tokenizer's steps are those that allow it, else whole texts."""
    found = json.loads(definition)
    model = found.get("model") or {}
    apart = all(found.get(k) == v for k, v in STEPS.items()) and model.get("type") == "BPE" and not model.get("dropout") and all(t["content"].startswith("<|") for t in found.get("added_tokens", []))
    return (Encoder if apart else WholeTexts)(definition)


class Encoder:
    """Ids of texts in UTF-8, for a tokenizer of the steps in STEPS.

    The tokenizer drops ASCII white space and joins nothing across it, so ids
    are those of the words between.  New words are encoded many at a time:
    words of letters alone, with marks after them or not, by the tokenizer's
    model in place of all its steps (they are one piece each, in lower case),
    any others by all steps.  Words are remembered by their 64-bit hash in
    two generations: of what was used since the last change of generations
    nothing is forgotten, and memory stays bounded.  That two of a million
    words share a hash has a probability of 3e-8.
    """

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        text = definition.decode("utf-8")
        self.whole = Tokenizer.from_str(text)
        self.model = Tokenizer.from_str(json.dumps(json.loads(text) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}))
        self.character = byte_characters()
        self.young: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        (self.between,) = self.whole.encode(f" {_BETWEEN} ", add_special_tokens=False).ids

    def _one(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _together(self, tokenizer, words: list[str], between: str) -> list[bytes] | None:
        """Ids of each word; None if a word has the id that stands between them."""
        ids = np.array(tokenizer.encode_batch_fast([f" {between} ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(ids == self.between)
        if len(cuts) != len(words) - 1:
            return None
        raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
        return [raw[a:b] for a, b in zip([0, *(x + 4 for x in ends[:-1])], ends, strict=True)]

    def _plain(self, core: str) -> str | None:
        """Letters as the model has them, for letters beyond ASCII; None if all steps are needed."""
        if not core.isalpha() or "Σ" in core or "İ" in core or not is_normalized("NFC", core):
            return None
        return "".join([self.character[b] for b in core.lower().encode()])

    def _learn(self, words: list[tuple[int, bytes]]) -> None:
        plain, other = [], []
        for h, w in words:
            text = w.decode("utf-8")
            core = text.rstrip(_MARKS)
            letters = (core.lower() if core.isalpha() else None) if core.isascii() else self._plain(core)
            if letters is None:
                other.append((h, text))
            else:
                plain.append((h, letters, text[len(core) :]))
        cores, known = list({core for _, core, _ in plain}), {}
        for at in range(0, len(cores), 512):
            part = cores[at : at + 512]
            ids = self._together(self.model, part, self.character[ord(_BETWEEN)])
            known.update(zip(part, ids or [np.array(self.model.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in part], strict=True))
        for marks in {m for *_, m in plain} - self.marks.keys():
            self.marks[marks] = self._one(marks)
        self.young.update((h, known[core] + self.marks[marks]) for h, core, marks in plain)
        if len(self.marks) > 10_000:
            self.marks = {"": b""}
        for at in range(0, len(other), 512):
            part = other[at : at + 512]
            ids = self._together(self.whole, [text for _, text in part], _BETWEEN) or [self._one(text) for _, text in part]
            self.young.update(zip((h for h, _ in part), ids, strict=True))

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        # The tokenizer takes marks after a letter or digit for a piece of their own, and all letters in lower case; but special
        # strings, which start with these two marks, it knows only as they are.
        plain = not any(t and b"<|" in t for t in texts)
        buf, starts, ends, hashes, at = locate_words(texts, lower=plain, marks=plain)
        kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.young) > _MEMO:
            self.young, self.old = {}, self.young
        kinds, young, old = kinds.tolist(), self.young, self.old
        new = [i for i, h in enumerate(kinds) if h not in young]
        young.update((kinds[i], old[kinds[i]]) for i in new if kinds[i] in old)
        self._learn([(kinds[i], buf[starts[first[i]] : ends[first[i]]]) for i in new if kinds[i] not in old])
        values = [young[h] for h in kinds]
        pool = np.frombuffer(b"".join(values), dtype="<u4")
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        begin = np.cumsum(size) - size
        n = size[which]
        last = np.cumsum(n)
        ids = pool[np.repeat(begin[which] - (last - n), n) + np.arange(last[-1] if len(last) else 0)]
        bounds = np.concatenate([[0], last])[at]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def cut(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    lengths = [longest] * (n // longest)
    rest, bit = n % longest, longest >> 1
    while rest:
        if rest & bit:
            lengths.append(bit)
            rest ^= bit
        bit >>= 1
    return lengths


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, if asked for, ``ids``.

    A null or empty text is the end id alone; repeated rows are packed as
    often as they occur, each in sequences of its own; a null doc_id stays
    null; other columns are ignored; an empty table gives an empty result.
    Pieces are written to the shared folder with their place among the pieces
    of their length and task, so the numbers given afterwards are final.
    """
    assert longest & (longest - 1) == 0, "longest is a power of two"
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(Path(tokenizer or default_tokenizer()).read_bytes())
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, place long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = process_cache("encoder")
        key = zlib.crc32(definition.value)
        if key not in cache:
            cache.clear()
            cache[key] = encoder_of(definition.value)
        encoder, task, count = cache[key], TaskContext.get().partitionId(), dict.fromkeys((1 << b for b in range(longest.bit_length())), 0)
        tail = np.array([end_id], dtype="<u4")
        np.seterr(over="ignore")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(as_bytes(part.column(1))), strict=True):
                    ids = np.concatenate([ids, tail])
                    n, start = len(ids), 0
                    for length in cut(n, longest):
                        piece = ids[start : start + length]
                        rows.append((doc, start, length, zlib.crc32(piece), n, task, count[length], *([piece.view("<i4")] * with_ids)))
                        count[length] += 1
                        start += length
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place", "ids"][: 7 + with_ids])

    path = scratch(spark, "pieces")
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows.mapInArrow(pieces, schema).write.parquet(path)
    found = spark.read.schema(schema).parquet(path)
    # One row per length and task: numbers of sequences before it, lengths one after another.
    counts = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.col("length").desc(), "task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("length").alias("_l"), F.col("task").alias("_t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    numbered = found.join(counts, (F.col("length") == F.col("_l")) & (F.col("task") == F.col("_t")))
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_before") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)
