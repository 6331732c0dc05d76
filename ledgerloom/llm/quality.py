"""Quality classifier: a sparse rule ensemble over statistics of the text.

Paths of boosted trees become conjunctive rules; a lasso logistic regression
keeps few of them; those that are left are compiled into one column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import learning
from .common import as_bytes, held_out, labelled, spread

LABELLED = 12_000
STATISTICS = ("n_words", "mean_word", "distinct", "repeated", "upper", "digit", "symbol", "stop", "bang", "bar", "high", "lines", "same_lines", "ends_alpha", "capital", "longest")
_KIND = np.zeros(256, dtype=np.uint8)
for _c in range(256):
    _KIND[_c] = 1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if _c in b" \t\n\x0b\x0c\r" else 5 if _c in b".,;:'\"?" else 6 if _c == 33 else 7 if _c == 124 else 8 if _c >= 128 else 9


def statistics(text: bytes) -> tuple[float, ...]:
    """Numbers that describe one whole text; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    kinds = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=10)
    solid = max(1, len(text) - int(kinds[4]))
    letters = max(1, int(kinds[1] + kinds[2]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = sum(1 for w in words if w[-1:].isalnum() or w[-1] >= 128)
    return (
        float(n), solid / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n, kinds[2] / letters, kinds[3] / solid, kinds[9] / solid, kinds[5] / n, kinds[6] / n, kinds[7] / n,
        kinds[8] / solid, float(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), ends / n, sum(1 for w in words if w[:1].isupper()) / n, float(max(map(len, words))),
    )


def with_statistics(df: DataFrame, text: str, *kept: str) -> DataFrame:
    """``kept`` columns and the statistics of the text column; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t or b"") for t in as_bytes(batch.column(batch.num_columns - 1))], dtype=np.float64).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.ascontiguousarray(c)) for c in values.T)], names=[*kept, *STATISTICS])

    chosen = df.select(*kept, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), *(f"{s} double" for s in STATISTICS)])
    return spread(chosen).mapInArrow(run, kinds)


@dataclass(frozen=True)
class Rules:
    """A constant, and rules with their weights: conjunctions of (statistic's number, "<=" or ">", bound)."""

    constant: float
    rules: tuple[tuple[tuple[learning.Condition, ...], float], ...]

    def expression(self) -> Column:
        """The score from 0 to 1, of columns named as in STATISTICS."""
        z = F.lit(self.constant)
        for path, weight in self.rules:
            holds = None
            for f, op, bound in path:
                c = F.col(STATISTICS[f]) <= bound if op == "<=" else F.col(STATISTICS[f]) > bound
                holds = c if holds is None else holds & c
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", limit: int = LABELLED, trees: int = 30, depth: int = 3, strength: float = 4e-4) -> Rules:
    """Learn from at most ``limit`` labelled rows that aren't held out; without labels of both kinds the score is their share."""
    sample = with_statistics(labelled(docs, labels, column, limit), "text", "y").toPandas().sort_values([*STATISTICS, "y"])
    x, y = sample[list(STATISTICS)].to_numpy(), (sample["y"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return Rules(20.0 if len(y) and y[0] else -20.0, ())
    paths = learning.tree_paths(x, y, trees, depth)
    matrix = np.stack([np.all([x[:, f] <= b if op == "<=" else x[:, f] > b for f, op, b in p], axis=0) for p in paths], axis=1).astype(np.float32)
    w = learning.lasso(matrix, y.astype(np.float32), strength)
    return Rules(float(w[-1]), tuple((p, float(v)) for p, v in zip(paths, w[:-1], strict=True) if abs(v) > 1e-6))


def classified(docs: DataFrame, labels: DataFrame, column: str = "quality", bound: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row.

    Null and empty texts are scored as texts without words; a null doc_id is
    not held out; repeated rows score alike; no other column is looked at; an
    empty table gives an empty result.
    """
    rules = fit(docs, labels, column)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_statistics(ids, "text", "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), rules.expression().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= bound).cast("int"))
