"""A corpus from ``documents``: toxic texts go, near copies go, repeated passages go, sources are mixed, ids are packed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, near_duplicates, packing, substrings, toxicity
from ledgerloom.llm.common import IdBitmap, materialize, read


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def _numbered(docs: DataFrame, *but: str) -> tuple[list[Column], list[str]]:
    """The columns under names that no table has, and these names."""
    names = [f"_column_{i}" for i, c in enumerate(docs.columns) if c not in but]
    return [_column(c).alias(f"_column_{i}") for i, c in enumerate(docs.columns) if c not in but], names


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5; a null text is kept."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    columns, names = _numbered(docs)
    scored = toxicity.score(docs.select(*columns, "text"), model, *names).where(F.col("score") < 0.5)
    return scored.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies; rows that share a doc_id stay or go together."""
    gone = materialize(near_duplicates.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    bitmap = IdBitmap(gone)
    keyed = docs.select(F.struct(*map(_column, docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    # Only rows that the bitmap can't clear are joined.
    rest = bitmap.keep(keyed, "doc_id").join(gone, "doc_id", "left_anti")
    return bitmap.keep(keyed, "doc_id", others=True).select("row.*").union(rest.select("row.*"))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 50 words that a document of smaller doc_id has."""
    columns, names = _numbered(docs, "text")
    found = substrings.remove_duplicates(docs.select("doc_id", "text", *columns), carry=tuple(names))
    cut = F.col("n_removed") > 0
    new = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        own = F.col(f"_column_{docs.columns.index('n_chars')}")
        new["n_chars"] = F.when(cut, F.length("cleaned")).otherwise(own).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col(f"_column_{i}")).alias(c) for i, c in enumerate(docs.columns)))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, at most three times."""
    return mixing.repeat_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("substrings", without_repeated_passages),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: A learned classifier, rounding that carries remainders, and a tokenizer are beyond SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
