import random
from collections import Counter

import pytest
from conftest import same
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import packing, queries
from ledgerloom.llm.common import materialize, read
from test_operators import family, linked, mosaic, without_windows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_is_whole(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name.startswith("op9"):
        e = read(spark, sf_dir, "embeddings")
        assert df.count() == 20 * e.where("vec_id % 20 = 0").count()
    elif name.startswith("op8"):
        assert df.select("doc_id").distinct().count() == read(spark, sf_dir, "documents").count()
    else:
        assert df.count() == read(spark, sf_dir, "documents").count()


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns and docs.schema.simpleString() == before.schema.simpleString()
        seen.append((before.toPandas(), docs.toPandas()))
    (all_docs, mild), (_, single), (_, cut), (_, mixed) = seen
    assert 0.7 * len(all_docs) < len(mild) <= len(all_docs)
    want = linked(list(zip(mild.doc_id.tolist(), mild.text.tolist(), strict=True)))
    assert sorted(single.doc_id) == sorted(i for i, c in want.items() if i == c)
    kept = without_windows(list(zip(single.doc_id.tolist(), single.text.tolist(), strict=True)))
    assert {i: len(t.split()) for i, t in zip(cut.doc_id, cut.text, strict=True)} == {i: n - gone for i, (n, gone, _) in kept.items()}
    assert all(len(t) == n for t, n in zip(cut.text, cut.n_chars, strict=True))
    copies = Counter(mixed.doc_id)
    assert max(copies.values()) <= 3 and set(copies) <= set(cut.doc_id)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert packed.sequence_id.is_unique and packed[packed.start == 0].doc_id.value_counts().to_dict() == dict(copies)
    again = corpus_pipeline.run(spark, sf_dir).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, again[key].to_numpy().tolist())) == sorted(map(tuple, packed[key].to_numpy().tolist()))


def test_stages_on_odd_rows(spark, sf_dir):
    rng = random.Random(1)
    rows = [(i, t, "en", "a", len(t), "x") for i, t in family()[:30] + [(500 + i, t) for i, t in mosaic(1)[:20]]]
    rows += [(900, None, None, None, None, None), (901, "", "en", None, 0, "x"), (902, "word", "en", "b", 4, "x"), (903, "word", "en", "b", 4, "x")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert docs.where("doc_id = 903").count() == 0 and docs.where("doc_id = 902").count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []
    assert packing.cut(1, 2048) == [1] and packing.cut(5000, 2048) == [2048, 2048, 512, 256, 128, 8]


NAMES = ["_id", "_k", "_n", "_r", "_key", "_copies", "_rows", "_sum", "_0", "_1", "_text", "row", "runs", "factors", "spans", "cleaned", "score", "component_id", "kept", "id", "key", "n", "copies", "a.b"]


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("doc_id < 60")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0")).withColumns({n: F.concat(F.lit(n + ":"), F.col("doc_id").cast("string")) for n in NAMES})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        rows = docs.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
