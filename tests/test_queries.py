import pytest
from conftest import same

from ledgerloom import catalogue, queries


@pytest.fixture(scope="module", autouse=True)
def traced_once():
    """The whole traces are enriched once for all queries here."""
    from ledgerloom import forest, records

    made, kept = forest.traced_view, {}

    def once(spark, sf_dir):
        if sf_dir not in kept:
            kept[sf_dir] = made(spark, sf_dir)
        return kept[sf_dir]

    forest.traced_view = records.traced_view = once
    yield
    forest.traced_view = records.traced_view = made


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df())


def test_signatures(spark, sf_dir):
    rows = catalogue.QUERIES["ed25519_verify"](spark, sf_dir).collect()
    assert all(r.verified == (r.n_nationkey % 2 == 0) for r in rows) and len(rows) == 25


def test_provenance_of_the_whole_table(spark, sf_dir, tmp_path):
    """Every line item is an edge, and the closure is that of brute force: on the table, and on chains of several rounds."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    chains = [(p, 10 * p + d, q, f) for p in range(60) for d, q, f in ((0, 1.0, "A"), (10 if p % 6 < 5 else 1, 2.0, "R" if p % 2 else None), (2, 50.0 if p % 12 == 0 else 3.0, "A"))]
    spark.createDataFrame(chains, items.schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    for at, df in ((sf_dir, items), (str(tmp_path), spark.read.parquet(f"{tmp_path}/lineitem.parquet"))):
        rows = df.collect()
        reads, writes = {(r[0], r[1]) for r in rows if r[3] != "A"}, {(r[0], r[1]) for r in rows if r[3] == "A"}
        g = catalogue._graph(spark, at)
        assert {(r.process, int(r.hash[1:])) for x in ("reads", "writes") for r in g[x].collect()} == {(r[0], r[1]) for r in rows}
        outputs = {r[1] for r in rows if r[3] == "A" and r[2] == 50}
        included, front = set(), {p for p, h in writes if h in outputs}
        while front:
            included |= front
            seen = {h for p, h in reads if p in front} - outputs
            front = {p for p, h in writes if h in seen} - included
        assert {r.process for r in catalogue.QUERIES["provenance_closure"](spark, at).collect()} == included
    assert len(included) == 30


def test_documents_are_made_once(spark, sf_dir):
    """What is shown of two documents is read from them; texts aren't hashed anew for each part of it."""
    shown = queries.QUERIES["document_diff"](spark, sf_dir)
    assert shown.inputFiles() and not any(sf_dir in f for f in shown.inputFiles())


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
