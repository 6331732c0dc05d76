"""Commands over recorded runs and documents: python -m ledgerloom COMMAND --help."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dsse, plans, schema, sources
from . import tables as tables_
from .operators import attest
from .plans.paths import metadata_path


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("ledgerloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _document(spark: SparkSession, path: str) -> DataFrame:
    """One valid document; anything else ends the command."""
    docs = sources.read_attestations(spark, path).withColumn("run_id", F.lit(0).cast("long"))
    row = attest.validated(docs).select("error", "warning").first()
    if row is None or row.error:
        sys.exit(f"{path}: {row.error if row else 'no document'}")
    if row.warning:
        print(f"{path}: {row.warning}", file=sys.stderr)
    return docs


def _show(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False))


def trace(args: argparse.Namespace) -> int:
    """Recorded tables (events, observations, roots, before, after below INPUT) to documents, one file a run."""
    spark = _session()
    tables = {t: spark.read.parquet(f"{args.input}/{t}") for t in ("events", "observations", "roots", "before", "after")}
    wanted = None
    if args.artifact:
        runs = tables["roots"].select("run_id")
        names = [metadata_path(a, args.workspace) for a in args.artifact]
        wanted = runs.withColumn("path", F.explode(F.array(*map(F.lit, names))))
    docs, ops = plans.trace(
        tables["events"], tables["observations"], tables["roots"], tables["before"], tables["after"], args.command, args.watch, [metadata_path(p, args.workspace) for p in args.output_root], wanted, args.allow_drops
    )
    if args.dump_ops:
        sources.write_ops(ops, args.dump_ops)
    sources.write_attestations(docs, args.output)
    tables_.clear(spark)
    return 0


def verify_trace(args: argparse.Namespace) -> int:
    """Trace recorded tables below INPUT anew and compare with the documents below EXPECTED, one file a run."""
    spark = _session()
    tables = {t: spark.read.parquet(f"{args.input}/{t}") for t in ("events", "observations", "roots", "before", "after")}
    expected = sources.read_attestations(spark, f"{args.expected}/*.json")
    expected = expected.withColumn("run_id", F.regexp_extract("source", r"([0-9]+)\.json$", 1).cast("long"))
    wanted = None
    if args.artifact:
        wanted = tables["roots"].select("run_id").withColumn("path", F.explode(F.array(*map(F.lit, [metadata_path(a, args.workspace) for a in args.artifact]))))
    verdicts, _ = plans.verify_trace(
        expected, tables["events"], tables["observations"], tables["roots"], tables["before"], tables["after"], args.command, args.watch, [metadata_path(p, args.workspace) for p in args.output_root], wanted, args.root
    )
    failed = 0
    for row in verdicts.orderBy("run_id").toLocalIterator():
        print(f"{row.run_id}: {row.verdict or 'verified'}")
        failed += row.verdict is not None
    return int(bool(failed))


def verify(args: argparse.Namespace) -> int:
    spark = _session()
    expected, actual = _document(spark, args.expected), _document(spark, args.actual)
    verdict = plans.verify(expected, actual, args.root).first().verdict
    print(verdict or "verified")
    if verdict:
        for part in plans.diff(expected, actual).values():
            _show(part)
    return int(bool(verdict))


def explain(args: argparse.Namespace) -> int:
    _show(plans.explain(_document(_session(), args.document)))
    return 0


def diff(args: argparse.Namespace) -> int:
    spark = _session()
    parts = plans.diff(_document(spark, args.expected), _document(spark, args.actual))
    for part in parts.values():
        _show(part)
    return int(not parts["summary"].first().same_root_hash)


def stability(args: argparse.Namespace) -> int:
    spark = _session()
    docs = None
    for i, path in enumerate(args.documents):
        again = args.documents[:i].count(path)
        one = _document(spark, path).withColumn("source", F.lit(f"{path} ({again + 1})" if again else path))
        docs = one if docs is None else docs.unionByName(one)
    rows, summary = plans.stability(docs, args.documents[0])
    print(plans.report_json(rows, summary, args.documents[0]) if args.json else plans.report(rows, summary))
    return int(args.strict and not plans.is_stable(summary))


def harness(args: argparse.Namespace) -> int:
    """Traced events and roots (Parquet below INPUT) of many runs of one command."""
    spark = _session()
    roots = spark.read.parquet(f"{args.input}/roots")
    rows, summary = plans.harness(spark.read.schema(schema.TRACED_EVENT).parquet(f"{args.input}/traced"), roots, args.command, roots.count(), watch=args.watch)
    print(plans.report_json(rows, summary) if args.json else plans.report(rows, summary))
    return int(args.strict and not plans.is_stable(summary))


def generate_key(args: argparse.Namespace) -> int:
    key = dsse.generate_key()
    sources.write_key(args.key, key)
    Path(args.key + ".pub").write_text(dsse.public_key(key).hex() + "\n")
    return 0


def sign(args: argparse.Namespace) -> int:
    _document(_session(), args.document)
    payload = Path(args.document).read_bytes()
    made = dsse.envelope(sources.read_key(args.key), payload, json.loads(payload)["predicate_type"], args.keyid)
    Path(args.output).write_text(json.dumps(made, indent=2))
    return 0


def verify_signature(args: argparse.Namespace) -> int:
    spark = _session()
    row = dsse.verify_envelopes(sources.read_envelopes(spark, args.envelope), sources.read_key(args.key)).select("verified", F.unbase64("payload").cast("string").alias("text")).first()
    if not (row and row.verified):
        sys.exit("no valid signature")
    doc = spark.createDataFrame([(row.text,)], "text string").select(F.from_json("text", schema.ATTESTATION).alias("d")).select("d.*")
    error = attest.validated(doc).first().error
    print(error or "verified")
    return int(bool(error))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(f, *positional: str) -> argparse.ArgumentParser:
        p = commands.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        p.set_defaults(run=f)
        for name in positional:
            p.add_argument(name)
        return p

    for f in (trace, verify_trace, harness):
        p = command(f, "input")
        p.add_argument("--watch", action="append", default=[])
        if f is not harness:
            p.add_argument("--output-root", action="append", default=[])
            p.add_argument("--artifact", action="append", default=[])
            p.add_argument("--workspace", default="/")
        if f is trace:
            p.add_argument("--output", required=True)
            p.add_argument("--dump-ops")
            p.add_argument("--allow-drops", action="store_true")
        elif f is verify_trace:
            p.add_argument("--expected", required=True)
            p.add_argument("--root")
        else:
            p.add_argument("--strict", action="store_true")
            p.add_argument("--json", action="store_true")
        p.add_argument("command", nargs="+")
    command(verify, "expected", "actual").add_argument("--root")
    command(explain, "document")
    command(diff, "expected", "actual")
    p = command(stability)
    p.add_argument("documents", nargs="+")
    p.add_argument("--json", action="store_true")
    p.add_argument("--strict", action="store_true")
    command(generate_key, "key")
    p = command(sign, "document")
    p.add_argument("--key", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--keyid")
    command(verify_signature, "envelope").add_argument("--key", required=True)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
