"""Readers and writers: event logs, snapshots, attestations, envelopes, keys."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.paths import file_hash


def read_raw_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Recorded events.  In JSON logs, records that can't be read stay as rows without a kind, which later count as dropped."""
    reader = spark.read.schema(schema.RAW_EVENT)
    return reader.option("mode", "PERMISSIVE").json(path) if fmt == "json" else reader.format(fmt).load(path)


def stream_raw_events(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema.RAW_EVENT).format(fmt).load(path)


def snapshot(spark: SparkSession, root: str, run_id: int, phase: str) -> DataFrame:
    """Regular files below a folder that Spark can list, hashed by the executors; ``.git`` folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.removeprefix("file://").rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base.replace("\\", "\\\\").replace(".", r"\.") + "/", "")
    files = files.withColumn("path", relative).where(~F.col("path").rlike(r"(^|/)\.git/"))
    return files.select(F.lit(run_id).cast("long").alias("run_id"), F.lit(phase).alias("phase"), "path", F.lit("File").alias("kind"), file_hash(F.col("path"), F.col("content")).alias("hash"), F.lit(None).cast("string").alias("target"))


def local_snapshot(spark: SparkSession, root: str, run_id: int, phase: str) -> DataFrame:
    """A local folder with its links and folders: a link to a file counts as a file with a target, one to a folder isn't entered."""
    import hashlib

    rows = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n != ".git")
        for name in [*names, *sorted(files)]:
            at = os.path.join(folder, name)
            shown, target = os.path.relpath(at, root), os.readlink(at) if os.path.islink(at) else None
            if os.path.isfile(at):
                try:
                    with open(at, "rb") as f:
                        digest = "sha256:" + hashlib.file_digest(f, "sha256").hexdigest()
                except OSError:
                    digest = None
                rows.append((run_id, phase, shown, "File", digest, target))
            else:
                rows.append((run_id, phase, shown, "Symlink" if target is not None else "Directory", None, target))
    return spark.createDataFrame(rows, schema.SNAPSHOT)


def read_attestations(spark: SparkSession, path: str) -> DataFrame:
    """Documents, one a file, with the file's path as ``source``."""
    return spark.read.schema(schema.ATTESTATION).option("multiLine", "true").json(path).withColumn("source", F.input_file_name())


def write_attestation(doc: DataFrame, path: str) -> None:
    """One document as indented JSON."""
    rows = doc.drop("run_id", "source").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("one document is written at a time; use write_attestations for many")
    _write_json(rows[0], path)


def _write_json(row: Row, path: str) -> None:
    Path(path).write_text(json.dumps(row.asDict(recursive=True), indent=2, ensure_ascii=False))


def write_attestations(docs: DataFrame, folder: str) -> int:
    """Each document as indented JSON, named by its run; they come to the driver one partition at a time, in one job."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for row in docs.toLocalIterator():
        _write_json(Row(**{k: v for k, v in row.asDict().items() if k not in ("run_id", "source")}), f"{folder}/{row.run_id}.json")
        n += 1
    return n


def write_ops(ops: DataFrame, path: str, fmt: str = "json") -> None:
    ops.write.format(fmt).save(path)


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ENVELOPE).option("multiLine", "true").json(path)


def read_key(path: str) -> bytes:
    """32 bytes in hexadecimal."""
    key = bytes.fromhex(Path(path).read_text().strip())
    if len(key) != 32:
        raise ValueError(f"a key has 32 bytes, not {len(key)}")
    return key


def write_key(path: str, key: bytes) -> None:
    """A new file that only its owner can read; an existing one is never overwritten."""
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as out:
        out.write(key.hex() + "\n")
