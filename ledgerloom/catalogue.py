"""The engine's queries over the driver's tables and, for each that SQL can express, the same in SQL.

``events`` stands for recorded runs (a run is a week of the month, a process a
user), ``documents`` for workspace snapshots, ``lineitem`` for reads and writes
of contents (parts) by processes (suppliers), ``nation`` and ``region`` for
process trees and documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dsse, schema
from .functions import hashing, paths
from .operators import attest, canonical, compare, descriptors, enrich, merkle, process, provenance, snapshots
from .tables import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _digest(*parts: Column | str) -> Column:
    return hashing.sha256(_text(*parts).cast("binary"))


# --- runs from events -----------------------------------------------------------------------------


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    e = e.withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "run_id": F.floor((F.day("ts") - 1) / 7).cast("long")})
    return process.by_time(e, F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"])


def trace_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as TRACED_EVENT: sign-ups are execs, purchases closes, errors unlinks, clicks writing and views reading opens."""
    e = _numbered(spark, sf_dir)
    kind = F.when(F.col("event_type") == "signup", "Exec").when(F.col("event_type") == "purchase", "FileClose").when(F.col("event_type") == "error", "FileUnlink").otherwise("FileOpen")
    e = e.withColumns({"kind": kind, "pid": F.col("user_id"), "child_pid": F.lit(None).cast("long")})
    e = process.lifetimes(e).drop("child")
    obs = F.struct(F.lit("content").alias("kind"), _digest(F.when(F.col("kind") == "Exec", "t").otherwise("c"), F.col("k")).alias("hash"))
    return e.select(
        "run_id", "seq", "kind", "process", F.lit(None).cast(schema.PROCESS).alias("child"), _text("/w/d", F.col("k") % 10, "/f", F.col("k")).alias("path"),
        F.lit(None).cast("string").alias("from_path"), F.lit(None).cast("string").alias("to_path"), F.when(F.col("event_type") == "click", 1).otherwise(0).cast("long").alias("flags"),
        F.lit(0).cast("long").alias("prot"), (F.col("k") % 8).cast("int").alias("fd"), F.lit(False).alias("external"), F.lit(0).alias("exit_code"), obs.alias("obs"),
    )


_T = """
raw AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST((day(ts) - 1) // 7 AS BIGINT) AS run_id FROM events),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM raw),
t0 AS (
  SELECT run_id, seq, user_id AS pid, event_id, k,
    CASE event_type WHEN 'signup' THEN 'Exec' WHEN 'purchase' THEN 'FileClose' WHEN 'error' THEN 'FileUnlink' ELSE 'FileOpen' END AS kind,
    CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS flags, CAST(k % 8 AS INT) AS fd, '/w/d' || (k % 10) || '/f' || k AS path,
    'sha256:' || sha256((CASE WHEN event_type = 'signup' THEN 't' ELSE 'c' END) || k) AS obs
  FROM numbered
),
t AS (SELECT *, last_value(CASE WHEN kind = 'Exec' THEN obs END IGNORE NULLS) OVER (PARTITION BY run_id, pid ORDER BY seq) AS tool FROM t0)
"""

_OPS = (
    _T
    + r""",
marks AS (
  SELECT *, lead(kind) OVER w AS next_kind, lead(obs) OVER w AS next_obs FROM t WHERE kind = 'FileClose' OR (kind = 'FileOpen' AND flags = 1)
  WINDOW w AS (PARTITION BY run_id, pid, fd ORDER BY seq)
),
emitted AS (
  SELECT run_id, 'Exec' AS op_type, tool AS tool_hash, '' AS args, '' AS input_hashes, '' AS output_hashes, sha256('exec' || tool) AS h FROM t WHERE kind = 'Exec'
  UNION ALL SELECT run_id, 'FileRead', tool, '', obs, '', sha256('file_read' || coalesce(tool, '') || obs) FROM t WHERE kind = 'FileOpen' AND flags = 0
  UNION ALL SELECT run_id, 'FileWrite', tool, '', '', o, sha256('file_write' || coalesce(tool, '') || o)
    FROM (SELECT *, CASE WHEN next_kind = 'FileClose' THEN next_obs ELSE '' END AS o FROM marks WHERE kind = 'FileOpen')
  UNION ALL SELECT run_id, 'FileDelete', tool, 'flags:0x0', obs, '', sha256(encode('file_delete' || coalesce(tool, '') || 'flags:0x0') || '\x00'::BLOB || encode(obs)) FROM t WHERE kind = 'FileUnlink'
),
ops AS (SELECT DISTINCT run_id, 'sha256:' || h AS leaf, op_type, tool_hash, args, input_hashes, output_hashes FROM emitted)
"""
)


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonicalize(trace_view(spark, sf_dir))


@query(f"WITH {_OPS} SELECT run_id, leaf, op_type, tool_hash, args, input_hashes, output_hashes FROM ops")
def canonical_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ops(spark, sf_dir).select("run_id", "leaf", "op_type", "tool_hash", *(F.array_join(c, ",").alias(c) for c in ("args", "input_hashes", "output_hashes")))


def _merkle_sql(leaves: str, key: str = "run_id") -> str:
    """CTEs ``folded`` and ``root_of`` (key, root, n) over a relation of key and leaf."""
    return f"""
listed AS (SELECT {key}, list(DISTINCT leaf) AS raw_leaves FROM {leaves} GROUP BY {key}),
sorted AS (SELECT {key}, list_sort(raw_leaves) AS l, len(raw_leaves) AS n FROM listed),
padded AS (SELECT {key}, n, l || [ 'sha256:' || sha256('paddingpadding') FOR x IN range(CAST(pow(2, ceil(log2(n))) AS BIGINT) - n) ] AS l FROM sorted),
folded AS (
  SELECT {key}, n, l FROM padded
  UNION ALL SELECT {key}, n, list_transform(range(1, len(l) // 2 + 1), lambda i: 'sha256:' || sha256(l[2 * i - 1] || l[2 * i])) FROM folded WHERE len(l) > 1
),
root_of AS (SELECT {key}, l[1] AS root, n FROM folded WHERE len(l) = 1)
"""


@query(f"WITH RECURSIVE {_OPS}, {_merkle_sql('ops')} SELECT run_id, root, CAST(n AS BIGINT) AS leaf_count FROM root_of")
def process_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.roots(_ops(spark, sf_dir))


@query(f"WITH {_OPS} SELECT run_id, op_type, CAST(count(*) AS BIGINT) AS ops, CAST(count(DISTINCT tool_hash) AS BIGINT) AS tools, CAST(count(*) FILTER (WHERE op_type IN ('FileRead', 'FileWrite') AND tool_hash IS NULL) AS BIGINT) AS without_tool FROM ops GROUP BY ALL")
def op_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.op_summary(_ops(spark, sf_dir))


@query(f"WITH {_T} SELECT run_id, seq, pid, CAST(0 AS INT) AS generation, CAST(count(*) FILTER (WHERE kind = 'Exec') OVER (PARTITION BY run_id, pid ORDER BY seq) AS INT) AS exec_epoch FROM t")
def exec_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_view(spark, sf_dir).select("run_id", "seq", "process.pid", "process.generation", "process.exec_epoch")


@query(f"WITH {_T} SELECT run_id, seq, tool FROM t")
def tool_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process.with_tools(trace_view(spark, sf_dir)).select("run_id", "seq", "tool")


@query("""
WITH RECURSIVE links AS (
  SELECT n_nationkey AS child, CASE WHEN n_nationkey < 10 THEN NULL ELSE n_nationkey - 10 END AS parent, CASE WHEN n_regionkey < 4 THEN 't' || n_regionkey END AS own FROM nation
), tools AS (
  SELECT child, own AS tool FROM links WHERE parent IS NULL
  UNION ALL SELECT l.child, t.tool FROM links l JOIN tools t ON l.parent = t.child
)
SELECT CAST(child AS BIGINT) AS pid, tool FROM tools
""")
def fork_tool_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions run tools (but for the last one) and fork the first ten nations; each of these forks the next but nine, and so on."""
    nation = _read(spark, sf_dir, "nation")
    who = lambda pid: F.struct(pid.cast("long").alias("pid"), F.lit(0).alias("generation"), F.lit(0).alias("exec_epoch"))
    key, up = F.col("n_nationkey"), F.when(F.col("n_nationkey") < 10, F.col("n_regionkey") + 1000).otherwise(F.col("n_nationkey") - 10)
    forks = nation.select(F.lit(0).cast("long").alias("run_id"), (key + 100).cast("long").alias("seq"), F.lit("Fork").alias("kind"), who(up).alias("process"), who(key).alias("child"), F.lit(None).cast(schema.OBSERVATION).alias("obs"))
    execs = _read(spark, sf_dir, "region").where("r_regionkey < 4")
    execs = execs.select(F.lit(0).cast("long").alias("run_id"), F.col("r_regionkey").cast("long").alias("seq"), F.lit("Exec").alias("kind"), who(F.col("r_regionkey") + 1000).alias("process"), F.lit(None).cast(schema.PROCESS).alias("child"), F.struct(F.lit("content").alias("kind"), _text("t", F.col("r_regionkey")).alias("hash")).alias("obs"))
    return process.inherited_tools(forks.unionByName(execs)).select("child.pid", F.col("inherited").alias("tool"))


@query(f"""
WITH {_T}, marks AS (
  SELECT *, lag(kind) OVER w AS before, lag(seq) OVER w AS opened FROM t WHERE kind = 'FileClose' OR (kind = 'FileOpen' AND flags = 1)
  WINDOW w AS (PARTITION BY run_id, pid, fd ORDER BY seq)
)
SELECT run_id, seq, pid, fd, CASE WHEN before = 'FileOpen' THEN opened END AS opened FROM marks WHERE kind = 'FileClose'
""")
def close_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace_view(spark, sf_dir)
    close = F.col("kind") == "FileClose"
    marks = t.where(close | ((F.col("kind") == "FileOpen") & paths.can_write(F.col("flags")))).select(
        "run_id", F.lit("tree").alias("space"), "process.pid", "process.generation", "fd", "seq", F.lit(0).alias("rank"), F.when(close, "close").otherwise("open").alias("action"), F.when(~close, F.col("seq")).alias("op")
    )
    forks = t.where("kind = 'Fork'").select("run_id", "seq", "process.pid", "process.generation", F.col("child.pid").alias("child_pid"), F.col("child.generation").alias("child_generation"))
    return descriptors.match(marks, forks).where("action = 'close'").select("run_id", "seq", "pid", "fd", F.col("pending").alias("opened"))


@query("""
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id // 2 AS op, (event_id // 2) % 7 AS pid FROM events),
s AS (SELECT * FROM e WHERE event_id % 2 = 0 AND k % 9 <> 0), d AS (SELECT * FROM e WHERE event_id % 2 = 1 AND k % 11 <> 0),
pairs AS (SELECT coalesce(s.pid, d.pid) AS pid, coalesce(s.op, d.op) AS op, '/s/' || s.k AS f, '/d/' || d.k AS g, d.k AS k FROM s FULL JOIN d ON s.op = d.op AND s.pid = d.pid)
SELECT pid, op AS operation_id, CAST(0 AS INT) AS part, f AS from_path, g AS to_path FROM pairs WHERE f IS NOT NULL AND g IS NOT NULL
UNION ALL SELECT pid, op, 1, g, f FROM pairs WHERE f IS NOT NULL AND g IS NOT NULL AND k % 5 = 0
UNION ALL SELECT pid, op, -1, NULL, NULL FROM pairs WHERE f IS NULL OR g IS NULL
""")
def rename_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events are sources, odd ones destinations; some halves lack their other one, some renames are exchanges."""
    e = _read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    half = F.floor(F.col("event_id") / 2)
    even = F.col("event_id") % 2 == 0
    raw = e.where(F.when(even, F.col("k") % 9 != 0).otherwise(F.col("k") % 11 != 0)).select(
        F.lit(0).cast("long").alias("run_id"), F.col("event_id").alias("seq"), F.when(even, 6).otherwise(7).alias("kind"), (half % 7).alias("pid"), half.alias("operation_id"),
        F.when(F.col("k") % 5 == 0, 2).otherwise(0).cast("long").alias("flags"), F.when(even, _text("/s/", F.col("k"))).otherwise(_text("/d/", F.col("k"))).alias("path"),
    )
    pairs, lost = enrich.rename_pairs(raw)
    none = F.lit(None).cast("string")
    return pairs.select("pid", "operation_id", "part", "from_path", "to_path").unionByName(lost.select("pid", "operation_id", F.lit(-1).alias("part"), none.alias("from_path"), none.alias("to_path")))


_WATCH = ["/w/d1", "/w/d3/"]
_WATCHED = "(path = '/w/d1' OR starts_with(path, '/w/d1/') OR path = '/w/d3' OR starts_with(path, '/w/d3/'))"


@query(f"WITH {_T} SELECT run_id, seq, path FROM t WHERE NOT (pid % 3 = 0 AND kind = 'FileOpen' AND NOT {_WATCHED})")
def watch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace_view(spark, sf_dir).withColumn("external", F.col("process.pid") % 3 == 0)
    return canonical.without_unwatched(t, _WATCH).select("run_id", "seq", "path")


@query(f"""
WITH {_T}, kept AS (SELECT *, pid % 5 = 0 AS ext, pid = 1 AS root, {_WATCHED} AS near FROM t WHERE NOT (pid % 5 = 0 AND kind = 'FileOpen' AND NOT {_WATCHED})),
marked AS (SELECT *, min(CASE WHEN kind IN ('FileOpen', 'FileUnlink') AND (ext OR (NOT root AND near AND tool IS NULL)) THEN seq END) OVER (PARTITION BY run_id, pid) AS since FROM kept)
SELECT run_id, seq, ext OR (NOT root AND near AND CASE kind WHEN 'FileClose' THEN coalesce(seq > since, false) WHEN 'Exec' THEN false ELSE tool IS NULL OR coalesce(seq > since, false) END) AS outside FROM marked
""")
def fallback_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace_view(spark, sf_dir).withColumn("external", F.col("process.pid") % 5 == 0)
    t = process.with_tools(canonical.without_unwatched(t, _WATCH)).withColumn("is_root", F.col("process.pid") == 1)
    return canonical.with_fallback(t, _WATCH).select("run_id", "seq", "outside")


# --- paths and identities -------------------------------------------------------------------------


def _paths(spark: SparkSession, sf_dir: str, cases: list[tuple[str, str]]) -> DataFrame:
    """``event_id``, ``path``: the case of each event's number, which stands between the case's two parts."""
    e = _read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    path = F.lit(None).cast("string")
    for i, (a, b) in enumerate(cases):
        path = F.when(F.col("k") % len(cases) == i, _text(a, F.col("k"), b)).otherwise(path)
    return e.select("event_id", path.alias("path"))


def _paths_sql(cases: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{a}' || k || '{b}'" for i, (a, b) in enumerate(cases))
    return f"e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), p AS (SELECT event_id, CASE k % {len(cases)} {whens} END AS path FROM e)"


_SYSTEM = [("/proc/", "/stat"), ("/sys/class/", ""), ("/proc-evil/", ""), ("/etc/os-release-", ""), ("/home/u", "/go/telemetry/mode"), ("/srv/go/telemetry-archive/", ""), ("/dev/null", ""), ("/w/", "/sys")]


@query(f"WITH {_paths_sql(_SYSTEM)} SELECT event_id, path, path = '/proc' OR starts_with(path, '/proc/') OR path = '/sys' OR starts_with(path, '/sys/') OR path IN ({', '.join(repr(x) for x in schema.SYSTEM_FILES)}) OR contains(path, '/go/telemetry/') AS is_system FROM p")
def system_state_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, _SYSTEM).select("event_id", "path", paths.is_system_state(F.col("path")).alias("is_system"))


_ODD = [("/tmp/tmp.ABCDEF", "/src/gone"), ("/tmp/ccABCDE", ".s"), ("/var/tmp/go-build", "/b001/./x"), ("/dev/pts/", ""), ("//w//a/./b/", "/"), ("/tmp/rustcABCDE", ".rcgu.o"), ("/home/tmp.ABCDEF", "/x"), ("/tmp/cc", ".o"), ("/w/../a/", "/.")]
_NORMAL = r"""
n AS (
  SELECT event_id, path, CASE WHEN regexp_full_match(path, '/dev/pts/[0-9]*') THEN '/dev/pts/<session>' ELSE '/' || array_to_string(list_transform(
    list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'),
    lambda x: CASE WHEN NOT regexp_matches(path, '^/(var/)?tmp/') THEN x WHEN regexp_full_match(x, 'tmp\.[A-Za-z0-9]{6,}') THEN '<session>' WHEN regexp_full_match(x, 'go-build[0-9]+') THEN '<go-work>'
      WHEN regexp_full_match(split_part(x, '.', 1), 'cc[A-Za-z0-9]{6,}|rustc[A-Za-z0-9]{5,}') THEN '<compiler-temp>' || CASE WHEN contains(x, '.') THEN substr(x, strpos(x, '.')) ELSE '' END ELSE x END), '/') END AS normal
  FROM p
)
"""


@query(f"WITH {_paths_sql(_ODD)}, {_NORMAL} SELECT event_id, path, normal FROM n")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, _ODD).select("event_id", "path", paths.normalize(F.col("path")).alias("normal"))


@query(rf"WITH {_paths_sql(_ODD)}, {_NORMAL} SELECT event_id, 'missing:sha256:' || sha256(encode('{schema.PATH_DOMAIN[:-1].decode()}') || '\x00'::BLOB || encode(normal)) AS identity FROM n")
def missing_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = F.struct(F.lit("missing").alias("kind"), paths.hash_path(F.col("path")).alias("hash"))
    return _paths(spark, sf_dir, _ODD).select("event_id", paths.identity(obs).alias("identity"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS identity FROM documents")
def content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", paths.file_hash(_text(F.col("source"), "/", F.col("doc_id")), F.col("text").cast("binary")).alias("identity"))


# --- snapshots from documents ---------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = _read(spark, sf_dir, "documents")
    folder = F.col("doc_id") % 11 == 0

    def shot(df: DataFrame, phase: str, text: Column) -> DataFrame:
        return df.select(F.lit(0).cast("long").alias("run_id"), F.lit(phase).alias("phase"), _text(F.col("source"), "/", F.col("doc_id")).alias("path"), F.when(folder, "Directory").otherwise("File").alias("kind"), F.when(~folder, hashing.sha256(text.cast("binary"))).alias("hash"), F.lit(None).cast("string").alias("target"))

    old = F.when(F.col("doc_id") % 7 == 0, _text(F.col("text"), "x")).otherwise(F.col("text"))
    return shot(d.where("doc_id % 5 <> 0"), "before", old), shot(d, "after", F.col("text"))


_SHOTS = """
old AS (SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'Directory' ELSE 'File' END AS kind, CASE WHEN doc_id % 11 <> 0 THEN 'sha256:' || sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) END AS hash FROM documents WHERE doc_id % 5 <> 0),
new AS (SELECT source || '/' || doc_id AS path, doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Directory' ELSE 'File' END AS kind, CASE WHEN doc_id % 11 <> 0 THEN 'sha256:' || sha256(text) END AS hash FROM documents),
delta AS (SELECT new.path, new.hash FROM new LEFT JOIN old ON old.path = new.path WHERE new.kind = 'File' AND (old.path IS NULL OR old.kind <> new.kind OR old.hash IS DISTINCT FROM new.hash))
"""


@query(f"WITH {_SHOTS} SELECT path, hash FROM delta")
def snapshot_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changed(*_snapshots(spark, sf_dir)).select("path", "hash")


@query(f"WITH {_SHOTS} SELECT path, hash FROM delta WHERE path = 'src1' OR starts_with(path, 'src1/') OR path = 'src7' OR starts_with(path, 'src7/')")
def select_output_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.select_outputs(*_snapshots(spark, sf_dir), roots=["src1", "src7/"]).select("path", "hash")


@query(f"WITH {_SHOTS}, wanted AS (SELECT source || '/' || doc_id AS path FROM documents UNION SELECT source || '/lost' FROM documents) SELECT wanted.path, hash, CASE WHEN kind IS NULL THEN 'missing' WHEN kind <> 'File' THEN 'non-regular' WHEN hash IS NULL THEN 'unhashed' END AS error FROM wanted LEFT JOIN new USING (path)")
def explicit_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, after = _snapshots(spark, sf_dir)
    d = _read(spark, sf_dir, "documents")
    wanted = d.select(_text(F.col("source"), "/", F.col("doc_id")).alias("path")).unionByName(d.select(_text(F.col("source"), "/lost").alias("path"))).select(F.lit(0).cast("long").alias("run_id"), "path")
    return snapshots.artifacts(after, wanted).select("path", "hash", "error")


@query(f"WITH {_SHOTS}, a AS (SELECT path, hash FROM old WHERE kind = 'File'), b AS (SELECT path, hash FROM new WHERE kind = 'File' AND doc_id % 3 <> 0) SELECT path, CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'added' WHEN a.hash <> b.hash THEN 'changed' ELSE 'same' END AS change, a.hash AS expected, b.hash AS actual FROM a FULL JOIN b USING (path)")
def output_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return compare.output_delta(before.where("kind = 'File'"), after.where("kind = 'File' AND CAST(substring_index(path, '/', -1) AS BIGINT) % 3 <> 0"))


# --- comparing runs -------------------------------------------------------------------------------


@query(f"WITH {_OPS}, a AS (SELECT leaf FROM ops WHERE run_id = 0), b AS (SELECT leaf FROM ops WHERE run_id = 1) SELECT 'missing' AS side, leaf FROM (SELECT leaf FROM a EXCEPT SELECT leaf FROM b) UNION ALL SELECT 'added', leaf FROM (SELECT leaf FROM b EXCEPT SELECT leaf FROM a)")
def leaf_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = materialize(_ops(spark, sf_dir), "ops")
    return merkle.leaf_diff(ops.where("run_id = 0"), ops.where("run_id = 1"))


@query(f"WITH {_OPS}, n AS (SELECT 'sha256:' || h AS leaf, sum(CASE WHEN run_id = 0 THEN 1 ELSE -1 END) AS d FROM emitted WHERE run_id IN (0, 1) GROUP BY 1) SELECT CASE WHEN d > 0 THEN 'missing' ELSE 'added' END AS side, leaf, CAST(abs(d) AS BIGINT) AS n FROM n WHERE d <> 0")
def op_multiset_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = materialize(canonical.operations(trace_view(spark, sf_dir)), "ops")
    return merkle.op_delta(ops.where("run_id = 0"), ops.where("run_id = 1"))


_STABLE = f"""
{_OPS}, {_merkle_sql('ops')},
base AS (SELECT DISTINCT leaf FROM ops WHERE run_id = 0), size AS (SELECT count(*) AS total FROM base),
per AS (SELECT ops.run_id, count(DISTINCT ops.leaf) AS leaf_count, count(DISTINCT base.leaf) AS common FROM ops LEFT JOIN base ON base.leaf = ops.leaf GROUP BY ops.run_id),
runs AS (
  SELECT per.run_id, root = (SELECT root FROM root_of WHERE run_id = 0) AS root_match, CAST(leaf_count AS BIGINT) AS leaf_count, CAST(common AS DOUBLE) / (leaf_count + total - common) AS j,
    CAST(total - common AS BIGINT) AS missing_leaves, CAST(leaf_count - common AS BIGINT) AS added_leaves
  FROM per JOIN root_of USING (run_id), size
)
"""


def _stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = materialize(_ops(spark, sf_dir), "ops")
    roots = materialize(merkle.roots(ops), "roots")
    same = F.col("root") == roots.where("run_id = 0").select("root").scalar()
    match = roots.select("run_id", same.alias("root_match"), same.alias("process_root_match"))
    return merkle.stability(ops, ops.where("run_id = 0"), match)


@query(f"WITH RECURSIVE {_STABLE} SELECT run_id, root_match, leaf_count, round(j, 9) AS leaf_jaccard, missing_leaves, added_leaves FROM runs")
def stability_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stability(spark, sf_dir).withColumn("leaf_jaccard", F.round("leaf_jaccard", 9)).select("run_id", "root_match", "leaf_count", "leaf_jaccard", "missing_leaves", "added_leaves")


@query(f"WITH RECURSIVE {_STABLE} SELECT CAST(count(*) AS BIGINT) AS run_count, CAST(count(*) FILTER (WHERE root_match) AS BIGINT) AS root_matches, CAST(count(*) FILTER (WHERE root_match) AS BIGINT) AS process_root_matches, round(min(j), 9) AS minimum_leaf_jaccard, round(avg(j), 9) AS mean_leaf_jaccard FROM runs")
def stability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = merkle.stability_summary(_stability(spark, sf_dir))
    return s.withColumns({c: F.round(c, 9) for c in ("minimum_leaf_jaccard", "mean_leaf_jaccard")})


@query(f"WITH {_OPS}, a AS (SELECT leaf FROM ops WHERE run_id = 0), b AS (SELECT leaf FROM ops WHERE run_id = 1), d AS (SELECT 'missing' AS side, leaf FROM (SELECT leaf FROM a EXCEPT SELECT leaf FROM b) UNION ALL SELECT 'added', leaf FROM (SELECT leaf FROM b EXCEPT SELECT leaf FROM a)) SELECT side, CAST(row_number() OVER (PARTITION BY side ORDER BY leaf) AS INT) AS rank, leaf, CAST(count(*) OVER (PARTITION BY side) AS BIGINT) AS total FROM d QUALIFY row_number() OVER (PARTITION BY side ORDER BY leaf) <= 12")
def display_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.first_of_each(leaf_diff(spark, sf_dir), "side", "leaf", 12).select("side", "rank", "leaf", "total")


# --- provenance from line items -------------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every line item is a read or a write (flag A); of what is written, parts of an item of quantity 50 are outputs, a share that grows with the table."""
    items = _read(spark, sf_dir, "lineitem").select(F.lit(0).cast("long").alias("run_id"), F.col("l_suppkey").alias("process"), "l_partkey", "l_quantity", "l_returnflag")
    edge = lambda df: df.select("run_id", "process", _text("c", F.col("l_partkey")).alias("hash")).distinct()
    written = items.where("l_returnflag = 'A'")
    by_path = written.select("run_id", _text("p", F.col("l_partkey")).alias("path"), "process").distinct()
    selected = written.where("l_quantity = 50").select("run_id", _text("p", F.col("l_partkey")).alias("path"), _text("c", F.col("l_partkey")).alias("hash")).distinct()
    flows = items.select("run_id", "process").distinct().select("run_id", "process", _text("t", F.col("process") % 7).alias("tool_hash"), (F.col("process") % 2 == 0).alias("has_exec"))
    return {"reads": edge(items.where("NOT (l_returnflag <=> 'A')")), "writes": edge(written), "by_path": by_path, "outputs": selected, "flows": flows}


_GRAPH = """
reads AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS h FROM lineitem WHERE l_returnflag IS DISTINCT FROM 'A'),
writes AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS h FROM lineitem WHERE l_returnflag = 'A'),
outputs AS (SELECT DISTINCT l_partkey AS h FROM lineitem WHERE l_returnflag = 'A' AND l_quantity = 50),
included AS (
  SELECT p FROM writes WHERE h IN (SELECT h FROM outputs)
  UNION SELECT w.p FROM included i JOIN reads r ON r.p = i.p JOIN writes w ON w.h = r.h WHERE r.h NOT IN (SELECT h FROM outputs)
),
relevant AS (SELECT h FROM outputs UNION SELECT h FROM reads WHERE p IN (SELECT p FROM included))
"""


@query(f"WITH RECURSIVE {_GRAPH} SELECT DISTINCT p AS process FROM included")
def provenance_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    included, _ = provenance.closure(g["reads"], g["writes"], g["by_path"], g["outputs"])
    return included.select("process").distinct()


@query(f"""
WITH RECURSIVE {_GRAPH}, ops AS (
  SELECT 'Exec' AS op_type, 'exec' || 't' || (p % 7) AS s FROM included WHERE p % 2 = 0
  UNION SELECT 'FileRead', 'file_read' || 't' || (p % 7) || 'c' || h FROM reads WHERE p IN (SELECT p FROM included)
  UNION SELECT 'FileWrite', 'file_write' || 't' || (p % 7) || 'c' || h FROM writes WHERE p IN (SELECT p FROM included) AND h IN (SELECT h FROM relevant)
)
SELECT DISTINCT op_type, 'sha256:' || sha256(s) AS leaf FROM ops
""")
def sliced_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    ops = provenance.sliced(g["flows"], g["reads"], g["writes"], g["writes"].limit(0), g["by_path"], g["outputs"])
    return ops.select("op_type", "leaf").distinct()


_MOVES = """
moves AS (SELECT run_id, seq, '/w/d' || (k % 10) AS f, CASE WHEN k % 10 < 3 THEN '/w/d' || (k % 10 + 1) ELSE '/w/x' || (k % 10) END AS g FROM t WHERE kind = 'FileUnlink'),
start AS (
  SELECT DISTINCT run_id, path, pid AS writer, seq AS avail FROM t WHERE kind = 'FileClose'
  UNION SELECT m.run_id, m.g, t.pid, m.seq FROM moves m JOIN t USING (run_id, seq)
),
one AS (
  SELECT * FROM start
  UNION SELECT o.run_id, m.g || substr(o.path, length(m.f) + 1), o.writer, m.seq FROM one o JOIN moves m ON m.run_id = o.run_id AND m.seq > o.avail AND (o.path = m.f OR starts_with(o.path, m.f || '/'))
),
known AS (SELECT DISTINCT run_id, path FROM one),
two AS (
  SELECT run_id, path AS origin, path, CAST(-1 AS BIGINT) AS avail FROM known
  UNION SELECT o.run_id, o.origin, m.g || substr(o.path, length(m.f) + 1), m.seq FROM two o JOIN moves m ON m.run_id = o.run_id AND m.seq > o.avail AND (o.path = m.f OR starts_with(o.path, m.f || '/'))
)
"""


@query(f"WITH RECURSIVE {_T}, {_MOVES} SELECT DISTINCT one.run_id, two.path, one.writer FROM one JOIN two ON two.run_id = one.run_id AND two.origin = one.path")
def rename_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes write files; unlinks stand for renames of their folder to the next one or out."""
    t = trace_view(spark, sf_dir).withColumn("k", F.substring_index("path", "/f", -1).cast("int"))
    moves = t.where("kind = 'FileUnlink'").select("run_id", "seq", F.col("process.pid").alias("writer"), _text("/w/d", F.col("k") % 10).alias("from_path"), F.when(F.col("k") % 10 < 3, _text("/w/d", F.col("k") % 10 + 1)).otherwise(_text("/w/x", F.col("k") % 10)).alias("to_path"))
    rows = t.where("kind = 'FileClose'").select("run_id", "path", F.col("process.pid").alias("writer"), F.col("seq").alias("avail"))
    rows = rows.unionByName(moves.select("run_id", F.col("to_path").alias("path"), "writer", F.col("seq").alias("avail")))
    return provenance.aliases(rows, moves.drop("writer"))


# --- commitments and documents --------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's parts per region: its nations are outputs, those with even keys artifacts as well."""
    n = _read(spark, sf_dir, "nation")
    one = n.groupBy("n_regionkey").agg(
        F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("path"), _text("sha256:", F.col("n_nationkey")).alias("hash")))).alias("outputs"),
        F.sort_array(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))).alias("artifacts"),
        F.sort_array(F.collect_list(_digest(F.col("n_name")))).alias("leaves"),
    )
    r = _read(spark, sf_dir, "region").join(one, F.col("r_regionkey") == F.col("n_regionkey"))
    none = F.array().cast("array<string>")
    return r.select("r_regionkey", _text("sha256:", F.col("r_name")).alias("root"), F.array(F.lit("make"), F.col("r_name")).alias("command"), F.lit("explicit").alias("mode"), "artifacts", none.alias("roots"), "outputs", "leaves")


def _hex_u32(n: str) -> str:
    x = f"printf('%08x', CAST({n} AS BIGINT))"
    return f"(substr({x}, 7, 2) || substr({x}, 5, 2) || substr({x}, 3, 2) || substr({x}, 1, 2))"


def _hex_text(t: str) -> str:
    return f"{_hex_u32(f'octet_length(encode({t}))')} || lower(hex(encode({t})))"


_PARTS = f"""
outs AS (SELECT n_regionkey AS r, {_hex_u32('count(*)')} AS c, string_agg({_hex_text('n_name')} || {_hex_text("'sha256:' || n_nationkey")}, '' ORDER BY n_name) AS h,
  string_agg('{{"path":"' || n_name || '","hash":"sha256:' || n_nationkey || '"}}', ',' ORDER BY n_name) AS j FROM nation GROUP BY 1),
arts AS (SELECT n_regionkey AS r, {_hex_u32('count(*) FILTER (WHERE n_nationkey % 2 = 0)')} AS c, coalesce(string_agg({_hex_text('n_name')}, '' ORDER BY n_name) FILTER (WHERE n_nationkey % 2 = 0), '') AS h,
  coalesce(string_agg('"' || n_name || '"', ',' ORDER BY n_name) FILTER (WHERE n_nationkey % 2 = 0), '') AS j FROM nation GROUP BY 1)
"""
_ROOT = "'sha256:' || r_name"


def _v03_sql(root: str) -> str:
    return f"""'sha256:' || sha256(unhex({_hex_text(f"'{schema.COMMITMENT_V03}'")} || {_hex_text(root)} || {_hex_u32('2')} || {_hex_text("'make'")} || {_hex_text('r_name')} || {_hex_text("'explicit'")} || arts.c || arts.h || {_hex_u32('0')} || outs.c || outs.h))"""


def _v02_sql(root: str) -> str:
    return f"""'sha256:' || sha256('{{"domain":"{schema.COMMITMENT_V02}","process_root":"' || {root} || '","command":["make","' || r_name || '"],"output_selection":{{"mode":"explicit","artifacts":[' || arts.j || '],"output_roots":[]}},"outputs":[' || outs.j || ']}}')"""


@query(f"WITH {_PARTS} SELECT r_regionkey, {_v03_sql(_ROOT)} AS commitment FROM region JOIN outs ON outs.r = r_regionkey JOIN arts ON arts.r = r_regionkey")
def commitment_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.select("r_regionkey", hashing.commitment_v03(*(F.col(c) for c in ("root", "command", "mode", "artifacts", "roots", "outputs"))).alias("commitment"))


@query(f"WITH {_PARTS} SELECT r_regionkey, {_v02_sql(_ROOT)} AS commitment FROM region JOIN outs ON outs.r = r_regionkey JOIN arts ON arts.r = r_regionkey")
def commitment_v02(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.select("r_regionkey", hashing.commitment_v02(*(F.col(c) for c in ("root", "command", "mode", "artifacts", "roots", "outputs"))).alias("commitment"))


@query(f"""
WITH RECURSIVE {_PARTS}, leaf AS (SELECT n_regionkey AS run_id, 'sha256:' || sha256(n_name) AS leaf FROM nation), {_merkle_sql('leaf')},
docs AS (
  SELECT r_regionkey, root, CASE r_regionkey WHEN 0 THEN '0.1.0' WHEN 1 THEN '0.2.1' WHEN 3 THEN '9.9.9' ELSE '0.3.0' END AS version,
    CASE r_regionkey WHEN 0 THEN root WHEN 1 THEN {_v02_sql('root')} WHEN 4 THEN root ELSE {_v03_sql('root')} END AS said, {_v02_sql('root')} AS v02, {_v03_sql('root')} AS v03
  FROM region JOIN root_of ON run_id = r_regionkey JOIN outs ON outs.r = r_regionkey JOIN arts ON arts.r = r_regionkey
)
SELECT r_regionkey, root AS computed_root, CASE version WHEN '0.1.0' THEN CASE WHEN said <> root THEN 'root does not match the tree' END WHEN '0.2.1' THEN CASE WHEN said <> v02 THEN 'root does not match the commitment' END
  WHEN '0.3.0' THEN CASE WHEN said <> v03 THEN 'root does not match the commitment' END ELSE 'unsupported version: ' || version END AS error FROM docs
""")
def validate_attestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of each version per region; the last one has a root that it doesn't commit to."""
    d = _documents(spark, sf_dir).withColumn("root", merkle.root_of(F.col("leaves")))
    parts = [F.col(c) for c in ("root", "command", "mode", "artifacts", "roots", "outputs")]
    key = F.col("r_regionkey")
    version = F.when(key == 0, "0.1.0").when(key == 1, "0.2.1").when(key == 3, "9.9.9").otherwise("0.3.0")
    said = F.when(key.isin(0, 4), F.col("root")).when(key == 1, hashing.commitment_v02(*parts)).otherwise(hashing.commitment_v03(*parts))
    tree = F.struct("leaves", F.array().cast("array<struct<hash:string,is_leaf:boolean>>").alias("nodes"), F.size("leaves").cast("long").alias("leaf_count"))
    docs = d.select("r_regionkey", version.alias("version"), said.alias("root_hash"), F.when(key == 2, F.lit("")).otherwise(F.col("root")).alias("process_root"), "command", F.struct("mode", "artifacts", F.col("roots").alias("output_roots")).alias("output_selection"), "outputs", tree.alias("tree"))
    return attest.validated(docs).select("r_regionkey", "computed_root", "error")


@query("SELECT doc_id, sha256('DSSEv1 10 text/plain ' || octet_length(encode(text)) || ' ' || text) AS pae_sha256 FROM documents")
def dsse_pae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(hashing.pae(F.lit("text/plain"), F.col("text")), 256).alias("pae_sha256"))


@query()
def ed25519_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' names signed with one key; those with odd keys are altered afterwards."""
    seed = bytes(range(32))

    @F.pandas_udf("payloadType string, payload string, signatures array<struct<keyid:string,sig:string>>")
    def signed(names):
        import pandas as pd

        return pd.DataFrame([dsse.envelope(seed, n.encode(), "text/plain") for n in names])

    e = _read(spark, sf_dir, "nation").select("n_nationkey", signed("n_name").alias("e")).select("n_nationkey", "e.*")
    e = e.withColumn("payload", F.when(F.col("n_nationkey") % 2 == 1, F.base64(_text("x").cast("binary"))).otherwise(F.col("payload")))
    return dsse.verify_envelopes(e, dsse.public_key(seed)).select("n_nationkey", "verified")
