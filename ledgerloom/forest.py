"""Queries over whole raw traces: processes that fork and come again, renames, mappings, exits, system paths, external processes.

Events become raw kernel records (a user is a process that may fork the two
below it in a binary tree), which go through all of enrichment and
canonicalization.  The SQL follows each descriptor up the tree by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .catalogue import _WATCH, _digest, _merkle_sql, _numbered, _text, query
from .functions.paths import identity
from .operators import canonical, enrich, merkle, process
from .tables import materialize


def raw_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as RAW_EVENT rows; an error with an even number is a rename of a folder, which is two records."""
    e = _numbered(spark, sf_dir).withColumn("fd", (F.floor(F.col("k") / 4) % 4).cast("int"))
    k, kind = F.col("k"), F.col("event_type")
    number = (
        F.when(kind == "signup", F.when(k % 3 == 0, 3).when(k % 3 == 1, 9).otherwise(4)).when(kind == "purchase", 2).when(kind == "error", F.when(k % 2 == 0, 6).otherwise(8))
        .when((kind == "view") & (k % 4 == 0), 5).otherwise(1)
    )
    flags = F.when(kind == "click", 1 + (k % 3 == 0).cast("int")).when((kind == "error") & (k % 20 == 0), 2).when((kind == "view") & (k % 4 == 0), 1).otherwise(0)
    path = F.when(number == 3, _text("/bin/t", k)).when(number == 6, _text("/w/d", k % 10)).when((kind == "click") & (k % 13 == 0), _text("/proc/", k)).otherwise(_text("/w/d", k % 10, "/f", k))
    null = lambda t: F.lit(None).cast(t)
    rows = e.select(
        "run_id", number.alias("kind"), F.when(F.col("user_id") % 7 == 3, 1).otherwise(0).alias("source"), (F.col("seq") * 1000).alias("timestamp_ns"), F.col("user_id").alias("pid"), F.col("user_id").alias("tgid"),
        F.when(number.isin(1, 2, 5), F.col("fd")).alias("fd"), F.lit(schema.AT_FDCWD).alias("dfd"), flags.cast("long").alias("flags"), F.when(k % 8 == 0, 3).otherwise(1).cast("long").alias("prot"),
        F.when(number.isin(1, 3, 6, 8), path).alias("path"), null("int").alias("path_len"), F.col("event_id").alias("operation_id"), F.when(number == 4, k % 5).cast("int").alias("exit_code"),
        F.col("user_id").alias("parent_pid"), F.when(number == 9, 2 * F.col("user_id") + 1 + F.floor(k / 2) % 2).cast("long").alias("child_pid"), null("string").alias("proc_target"), null("string").alias("cwd"),
    )
    target = F.concat(F.lit("/w/d"), F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("string"), F.when(k == 54, F.lit("/in")).otherwise(F.lit("")))
    to = e.where((kind == "error") & (k % 2 == 0)).select("run_id", (F.col("seq") * 1000).alias("timestamp_ns"), target.alias("_to"))
    second = rows.where("kind = 6").join(to, ["run_id", "timestamp_ns"]).withColumns({"kind": F.lit(7), "path": F.col("_to")}).drop("_to")
    return rows.unionByName(second)


def _roots(raw: DataFrame) -> DataFrame:
    """Process 0 is the root of every run."""
    who = F.struct(F.lit(0).cast("long").alias("pid"), F.lit(0).alias("generation"), F.lit(0).alias("exec_epoch"))
    return raw.select("run_id").distinct().select("run_id", F.lit(0).cast("long").alias("pid"), F.lit("/home").alias("cwd"), who.alias("root"), F.struct(F.lit("content").alias("kind"), _digest("root").alias("hash")).alias("obs"))


def traced_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = raw_view(spark, sf_dir)
    roots = _roots(raw)
    k = F.regexp_extract("props", r"(\d+)", 1)
    seen = raw.where("kind <> 6").select("run_id", "timestamp_ns", "pid", "kind", F.col("operation_id").alias("event_id"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", k.alias("k"))
    seen = seen.join(e, "event_id").select("run_id", "timestamp_ns", "pid", "kind", F.struct(F.lit("content").alias("kind"), _digest(F.when(F.col("kind") == 3, "t").otherwise("c"), F.col("k")).alias("hash")).alias("obs"))
    events, _ = enrich.traced(raw, seen, roots, _WATCH)
    return materialize(enrich.with_root_exec(events, roots), "traced"), roots


_W = lambda p: f"coalesce({p} = '/w/d1' OR starts_with({p}, '/w/d1/') OR {p} = '/w/d3' OR starts_with({p}, '/w/d3/'), false)"

_NEAR = lambda p: f"(starts_with({p}, '/w/d1') OR starts_with({p}, '/w/d3/'))"  # noqa: E731  (the source's own filter, by bytes)

_EVENTS = f"""
base AS (SELECT event_id, ts, user_id AS u, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST((day(ts) - 1) // 7 AS BIGINT) AS run_id FROM events),
kinds AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS n, (k // 4) % 4 AS fd,
    CASE WHEN t = 'signup' THEN CASE k % 3 WHEN 0 THEN 'Exec' WHEN 1 THEN 'Fork' ELSE 'Exit' END WHEN t = 'purchase' THEN 'FileClose'
      WHEN t = 'error' THEN CASE k % 2 WHEN 0 THEN 'FileRename' ELSE 'FileUnlink' END WHEN t = 'view' AND k % 4 = 0 THEN 'FileMmap' ELSE 'FileOpen' END AS kind,
    CASE WHEN t = 'click' THEN CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END WHEN t = 'error' AND k % 20 = 0 THEN 2 WHEN t = 'view' AND k % 4 = 0 THEN 1 ELSE 0 END AS flags,
    CASE WHEN k % 8 = 0 THEN 3 ELSE 1 END AS prot, u % 7 = 3 AND kind NOT IN ('Exec', 'Fork', 'Exit') AS ext, CASE WHEN kind = 'Exec' THEN '/bin/t' || k WHEN t = 'click' AND k % 13 = 0 THEN '/proc/' || k ELSE '/w/d' || (k % 10) || '/f' || k END AS p,
    '/w/d' || (k % 10) AS f, '/w/d' || (k // 10) || CASE WHEN k = 54 THEN '/in' ELSE '' END AS g, 2 * u + 1 + (k // 2) % 2 AS child
  FROM base
),
placed AS (SELECT *, 2 * (n + count(*) FILTER (WHERE kind = 'FileRename') OVER (PARTITION BY run_id ORDER BY n ROWS UNBOUNDED PRECEDING)) AS s FROM kinds),
passed AS (  -- what the source's own filter drops was never seen, and starts no process
  SELECT * FROM placed WHERE NOT (ext AND ((kind IN ('FileOpen', 'FileUnlink') AND NOT {_NEAR('p')}) OR (kind = 'FileRename' AND NOT ({_NEAR('f')} OR {_NEAR('g')}))))
),
every AS (
  SELECT run_id, s AS seq, kind, u AS pid, k, fd, ext, flags, prot, child, CASE WHEN kind IN ('Exec', 'FileOpen', 'FileUnlink') THEN p END AS path,
    CASE WHEN kind = 'FileRename' THEN f END AS f, CASE WHEN kind = 'FileRename' THEN g END AS g FROM passed
  UNION ALL SELECT run_id, s + 1, kind, u, k, fd, ext, flags, prot, child, NULL, g, f FROM passed WHERE kind = 'FileRename' AND flags = 2
),
sights AS (
  SELECT run_id, seq, pid, 0 AS born, kind FROM every UNION ALL SELECT run_id, seq, child, 1, 'Fork' FROM every WHERE kind = 'Fork'
),
lives AS (
  SELECT run_id, seq, pid, born, kind, sum(born) OVER w + CASE WHEN first_value(born) OVER w = 0 OR pid = 0 THEN 1 ELSE 0 END - 1 AS gen,
    count(*) FILTER (WHERE kind = 'Exec' AND born = 0) OVER w AS nth FROM sights WINDOW w AS (PARTITION BY run_id, pid ORDER BY seq, born ROWS UNBOUNDED PRECEDING)
),
epochs AS (
  SELECT *, count(*) FILTER (WHERE kind = 'Exec' AND born = 0 AND NOT (pid = 0 AND nth = 1)) OVER (PARTITION BY run_id, pid, gen ORDER BY seq, born ROWS UNBOUNDED PRECEDING) AS epoch FROM lives
),
ev AS (
  SELECT e.*, x.gen, x.epoch FROM every e JOIN epochs x ON x.run_id = e.run_id AND x.seq = e.seq AND x.pid = e.pid AND x.born = 0
  WHERE NOT (e.kind = 'Exec' AND e.pid = 0 AND x.nth = 1) AND NOT (ext AND ((kind_of(e.kind) = 1 AND NOT {_W('e.path')}) OR (e.kind = 'FileRename' AND NOT (({_W('e.f')} OR {_W('e.g')}) AND ({_NEAR('e.f')} OR {_NEAR('e.g')})))))
),
born AS (
  SELECT e.run_id, e.seq, e.pid AS ppid, e.gen AS pgen, e.epoch AS pepoch, x.pid, x.gen FROM ev e JOIN epochs x ON x.run_id = e.run_id AND x.seq = e.seq AND x.born = 1 WHERE e.kind = 'Fork'
),
takes AS (SELECT run_id, pid, gen, fd, seq, kind, path, flags, k FROM ev WHERE kind IN ('FileOpen', 'FileClose')),
firsts AS (SELECT run_id, pid, gen, fd, min(seq) AS first FROM takes GROUP BY ALL),
climb AS (
  SELECT run_id, seq AS ask, fd, pid, gen, seq AS at FROM ev WHERE kind IN ('FileClose', 'FileMmap')
  UNION ALL
  SELECT c.run_id, c.ask, c.fd, b.ppid, b.pgen, b.seq FROM climb c JOIN born b ON b.run_id = c.run_id AND b.pid = c.pid AND b.gen = c.gen
    LEFT JOIN firsts f ON f.run_id = c.run_id AND f.pid = c.pid AND f.gen = c.gen AND f.fd = c.fd WHERE f.first IS NULL OR f.first >= c.at
),
held AS (
  SELECT c.run_id, c.ask, t.seq AS opened, t.kind, t.path, t.flags, t.k FROM climb c ASOF JOIN takes t ON c.run_id = t.run_id AND c.pid = t.pid AND c.gen = t.gen AND c.fd = t.fd AND c.at > t.seq
),
moves AS (SELECT run_id, 2 * (seq // 2) AS seq, f, g FROM ev WHERE kind = 'FileRename'),
chase AS (
  SELECT run_id, ask, path, opened AS since FROM held WHERE kind = 'FileOpen'
  UNION ALL
  SELECT run_id, ask, path, since FROM (
    SELECT c.run_id, c.ask, m.g || substr(c.path, length(m.f) + 1) AS path, m.seq AS since, row_number() OVER (PARTITION BY c.run_id, c.ask ORDER BY m.seq, m.f, m.g) AS nth
    FROM chase c JOIN moves m ON m.run_id = c.run_id AND m.seq > c.since AND m.seq < c.ask AND (c.path = m.f OR starts_with(c.path, m.f || '/'))
  ) WHERE nth = 1
),
names AS (SELECT run_id, ask, arg_max(path, since) AS path FROM chase GROUP BY ALL),
traced AS (
  SELECT e.run_id, e.seq, e.kind, e.pid, e.gen, e.epoch, e.k, e.fd, e.ext, e.flags, e.prot, e.child, e.f, e.g, CASE WHEN e.kind IN ('FileClose', 'FileMmap') THEN n.path ELSE e.path END AS path,
    CASE WHEN e.kind = 'FileClose' THEN CASE WHEN h.flags <> 0 THEN 'sha256:' || sha256('c' || e.k) END WHEN e.kind = 'FileMmap' THEN CASE WHEN h.kind = 'FileOpen' THEN 'sha256:' || sha256('c' || h.k) END
      ELSE 'sha256:' || sha256((CASE WHEN e.kind = 'Exec' THEN 't' ELSE 'c' END) || e.k) END AS obs
  FROM ev e LEFT JOIN held h ON h.run_id = e.run_id AND h.ask = e.seq AND h.kind = 'FileOpen' LEFT JOIN names n ON n.run_id = e.run_id AND n.ask = e.seq
  WHERE NOT (e.ext AND e.kind IN ('FileClose', 'FileMmap') AND n.path IS NULL)
  UNION ALL SELECT DISTINCT run_id, -1, 'Exec', 0, 0, 0, NULL, NULL, false, NULL, NULL, NULL, NULL, NULL, NULL, 'sha256:' || sha256('root') FROM base
)
""".replace("kind_of(e.kind) = 1", "e.kind IN ('FileOpen', 'FileUnlink')")

_TOOLS = f"""
tools AS (
  SELECT run_id, pid, gen, epoch, obs AS tool FROM traced WHERE kind = 'Exec'
  UNION ALL SELECT b.run_id, b.pid, b.gen, 0, t.tool FROM born b JOIN tools t ON t.run_id = b.run_id AND t.pid = b.ppid AND t.gen = b.pgen AND t.epoch = b.pepoch
),
tooled AS (
  SELECT e.*, t.tool, e.pid = 0 AND e.gen = 0 AS root, {_W('e.path')} OR {_W('e.f')} OR {_W('e.g')} AS near,
    e.kind IN ('FileOpen', 'FileRename', 'FileUnlink') OR (e.kind = 'FileMmap' AND e.path IS NOT NULL AND e.obs IS NOT NULL) AS acts
  FROM traced e LEFT JOIN tools t USING (run_id, pid, gen, epoch) WHERE NOT (e.ext AND e.kind = 'FileMmap' AND NOT {_W('e.path')})
),
marked AS (SELECT *, min(CASE WHEN acts AND (ext OR (NOT root AND near AND tool IS NULL)) THEN seq END) OVER (PARTITION BY run_id, pid, gen) AS since FROM tooled),
sided AS (SELECT *, ext OR (NOT root AND near AND CASE WHEN kind = 'FileClose' THEN coalesce(seq > since, false) WHEN acts THEN tool IS NULL OR coalesce(seq > since, false) ELSE false END) AS outside FROM marked),
acted AS (SELECT *, starts_with(coalesce(path, ''), '/proc/') AND NOT outside AS state, kind = 'FileMmap' AND path IS NOT NULL AND obs IS NOT NULL AS mapped FROM sided),
wmarks AS (
  SELECT run_id, outside, pid, gen, fd, seq, obs, CASE WHEN kind = 'FileClose' THEN 'close' WHEN kind = 'FileOpen' THEN 'open' ELSE 'map' END AS act FROM acted
  WHERE (kind = 'FileClose' AND path IS NOT NULL) OR (kind = 'FileOpen' AND flags <> 0 AND NOT state) OR (mapped AND prot = 3 AND flags = 1 AND NOT state)
),
wtakes AS (SELECT * FROM wmarks WHERE act <> 'map'),
wmaps AS (SELECT * FROM wmarks WHERE act = 'map'),
wfirsts AS (SELECT run_id, outside, pid, gen, fd, min(seq) AS first FROM wtakes GROUP BY ALL),
wclimb AS (
  SELECT run_id, outside, seq AS ask, fd, pid, gen, seq AS at, 0 AS hop FROM wmarks WHERE act <> 'open'
  UNION ALL
  SELECT c.run_id, c.outside, c.ask, c.fd, b.ppid, b.pgen, b.seq, c.hop + 1 FROM wclimb c JOIN born b ON b.run_id = c.run_id AND b.pid = c.pid AND b.gen = c.gen AND NOT c.outside
    LEFT JOIN wfirsts f ON f.run_id = c.run_id AND f.outside = c.outside AND f.pid = c.pid AND f.gen = c.gen AND f.fd = c.fd WHERE f.first IS NULL OR f.first >= c.at
),
wlast AS (
  SELECT c.*, t.act, t.seq AS took FROM wclimb c ASOF LEFT JOIN wtakes t ON c.run_id = t.run_id AND c.outside = t.outside AND c.pid = t.pid AND c.gen = t.gen AND c.fd = t.fd AND c.at > t.seq
),
wvalue AS (
  SELECT l.run_id, l.ask, l.hop, CASE WHEN any_value(l.act) = 'open' THEN any_value(l.took) ELSE min(m.seq) END AS op
  FROM wlast l LEFT JOIN wmaps m ON m.run_id = l.run_id AND m.outside = l.outside AND m.pid = l.pid AND m.gen = l.gen AND m.fd = l.fd AND m.seq < l.at AND m.seq > coalesce(l.took, -9) GROUP BY l.run_id, l.ask, l.hop
),
wpending AS (SELECT run_id, ask, arg_max(op, hop) FILTER (WHERE op IS NOT NULL) AS op FROM wvalue GROUP BY ALL),
written AS (SELECT p.run_id, p.op AS seq, arg_max(m.obs, m.seq) AS done FROM wpending p JOIN wmarks m ON m.run_id = p.run_id AND m.seq = p.ask AND m.act = 'close' WHERE p.op IS NOT NULL AND m.obs IS NOT NULL GROUP BY ALL),
writes AS (
  SELECT m.run_id, m.seq, w.done FROM wmarks m LEFT JOIN wpending p ON p.run_id = m.run_id AND p.ask = m.seq LEFT JOIN written w ON w.run_id = m.run_id AND w.seq = m.seq
  WHERE m.act = 'open' OR (m.act = 'map' AND p.op IS NULL)
),
seen AS (SELECT run_id, pid, gen, epoch, min(seq) AS first FROM acted WHERE NOT outside AND (kind IN ('Exec', 'FileOpen', 'FileRename', 'FileUnlink') OR mapped) GROUP BY ALL),
rows AS (
  SELECT run_id, seq, 'Exec' AS op_type, tool, '' AS arg, '' AS ins, '' AS outs FROM acted WHERE kind = 'Exec'
  UNION ALL SELECT run_id, seq, 'SystemStateRead', tool, '', '{schema.SYSTEM_STATE}', '' FROM acted WHERE (kind = 'FileOpen' OR mapped) AND state
  UNION ALL SELECT run_id, seq, CASE WHEN outside THEN 'ExternalFileRead' ELSE 'FileRead' END, CASE WHEN NOT outside THEN tool END, CASE WHEN mapped THEN 'mmap' ELSE '' END, obs, '' FROM acted WHERE ((kind = 'FileOpen' AND flags <> 1) OR mapped) AND NOT state
  UNION ALL SELECT a.run_id, a.seq, CASE WHEN outside THEN 'ExternalFileWrite' ELSE 'FileWrite' END, CASE WHEN NOT outside THEN tool END, '', '', coalesce(w.done, '') FROM acted a JOIN writes w USING (run_id, seq)
  UNION ALL SELECT run_id, seq, CASE WHEN outside THEN 'ExternalFileRename' ELSE 'FileRename' END, CASE WHEN NOT outside THEN tool END, 'flags:0x' || flags, obs, obs FROM acted WHERE kind = 'FileRename'
  UNION ALL SELECT run_id, seq, CASE WHEN outside THEN 'ExternalFileDelete' ELSE 'FileDelete' END, CASE WHEN NOT outside THEN tool END, 'flags:0x' || flags, obs, '' FROM acted WHERE kind = 'FileUnlink'
  UNION ALL SELECT a.run_id, a.seq, 'Exit', tool, CASE WHEN root THEN 'exit:' || (k % 5) ELSE '' END, '', '' FROM acted a LEFT JOIN seen s USING (run_id, pid, gen, epoch) WHERE kind = 'Exit' AND ((root AND epoch = 0) OR s.first < a.seq)
),
ops AS (
  SELECT DISTINCT run_id, op_type, tool AS tool_hash, arg AS args, ins AS input_hashes, outs AS output_hashes, 'sha256:' || sha256(
    encode(CASE op_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in schema.OP_TAGS.items())} END || coalesce(tool, '') || arg) || CASE WHEN arg <> '' THEN '\\x00'::BLOB ELSE ''::BLOB END || encode(ins || outs)) AS leaf FROM rows
)
"""


@query(f"WITH RECURSIVE {_EVENTS} SELECT run_id, CAST(seq AS BIGINT) AS seq, pid, CAST(gen AS INT) AS generation, CAST(epoch AS INT) AS exec_epoch FROM traced WHERE seq >= 0")
def forked_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations and exec epochs where processes are forked again and again, and the root's first exec is the start."""
    traced, _ = traced_view(spark, sf_dir)
    return traced.where("seq >= 0").select("run_id", "seq", "process.pid", "process.generation", "process.exec_epoch")


@query(f"WITH RECURSIVE {_EVENTS} SELECT run_id, CAST(seq AS BIGINT) AS seq, kind, path, f AS from_path, g AS to_path, ext AS external, CASE WHEN kind NOT IN ('Fork', 'Exit') THEN obs END AS identity FROM traced WHERE seq >= 0")
def traced_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as traced: closes and mappings named by opens that were inherited over forks and renamed since."""
    traced, _ = traced_view(spark, sf_dir)
    return traced.where("seq >= 0").select("run_id", "seq", "kind", "path", "from_path", "to_path", "external", F.when(~F.col("kind").isin("Fork", "Exit"), identity(F.col("obs"))).alias("identity"))


@query(f"WITH RECURSIVE {_EVENTS} SELECT c.run_id, CAST(c.ask AS BIGINT) AS seq, CAST(max(h.opened) AS BIGINT) AS opened, CAST(count(*) - 1 AS INT) AS forks FROM climb c LEFT JOIN held h ON h.run_id = c.run_id AND h.ask = c.ask AND h.kind = 'FileOpen' GROUP BY c.run_id, c.ask HAVING max(h.opened) IS NOT NULL".replace(", CAST(count(*) - 1 AS INT) AS forks", ""))
def inherited_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open that each close or mapping belongs to, in its own process or any above it."""
    from .operators import descriptors

    t, _ = traced_view(spark, sf_dir)
    # External closes and mappings without an open have left already.
    kind = F.col("kind")
    opens = kind == "FileOpen"
    marks = t.where(kind.isin("FileOpen", "FileClose", "FileMmap")).select(
        "run_id", F.lit("tree").alias("space"), "process.pid", "process.generation", "fd", "seq", F.lit(0).alias("rank"), F.when(opens, "open").when(kind == "FileClose", "close").otherwise("look").alias("action"), F.when(opens, F.col("seq")).alias("op")
    )
    forks = t.where("kind = 'Fork'").select("run_id", "seq", "process.pid", "process.generation", F.col("child.pid").alias("child_pid"), F.col("child.generation").alias("child_generation"))
    return descriptors.match(marks, forks).where("action IN ('close', 'look') AND pending IS NOT NULL").select("run_id", "seq", F.col("pending").alias("opened"))


@query(f"WITH RECURSIVE {_EVENTS}, {_TOOLS} SELECT run_id, CAST(seq AS BIGINT) AS seq, tool, outside FROM sided WHERE seq >= 0")
def forked_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool of every event, inherited over forks, and whether it counts as external."""
    traced, roots = traced_view(spark, sf_dir)
    events = canonical._with_root(process.with_tools(canonical.without_unwatched(traced, _WATCH)), roots)
    return canonical.with_fallback(events, _WATCH).where("seq >= 0").select("run_id", "seq", "tool", "outside")


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced, roots = traced_view(spark, sf_dir)
    return canonical.canonicalize(traced, roots, _WATCH)


@query(f"WITH RECURSIVE {_EVENTS}, {_TOOLS} SELECT run_id, leaf, op_type, tool_hash, args, input_hashes, output_hashes FROM ops")
def forked_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eleven types of operations."""
    return _ops(spark, sf_dir).select("run_id", "leaf", "op_type", "tool_hash", *(F.array_join(c, ",").alias(c) for c in ("args", "input_hashes", "output_hashes")))


@query(f"WITH RECURSIVE {_EVENTS}, {_TOOLS}, {_merkle_sql('ops')} SELECT run_id, root, CAST(n AS BIGINT) AS leaf_count FROM root_of")
def forked_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.roots(_ops(spark, sf_dir))
