"""Queries over documents, files and sources: commitments, control files, source filters, working folders, slices of whole traces.

A customer stands for an attestation whose outputs are its orders; ``events``
and ``orders`` give names and contents of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans, schema
from .catalogue import _digest, _hex_text, _hex_u32, _merkle_sql, _numbered, _read, _text, query
from .forest import _EVENTS, _TOOLS, _ops, traced_view
from .functions import hashing, paths
from .operators import attest, canonical, compare, enrich, merkle, process, provenance
from .tables import materialize

# --- documents of customers ------------------------------------------------------------------------


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a customer: its orders are outputs, those of status F artifacts, their keys' digests the leaves; every kind of version, some of them altered."""
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), _text("o", F.col("o_orderkey")).alias("path"), _digest(F.col("o_orderkey")).alias("hash"), F.col("o_orderstatus").alias("status"))
    one = orders.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("path", "hash"))).alias("outputs"), F.sort_array(F.collect_list(F.when(F.col("status") == "F", F.col("path")))).alias("artifacts"), F.sort_array(F.collect_set("hash")).alias("leaves"))
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name").join(one, "key", "left")
    empty = F.array().cast("array<string>")
    c = c.withColumns({"outputs": F.coalesce("outputs", F.array().cast(f"array<{schema.OUTPUT}>")), "artifacts": F.coalesce("artifacts", empty), "leaves": F.coalesce("leaves", empty)})
    root = merkle.root_of(F.col("leaves"))
    mode = F.when(F.size("artifacts") > 0, "explicit").otherwise("inferred")
    c = c.withColumns({"root": root, "mode": mode, "command": F.array(F.lit("make"), F.lit("-j 2"), F.col("c_name")), "roots": empty})
    parts = [F.col(x) for x in ("root", "command", "mode", "artifacts", "roots", "outputs")]
    c = c.withColumns({"v02": hashing.commitment_v02(*parts), "v03": hashing.commitment_v03(*parts)})
    kind = F.col("key") % 5
    version = F.when(kind == 0, "0.1.0").when(kind == 1, "0.2.1").when(kind == 2, "0.2.0").otherwise("0.3.0")
    said = F.when(F.col("key") % 11 == 0, F.concat(F.lit("sha256:"), F.repeat(F.lit("0"), 64))).when(kind == 0, F.col("root")).when(kind.isin(1, 2), F.col("v02")).otherwise(F.col("v03"))
    # Old documents hold all nodes instead of leaves: the last half of a full tree, and here what stands before it is a filler.
    n = F.size("leaves")
    whole = F.when(n > 1, F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double"))))).otherwise(n).cast("int")
    padded = F.concat("leaves", F.array_repeat(F.lit(merkle.PADDING), whole - n))
    nodes = F.concat(F.array_repeat(F.lit("inner"), F.greatest(whole - 1, F.lit(0))), padded)
    nodes = F.transform(nodes, lambda h: F.struct(h.alias("hash"), F.lit(False).alias("is_leaf")))
    none = F.array().cast("array<struct<hash:string,is_leaf:boolean>>")
    tree = F.struct(F.when(kind == 0, empty).otherwise(F.col("leaves")).alias("leaves"), F.when(kind == 0, nodes).otherwise(none).alias("nodes"), (n + F.when(F.col("key") % 13 == 0, 1).otherwise(0) * F.when(kind == 0, 0).otherwise(1)).cast("long").alias("leaf_count"))
    return c.select(
        F.col("key").alias("run_id"), version.alias("version"), F.lit("process-provenance").alias("predicate_type"), said.alias("root_hash"), F.when(kind == 4, F.lit("")).otherwise(F.col("root")).alias("process_root"), "command",
        F.struct("mode", "artifacts", F.col("roots").alias("output_roots")).alias("output_selection"), "outputs", tree.alias("tree"), "v02", "v03", F.col("key").cast("string").alias("source"),
    )


_CUSTOMERS = f"""
ord AS (SELECT o_custkey AS key, 'o' || o_orderkey AS path, 'sha256:' || sha256(CAST(o_orderkey AS VARCHAR)) AS hash, o_orderstatus AS status FROM orders),
outs AS (SELECT key, count(*) AS n, {_hex_u32('count(*)')} || string_agg({_hex_text('path')} || {_hex_text('hash')}, '' ORDER BY path) AS h, string_agg('{{"path":"' || path || '","hash":"' || hash || '"}}', ',' ORDER BY path) AS j FROM ord GROUP BY 1),
arts AS (SELECT key, count(*) AS n, {_hex_u32('count(*)')} || string_agg({_hex_text('path')}, '' ORDER BY path) AS h, string_agg('"' || path || '"', ',' ORDER BY path) AS j FROM ord WHERE status = 'F' GROUP BY 1),
cleaf AS (SELECT key, hash AS leaf FROM ord), {_merkle_sql('cleaf', 'key')},
parts AS (
  SELECT c_custkey AS key, c_name, coalesce(r.root, 'sha256:' || sha256('emptyempty')) AS root, coalesce(r.n, 0) AS n, CASE WHEN a.n > 0 THEN 'explicit' ELSE 'inferred' END AS mode,
    coalesce(o.h, {_hex_u32('0')}) AS oh, coalesce(o.j, '') AS oj, coalesce(a.h, {_hex_u32('0')}) AS ah, coalesce(a.j, '') AS aj
  FROM customer LEFT JOIN root_of r ON r.key = c_custkey LEFT JOIN outs o ON o.key = c_custkey LEFT JOIN arts a ON a.key = c_custkey
),
docs AS (
  SELECT *, 'sha256:' || sha256('{{"domain":"{schema.COMMITMENT_V02}","process_root":"' || root || '","command":["make","-j 2","' || c_name || '"],"output_selection":{{"mode":"' || mode || '","artifacts":[' || aj || '],"output_roots":[]}},"outputs":[' || oj || ']}}') AS v02,
    'sha256:' || sha256(unhex({_hex_text(f"'{schema.COMMITMENT_V03}'")} || {_hex_text('root')} || {_hex_u32('3')} || {_hex_text("'make'")} || {_hex_text("'-j 2'")} || {_hex_text('c_name')} || {_hex_text('mode')} || ah || {_hex_u32('0')} || oh)) AS v03
  FROM parts
)
"""


@query(f"WITH RECURSIVE {_CUSTOMERS} SELECT key AS customer, v02, v03 FROM docs")
def customer_commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_documents(spark, sf_dir).select(F.col("run_id").alias("customer"), "v02", "v03")


@query(f"""
WITH RECURSIVE {_CUSTOMERS} SELECT key AS customer, root AS computed_root, CASE WHEN key % 11 = 0 THEN CASE WHEN key % 5 = 0 THEN 'root does not match the tree' ELSE 'root does not match the commitment' END END AS error,
  CASE WHEN key % 13 = 0 AND key % 5 <> 0 THEN 'leaf count does not match the leaves' END AS warning FROM docs
""")
def customer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all versions, read as they are: old ones from their nodes."""
    return attest.validated(customer_documents(spark, sf_dir)).select(F.col("run_id").alias("customer"), "computed_root", "error", "warning")


@query(f"WITH RECURSIVE {_CUSTOMERS} SELECT CASE key % 5 WHEN 0 THEN '0.1.0' WHEN 1 THEN '0.2.1' WHEN 2 THEN '0.2.0' ELSE '0.3.0' END AS version, 'make ''-j 2'' ' || CASE WHEN regexp_full_match(c_name, '[A-Za-z0-9/._=:+-]+') THEN c_name ELSE '''' || c_name || '''' END AS command, mode, CAST(coalesce(outs.n, 0) AS INT) AS outputs, CAST(docs.n + CASE WHEN key % 13 = 0 AND key % 5 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS operations FROM docs LEFT JOIN outs USING (key)")
def explained_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.explain(customer_documents(spark, sf_dir).drop("v02", "v03")).select("version", "command", "mode", "outputs", "operations")


@query(f"""
WITH RECURSIVE {_CUSTOMERS}, again AS (SELECT key, CASE WHEN key % 7 = 0 THEN 'command differs' WHEN key % 17 = 0 THEN 'root differs' END AS said FROM docs)
SELECT key AS customer, CASE WHEN key % 11 = 0 THEN CASE WHEN key % 5 = 0 THEN 'root does not match the tree' ELSE 'root does not match the commitment' END WHEN key % 19 = 0 THEN 'nothing to compare with' ELSE said END AS verdict FROM again
""")
def verified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against one made again: some with another command, some with another root, some never made."""
    docs = customer_documents(spark, sf_dir)
    other = F.when(F.col("run_id") % 17 == 0, F.concat(F.lit("sha256:"), F.repeat(F.lit("1"), 64))).otherwise(F.col("root_hash"))
    again = docs.where("run_id % 19 <> 0").withColumns({"command": F.when(F.col("run_id") % 7 == 0, F.array(F.lit("ninja"))).otherwise(F.col("command")), "root_hash": other})
    return plans.verify(docs, again).select(F.col("run_id").alias("customer"), "verdict")


# --- files -----------------------------------------------------------------------------------------


def _control_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import configurations, cache entries, and files that only look like them, from the numbers of events."""
    e = _read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("event_id") % 9).alias("c"))
    k, c = F.col("k"), F.col("c")
    key = F.sha2(k.cast("string").cast("binary"), 256)
    folder = F.substring(key, 1, 2)
    config = F.when(c.isin(2, 3), _text("/w/", k, "/importcfg")).otherwise(_text("/tmp/x/go-build", k, "/b001/importcfg", F.when(k % 2 == 0, F.lit(".link")).otherwise(F.lit(""))))
    entry = F.concat(F.lit("/c/"), F.when(c == 8, F.lit("zz")).otherwise(folder), F.lit("/"), key, F.lit("-a"))
    path = F.when(c < 5, config).otherwise(entry)
    lines = F.concat(F.lit("# import config\npackagefile fmt=/tmp/t/go-build"), k.cast("string"), F.lit("/b002/_pkg_.a\nimportmap a=b\npackageshlib os=/usr/lib/go"), k.cast("string"), F.lit(".so\n"))
    stable = F.concat(F.lit("packagefile fmt=/store/"), k.cast("string"), F.lit("/fmt.a\n"))
    unknown = F.concat(lines, F.lit("surprise\n"))
    ids = F.sha2(F.concat(F.lit("o"), k.cast("string")).cast("binary"), 256)
    cache = F.concat(F.lit("v1 "), key, F.lit(" "), ids, F.lit(" "), F.lpad(k.cast("string"), 20, " "), F.lit(" "), F.lpad((k * 1000 + 7).cast("string"), 20, " "), F.lit("\n"))
    text = F.when(c.isin(0, 2), lines).when(c == 1, stable).when(c.isin(3, 4), unknown).when(c == 6, F.substring(cache, 1, 174)).otherwise(cache)
    return e.select("event_id", path.alias("path"), text.alias("text"))


_CONTROL = r"""
e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 9 AS c FROM events),
keyed AS (SELECT *, sha256(CAST(k AS VARCHAR)) AS key, sha256('o' || k) AS oid FROM e),
files AS (
  SELECT event_id, k, c, key, oid,
    CASE WHEN c IN (0, 2) THEN '# import config' || chr(10) || 'packagefile fmt=/tmp/t/go-build' || k || '/b002/_pkg_.a' || chr(10) || 'importmap a=b' || chr(10) || 'packageshlib os=/usr/lib/go' || k || '.so' || chr(10)
      WHEN c = 1 THEN 'packagefile fmt=/store/' || k || '/fmt.a' || chr(10)
      WHEN c IN (3, 4) THEN '# import config' || chr(10) || 'packagefile fmt=/tmp/t/go-build' || k || '/b002/_pkg_.a' || chr(10) || 'importmap a=b' || chr(10) || 'packageshlib os=/usr/lib/go' || k || '.so' || chr(10) || 'surprise' || chr(10)
      ELSE left('v1 ' || key || ' ' || oid || ' ' || lpad(CAST(k AS VARCHAR), 20, ' ') || ' ' || lpad(CAST(k * 1000 + 7 AS VARCHAR), 20, ' ') || chr(10), CASE WHEN c = 6 THEN 174 ELSE 175 END) END AS text
  FROM keyed
)
"""


@query(rf"""
WITH {_CONTROL} SELECT event_id, 'sha256:' || CASE
    WHEN c = 0 THEN sha256(encode('{schema.IMPORT_CONFIG_DOMAIN[:-1].decode()}') || '\x00'::BLOB || encode(replace(text, '/tmp/t/go-build' || k || '/', '$WORK/')))
    WHEN c IN (5, 7) THEN sha256(encode('{schema.CACHE_ENTRY_DOMAIN[:-1].decode()}') || '\x00'::BLOB || encode(left(text, 153) || ' ' || lpad('0', 20, ' ') || chr(10)))
    ELSE sha256(text) END AS identity FROM files
""")
def control_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What build tools write is hashed without folders and times of the session; what only resembles it as it is."""
    return _control_files(spark, sf_dir).select("event_id", paths.file_hash(F.col("path"), F.col("text").cast("binary")).alias("identity"))


_ARGS = ["", "plain", "two words", "it''s", "a=b", "x;y", "-j", "é"]


@query(f"SELECT event_id, 'make ' || CASE WHEN a = '' THEN '''''' WHEN regexp_full_match(a, '[A-Za-z0-9/._=:+-]+') THEN a ELSE '''' || replace(a, '''', '''\"''\"''') || '''' END AS command FROM (SELECT event_id, ([{', '.join(f"'{a}'" for a in _ARGS)}])[1 + event_id % {len(_ARGS)}] AS a FROM events)")
def command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = F.array(*(F.lit(a.replace("''", "'")) for a in _ARGS))
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", paths.shell_command(F.array(F.lit("make"), F.get(args, (F.col("event_id") % len(_ARGS)).cast("int")))).alias("command"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'd' || user_id || '/f' WHEN 1 THEN '' WHEN 2 THEN '/workspace/x' ELSE 'rel/y' END AS shown FROM events")
def display_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("event_id") % 4
    path = F.when(c == 0, _text("/work/d", F.col("user_id"), "/f")).when(c == 1, "/work").when(c == 2, "/workspace/x").otherwise("rel/y")
    return _read(spark, sf_dir, "events").select("event_id", paths.display(path, "/work/").alias("shown"))


# --- sources ---------------------------------------------------------------------------------------


def _odd_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw records of which some are broken, failed, by strangers, or by processes below the root."""
    e = _numbered(spark, sf_dir)
    k, u = F.col("k"), F.col("user_id")
    kind = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 5).when(F.col("event_type") == "error", 8).when(F.col("event_type") == "signup", F.when(k % 2 == 0, 9).otherwise(3)).otherwise(F.when(k % 3 == 0, 99).otherwise(2))
    null = lambda t: F.lit(None).cast(t)
    path = F.when(k % 17 == 0, F.lit("\x00\x00")).when(k % 5 == 0, _text("rel/", k)).otherwise(_text("/w/d", k % 10, "/f", k, "\x00\x00"))
    return e.select(
        "run_id", kind.alias("kind"), F.when(u % 6 == 5, 1).otherwise(0).alias("source"), (F.col("seq") * 1000).alias("timestamp_ns"), u.alias("pid"), u.alias("tgid"), F.when(kind.isin(1, 2, 5), (k % 6).cast("int") - 1).alias("fd"),
        F.lit(schema.AT_FDCWD).alias("dfd"), (k % 2 + F.when(k % 9 == 0, schema.O_TRUNC).otherwise(0)).cast("long").alias("flags"), null("long").alias("prot"), F.when(kind.isin(1, 3, 8), path).alias("path"), null("int").alias("path_len"), F.col("event_id").alias("operation_id"), null("int").alias("exit_code"),
        u.alias("parent_pid"), F.when(kind == 9, 2 * u + 1).cast("long").alias("child_pid"), null("string").alias("proc_target"), F.when(k % 7 == 0, _text("/c", k % 3)).alias("cwd"),
    )


_ODD_RAW = r"""
b AS (SELECT event_id, ts, user_id AS u, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST((day(ts) - 1) // 7 AS BIGINT) AS run_id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq FROM b),
raw AS (
  SELECT *, CASE t WHEN 'click' THEN 1 WHEN 'view' THEN 5 WHEN 'error' THEN 8 WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 9 ELSE 3 END ELSE CASE WHEN k % 3 = 0 THEN 99 ELSE 2 END END AS kind, k % 6 - 1 AS fd, u % 6 = 5 AS stranger,
    CASE WHEN k % 17 = 0 THEN NULL WHEN k % 5 = 0 THEN 'rel/' || k ELSE '/w/d' || (k % 10) || '/f' || k END AS path, CASE WHEN k % 7 = 0 THEN '/c' || (k % 3) END AS cwd FROM n
),
bad AS (SELECT *, kind > 9 OR (kind IN (1, 3, 8) AND path IS NULL) AS broken FROM raw)
"""


@query(f"WITH {_ODD_RAW} SELECT run_id, CAST(count(*) AS BIGINT) AS dropped FROM bad WHERE broken GROUP BY 1")
def dropped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of unknown kind or without a path, per run."""
    return enrich.traced(_odd_raw(spark, sf_dir), None, None, ["/w"])[1].select("run_id", "dropped")


@query(f"""
WITH {_ODD_RAW} SELECT run_id, CAST(seq AS BIGINT) AS seq, CAST(kind AS INT) AS kind FROM bad
WHERE NOT (kind IN (1, 5) AND fd < 0) AND NOT (stranger AND kind = 1 AND path IS NOT NULL AND CASE WHEN starts_with(path, '/') THEN NOT (starts_with(path, '/w/d1') OR starts_with(path, '/w/d3/')) ELSE k % 2 = 0 END)
  AND NOT (stranger AND kind = 8 AND path IS NOT NULL AND starts_with(path, '/') AND NOT (starts_with(path, '/w/d1') OR starts_with(path, '/w/d3/')))
""")
def admitted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the source's filters pass on."""
    raw = _odd_raw(spark, sf_dir).withColumn("path", paths.decode(F.col("path")))
    return enrich.admitted(raw, ["/w/d1", "/w/d3/"]).select("run_id", (F.col("timestamp_ns") / 1000).cast("long").alias("seq"), "kind")


@query(f"""
WITH RECURSIVE {_ODD_RAW}, forks AS (SELECT DISTINCT run_id, u, 2 * u + 1 AS child FROM raw WHERE kind = 9),
below AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS u FROM raw UNION SELECT f.run_id, f.child FROM below b JOIN forks f ON f.run_id = b.run_id AND f.u = b.u)
SELECT raw.run_id, CAST(seq AS BIGINT) AS seq FROM raw LEFT JOIN below USING (run_id, u) WHERE stranger OR below.run_id IS NOT NULL
""")
def tracked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of processes that were forked below process 0, and all that strangers did."""
    raw = _odd_raw(spark, sf_dir)
    roots = raw.select("run_id", F.lit(0).cast("long").alias("pid")).distinct()
    return enrich.tracked(raw, roots).select("run_id", (F.col("timestamp_ns") / 1000).cast("long").alias("seq"))


@query(f"""
WITH RECURSIVE {_ODD_RAW}, good AS (SELECT * FROM bad WHERE NOT broken AND NOT (kind IN (1, 5) AND fd < 0) AND NOT stranger),
sights AS (SELECT run_id, seq, u AS pid, 0 AS born FROM good UNION ALL SELECT run_id, seq, 2 * u + 1, 1 FROM good WHERE kind = 9),
lives AS (SELECT *, sum(born) OVER w + CASE WHEN first_value(born) OVER w = 0 THEN 1 ELSE 0 END - 1 AS gen FROM sights WINDOW w AS (PARTITION BY run_id, pid ORDER BY seq, born ROWS UNBOUNDED PRECEDING)),
ev AS (SELECT g.*, l.gen FROM good g JOIN lives l ON l.run_id = g.run_id AND l.seq = g.seq AND l.pid = g.u AND l.born = 0),
born AS (SELECT e.run_id, e.seq, e.u AS ppid, e.gen AS pgen, l.pid, l.gen FROM ev e JOIN lives l ON l.run_id = e.run_id AND l.seq = e.seq AND l.born = 1 WHERE e.kind = 9),
said AS (SELECT run_id, u AS pid, gen, seq, cwd FROM ev WHERE kind IN (1, 3, 8) AND NOT starts_with(path, '/') AND cwd IS NOT NULL),
firsts AS (SELECT run_id, pid, gen, min(seq) AS first FROM said GROUP BY ALL),
climb AS (
  SELECT run_id, seq AS ask, u AS pid, gen, seq + 1 AS at FROM ev WHERE kind IN (1, 3, 8) AND NOT starts_with(path, '/')
  UNION ALL SELECT c.run_id, c.ask, b.ppid, b.pgen, b.seq FROM climb c JOIN born b ON b.run_id = c.run_id AND b.pid = c.pid AND b.gen = c.gen
    LEFT JOIN firsts f ON f.run_id = c.run_id AND f.pid = c.pid AND f.gen = c.gen WHERE f.first IS NULL OR f.first >= c.at
),
home AS (SELECT c.run_id, c.ask, s.cwd FROM climb c ASOF JOIN said s ON s.run_id = c.run_id AND s.pid = c.pid AND s.gen = c.gen AND c.at > s.seq)
SELECT e.run_id, CAST(e.seq AS BIGINT) AS seq, CASE WHEN starts_with(path, '/') THEN path ELSE coalesce(h.cwd, '/home') || '/' || path END AS path FROM ev e LEFT JOIN home h ON h.run_id = e.run_id AND h.ask = e.seq WHERE kind IN (1, 8)
""")
def folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative paths below the working folder that a process last had, took over at its fork, or has from the root."""
    raw = _odd_raw(spark, sf_dir).where("source = 0")
    homes = raw.select("run_id", F.lit(-1).cast("long").alias("pid"), F.lit("/home").alias("cwd")).distinct()
    events, _ = enrich.traced(raw, None, homes, [])
    numbers = raw.select("run_id", "timestamp_ns").groupBy("run_id").agg(F.sort_array(F.collect_list("timestamp_ns")).alias("t"))
    return events.where("kind IN ('FileOpen', 'FileUnlink')").join(numbers, "run_id").select("run_id", (F.element_at("t", (F.col("seq") / 2).cast("int")) / 1000).cast("long").alias("seq"), "path")


@query(f"""
WITH {_ODD_RAW} SELECT run_id, CAST(seq AS BIGINT) AS seq, CASE WHEN k % 9 = 0 THEN '{schema.EMPTY_CONTENT}' WHEN k % 4 = 1 THEN 'missing:sha256:' || sha256('m' || k) ELSE 'sha256:' || sha256('c' || k) END AS identity
FROM bad WHERE NOT broken AND kind = 1 AND fd >= 0 AND NOT stranger
""")
def open_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What opens saw: nothing, where they truncate."""
    raw = _odd_raw(spark, sf_dir).where("source = 0")
    e = _read(spark, sf_dir, "events").select(F.col("event_id").alias("operation_id"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    gone = F.col("k") % 4 == 1
    obs = F.struct(F.when(gone, "missing").otherwise("content").alias("kind"), _digest(F.when(gone, "m").otherwise("c"), F.col("k")).alias("hash"))
    seen = raw.join(e, "operation_id").select("run_id", "timestamp_ns", "pid", "kind", obs.alias("obs"))
    events, _ = enrich.traced(raw, seen, None, [])
    numbers = raw.select("run_id", "timestamp_ns").groupBy("run_id").agg(F.sort_array(F.collect_list("timestamp_ns")).alias("t"))
    return events.where("kind = 'FileOpen'").join(numbers, "run_id").select("run_id", (F.element_at("t", (F.col("seq") / 2).cast("int")) / 1000).cast("long").alias("seq"), paths.identity(F.col("obs")).alias("identity"))


@query(f"WITH {_ODD_RAW} SELECT run_id, event_id AS operation_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq // 10, kind, u, event_id) AS BIGINT) AS seq FROM raw")
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of events, ten of which share a time."""
    raw = _odd_raw(spark, sf_dir).withColumn("timestamp_ns", F.floor(F.col("timestamp_ns") / 10_000))
    return process.sequence(raw).select("run_id", "operation_id", "seq")


_DIFF = """
e AS (SELECT source || '/' || doc_id AS path, 'sha256:' || sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 5 <> 0),
a AS (SELECT source || '/' || doc_id AS path, 'sha256:' || sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 0),
d AS (SELECT path, CASE WHEN a.hash IS NULL THEN 'missing' WHEN e.hash IS NULL THEN 'added' ELSE 'changed' END AS change FROM e FULL JOIN a USING (path) WHERE e.hash IS DISTINCT FROM a.hash),
l AS (SELECT 'missing' AS side, hash FROM (SELECT hash FROM e EXCEPT SELECT hash FROM a) UNION ALL SELECT 'added', hash FROM (SELECT hash FROM a EXCEPT SELECT hash FROM e))
"""


@query(f"""
WITH {_DIFF} SELECT * FROM (SELECT 'output' AS part, path AS item, change FROM d ORDER BY path LIMIT 20)
UNION ALL SELECT 'count', CAST(count(*) AS VARCHAR), change FROM d GROUP BY change
UNION ALL SELECT 'leaf', hash, side FROM l QUALIFY row_number() OVER (PARTITION BY side ORDER BY hash) <= 12
UNION ALL SELECT 'summary', 'command', 'same' UNION ALL SELECT 'summary', 'root_hash', 'differs' UNION ALL SELECT 'summary', 'operations', CASE WHEN (SELECT count(DISTINCT hash) FROM e) = (SELECT count(DISTINCT hash) FROM a) THEN 'same' ELSE 'differs' END
""")
def document_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents, each with all texts as outputs: what differs, as it is shown."""
    d = _read(spark, sf_dir, "documents")

    def document(rows: DataFrame, text: Column) -> DataFrame:
        outs = rows.select(F.lit(0).cast("long").alias("run_id"), _text(F.col("source"), "/", F.col("doc_id")).alias("path"), hashing.sha256(text.cast("binary")).alias("hash"))
        # Texts are hashed once, and each document is made once for all that is shown of it.
        outs = materialize(outs, "outputs")
        return materialize(attest.assemble(outs.select("run_id", F.col("hash").alias("leaf")), outs, ["make"]), "document")

    expected = document(d.where("doc_id % 5 <> 0"), F.when(F.col("doc_id") % 7 == 0, _text(F.col("text"), "x")).otherwise(F.col("text")))
    found = plans.diff(expected, document(d.where("doc_id % 3 <> 0"), F.col("text")))
    rows = found["outputs"].select(F.lit("output").alias("part"), F.col("path").alias("item"), "change")
    rows = rows.unionByName(found["output_counts"].select(F.lit("count").alias("part"), F.col("count").cast("string").alias("item"), "change"))
    rows = rows.unionByName(found["leaves"].select(F.lit("leaf").alias("part"), F.col("leaf").alias("item"), F.col("side").alias("change")))
    for c in ("command", "root_hash", "operations"):
        rows = rows.unionByName(found["summary"].select(F.lit("summary").alias("part"), F.lit(c).alias("item"), F.when(F.col(f"same_{c}"), "same").otherwise("differs").alias("change")))
    return rows


# --- whole traces: summaries, slices, harness -----------------------------------------------------------


def _slice_outputs(traced: DataFrame) -> DataFrame:
    """What is left at the end under some of the paths: what the last close saw there, and files that nobody wrote."""
    last = traced.where("kind = 'FileClose' AND path IS NOT NULL AND obs IS NOT NULL AND NOT external").groupBy("run_id", "path").agg(F.max_by("obs.hash", "seq").alias("hash"))
    lost = traced.where("kind = 'Fork'").select("run_id", F.lit("/never").alias("path"), _digest("never").alias("hash")).distinct()
    return last.where("run_id <> 2").unionByName(lost.where("run_id <> 2"))


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced, roots = traced_view(spark, sf_dir)
    return provenance.canonicalize_slice(traced, roots, _slice_outputs(traced))


_FLOWS = f"""
inside AS (SELECT *, starts_with(coalesce(path, ''), '/proc/') AS state, kind = 'FileMmap' AND path IS NOT NULL AND obs IS NOT NULL AS mapped FROM traced WHERE NOT ext),
outs AS (
  SELECT run_id, path, arg_max(obs, seq) AS hash FROM inside WHERE kind = 'FileClose' AND path IS NOT NULL AND obs IS NOT NULL AND run_id <> 2 GROUP BY ALL
  UNION ALL SELECT DISTINCT run_id, '/never', 'sha256:' || sha256('never') FROM inside WHERE kind = 'Fork' AND run_id <> 2
),
who AS (
  SELECT DISTINCT run_id, pid, gen, epoch FROM inside WHERE kind <> 'FileUnlink' UNION SELECT run_id, pid, gen, 0 FROM born
),
flows AS (SELECT w.*, t.tool, EXISTS (FROM inside x WHERE x.kind = 'Exec' AND x.run_id = w.run_id AND x.pid = w.pid AND x.gen = w.gen AND x.epoch = w.epoch) AS ran FROM who w LEFT JOIN tools t USING (run_id, pid, gen, epoch)),
renamed AS (SELECT DISTINCT run_id, pid, gen, epoch, obs AS h FROM inside WHERE kind = 'FileRename'),
reads AS (
  SELECT DISTINCT run_id, pid, gen, epoch, CASE WHEN state THEN '{schema.SYSTEM_STATE}' ELSE obs END AS h FROM inside WHERE (kind = 'FileOpen' AND flags <> 1) OR mapped
  UNION SELECT * FROM renamed
),
fmarks AS (
  SELECT run_id, pid, gen, epoch, fd, seq, path, obs, kind = 'FileClose' AS shut FROM inside WHERE kind = 'FileClose' OR (kind = 'FileOpen' AND flags <> 0) OR (mapped AND prot = 3 AND flags = 1)
),
ffirsts AS (SELECT run_id, pid, gen, fd, min(seq) AS first FROM fmarks GROUP BY ALL),
fclimb AS (
  SELECT run_id, seq AS ask, fd, pid, gen, seq AS at FROM fmarks WHERE shut
  UNION ALL SELECT c.run_id, c.ask, c.fd, b.ppid, b.pgen, b.seq FROM fclimb c JOIN born b ON b.run_id = c.run_id AND b.pid = c.pid AND b.gen = c.gen
    LEFT JOIN ffirsts f ON f.run_id = c.run_id AND f.pid = c.pid AND f.gen = c.gen AND f.fd = c.fd WHERE f.first IS NULL OR f.first >= c.at
),
fheld AS (
  SELECT c.run_id, c.ask, m.seq AS opened, m.path AS opath, m.pid, m.gen, m.epoch, m.shut FROM fclimb c ASOF JOIN fmarks m ON c.run_id = m.run_id AND c.pid = m.pid AND c.gen = m.gen AND c.fd = m.fd AND c.at > m.seq
),
fended AS (
  SELECT h.run_id, h.ask, h.opened, h.pid, h.gen, h.epoch, coalesce(c.path, h.opath) AS path, c.obs AS h FROM fheld h JOIN fmarks c ON c.run_id = h.run_id AND c.seq = h.ask AND c.shut WHERE NOT h.shut AND c.obs IS NOT NULL
),
wrote AS (SELECT DISTINCT run_id, pid, gen, epoch, h FROM fended),
smoves AS (SELECT run_id, seq, f, g, pid, gen, epoch FROM inside WHERE kind = 'FileRename'),
one AS (
  SELECT run_id, path, pid, gen, epoch, ask AS avail FROM fended UNION SELECT run_id, g, pid, gen, epoch, seq FROM smoves
  UNION SELECT o.run_id, m.g || substr(o.path, length(m.f) + 1), o.pid, o.gen, o.epoch, m.seq FROM one o JOIN smoves m ON m.run_id = o.run_id AND m.seq > o.avail AND (o.path = m.f OR starts_with(o.path, m.f || '/'))
),
two AS (
  SELECT DISTINCT run_id, path AS origin, path, CAST(-1 AS BIGINT) AS avail FROM one
  UNION SELECT o.run_id, o.origin, m.g || substr(o.path, length(m.f) + 1), m.seq FROM two o JOIN smoves m ON m.run_id = o.run_id AND m.seq > o.avail AND (o.path = m.f OR starts_with(o.path, m.f || '/'))
),
bypath AS (SELECT DISTINCT one.run_id, two.path, one.pid, one.gen, one.epoch FROM one JOIN two ON two.run_id = one.run_id AND two.origin = one.path),
byhash AS (SELECT * FROM wrote UNION SELECT * FROM renamed),
included AS (
  SELECT DISTINCT p.run_id, p.pid, p.gen, p.epoch FROM outs o JOIN bypath p ON p.run_id = o.run_id AND p.path = o.path
  UNION SELECT w.run_id, w.pid, w.gen, w.epoch FROM included i JOIN reads r USING (run_id, pid, gen, epoch) JOIN byhash w ON w.run_id = r.run_id AND w.h = r.h WHERE NOT EXISTS (FROM outs o WHERE o.run_id = r.run_id AND o.hash = r.h)
),
relevant AS (SELECT run_id, hash AS h FROM outs UNION SELECT r.run_id, r.h FROM reads r JOIN included i USING (run_id, pid, gen, epoch)),
emitted AS (SELECT w.run_id, w.h FROM wrote w JOIN included i USING (run_id, pid, gen, epoch) JOIN relevant r ON r.run_id = w.run_id AND r.h = w.h UNION SELECT w.run_id, w.h FROM renamed w JOIN included i USING (run_id, pid, gen, epoch) JOIN relevant r ON r.run_id = w.run_id AND r.h = w.h),
orphans AS (SELECT DISTINCT o.run_id, o.hash AS h FROM outs o WHERE NOT EXISTS (FROM emitted e WHERE e.run_id = o.run_id AND e.h = o.hash)),
credited AS (SELECT o.run_id, o.h, min({{'pid': b.pid, 'gen': b.gen, 'epoch': b.epoch}}) FILTER (WHERE b.pid IS NOT NULL) AS w FROM orphans o LEFT JOIN byhash b ON b.run_id = o.run_id AND b.h = o.h GROUP BY ALL),
gone AS (SELECT run_id, arg_max({{'pid': pid, 'gen': gen, 'epoch': epoch, 'k': k}}, seq) AS x FROM inside WHERE kind = 'Exit' AND pid = 0 AND gen = 0 AND run_id IN (SELECT run_id FROM outs) GROUP BY 1),
srows AS (
  SELECT i.run_id, 'Exec' AS op_type, f.tool, '' AS arg, '' AS ins, '' AS o FROM included i JOIN flows f USING (run_id, pid, gen, epoch) WHERE ran AND f.tool IS NOT NULL
  UNION ALL SELECT i.run_id, 'FileRead', f.tool, '', r.h, '' FROM included i JOIN flows f USING (run_id, pid, gen, epoch) JOIN reads r USING (run_id, pid, gen, epoch)
  UNION ALL SELECT i.run_id, 'FileWrite', f.tool, '', '', w.h FROM included i JOIN flows f USING (run_id, pid, gen, epoch) JOIN wrote w USING (run_id, pid, gen, epoch) JOIN relevant r ON r.run_id = w.run_id AND r.h = w.h
  UNION ALL SELECT i.run_id, 'FileRename', f.tool, '', w.h, w.h FROM included i JOIN flows f USING (run_id, pid, gen, epoch) JOIN renamed w USING (run_id, pid, gen, epoch) JOIN relevant r ON r.run_id = w.run_id AND r.h = w.h
  UNION ALL SELECT c.run_id, 'FileWrite', f.tool, CASE WHEN c.w IS NULL THEN 'output' ELSE '' END, '', c.h FROM credited c LEFT JOIN flows f ON f.run_id = c.run_id AND f.pid = c.w.pid AND f.gen = c.w.gen AND f.epoch = c.w.epoch
  UNION ALL SELECT g.run_id, 'Exit', f.tool, 'exit:' || (g.x.k % 5), '', '' FROM gone g LEFT JOIN flows f ON f.run_id = g.run_id AND f.pid = g.x.pid AND f.gen = g.x.gen AND f.epoch = g.x.epoch
),
sops AS (
  SELECT DISTINCT run_id, op_type, tool AS tool_hash, arg AS args, 'sha256:' || sha256(
    encode(CASE op_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in schema.OP_TAGS.items())} END || coalesce(tool, '') || arg) || CASE WHEN arg <> '' THEN '\\x00'::BLOB ELSE ''::BLOB END || encode(ins || o)) AS leaf FROM srows
)
"""


@query(f"WITH RECURSIVE {_EVENTS}, {_TOOLS.split('tooled AS (')[0].rstrip().rstrip(',')}, {_FLOWS} SELECT run_id, leaf, op_type, tool_hash, args FROM sops")
def forked_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What explains the outputs of whole traces: written over forks and renames, orphans, the root's exit; run 2 has no outputs."""
    return _sliced(spark, sf_dir).select("run_id", "leaf", "op_type", "tool_hash", F.array_join("args", ",").alias("args"))


@query(f"""
WITH RECURSIVE {_EVENTS}, {_TOOLS.split('tooled AS (')[0].rstrip().rstrip(',')}, {_FLOWS} SELECT run_id, CAST(count(*) AS BIGINT) AS ops, CAST(count(*) FILTER (WHERE op_type = 'FileWrite') AS BIGINT) AS writes, CAST(count(*) FILTER (WHERE op_type = 'Exit') AS BIGINT) AS exits,
  CAST(count(DISTINCT tool_hash) AS BIGINT) AS tools, CAST(count(*) FILTER (WHERE op_type IN ('FileRead', 'FileWrite') AND tool_hash IS NULL) AS BIGINT) AS without_tool, CAST(count(*) FILTER (WHERE args = 'output') AS BIGINT) AS orphans FROM sops GROUP BY 1
""")
def slice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.trace_summary(_sliced(spark, sf_dir))


@query(f"WITH RECURSIVE {_EVENTS}, {_TOOLS}, {_FLOWS} SELECT run_id, leaf, op_type FROM sops UNION SELECT run_id, leaf, op_type FROM ops WHERE run_id = 2")
def chosen_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliced operations of runs with outputs, all operations of the run without."""
    traced, roots = traced_view(spark, sf_dir)
    return plans.operations(traced, roots, _slice_outputs(traced), ["/w/d1", "/w/d3/"]).select("run_id", "leaf", "op_type")


@query(f"WITH RECURSIVE {_EVENTS}, {_TOOLS} SELECT run_id, CAST(CASE WHEN own THEN 0 ELSE row_number() OVER (PARTITION BY run_id, own ORDER BY first) END AS BIGINT) AS process_index, CAST(first AS BIGINT) AS first_seq FROM (SELECT *, pid = 0 AND gen = 0 AND epoch = 0 AS own FROM seen)")
def process_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical numbers of process instances: the root is 0, the others as they first act."""
    traced, roots = traced_view(spark, sf_dir)
    ops = canonical.operations(traced, roots, ["/w/d1", "/w/d3/"]).where(F.col("process_index") != schema.NO_PROCESS)
    return ops.groupBy("run_id", "process_index").agg(F.min("seq").alias("first_seq"))


_HARNESS = f"""
{_EVENTS}, {_TOOLS}, {_merkle_sql('ops')}, hbase AS (SELECT DISTINCT leaf FROM ops WHERE run_id = 0), size AS (SELECT count(*) AS total FROM hbase),
per AS (SELECT ops.run_id, count(DISTINCT ops.leaf) AS leaf_count, count(DISTINCT hbase.leaf) AS common FROM ops LEFT JOIN hbase ON hbase.leaf = ops.leaf GROUP BY ops.run_id)
"""


@query(f"WITH RECURSIVE {_HARNESS} SELECT CAST(per.run_id AS VARCHAR) AS path, root = (SELECT root FROM root_of WHERE run_id = 0) AS root_match, CAST(leaf_count AS BIGINT) AS leaf_count, round(CAST(common AS DOUBLE) / (leaf_count + total - common), 9) AS leaf_jaccard, CAST(total - common AS BIGINT) AS missing_leaves, CAST(leaf_count - common AS BIGINT) AS added_leaves FROM per JOIN root_of USING (run_id), size")
def harness_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of one command: documents of each, held against the first."""
    traced, roots = traced_view(spark, sf_dir)
    rows, _ = plans.harness(traced, roots, ["make", "all"], 5, watch=["/w/d1", "/w/d3/"])
    return rows.withColumn("leaf_jaccard", F.round("leaf_jaccard", 9)).select("path", "root_match", "leaf_count", "leaf_jaccard", "missing_leaves", "added_leaves")


def _hex_commitment(root: str) -> str:
    return f"'sha256:' || sha256(unhex({_hex_text(f"'{schema.COMMITMENT_V03}'")} || {_hex_text(root)} || {_hex_u32('2')} || {_hex_text("'make'")} || {_hex_text("'all'")} || {_hex_text("'inferred'")} || {_hex_u32('0')} || {_hex_u32('0')} || {_hex_u32('0')}))"


@query(f"WITH RECURSIVE {_EVENTS}, {_TOOLS}, {_merkle_sql('ops')} SELECT run_id, root AS process_root, {_hex_commitment('root')} AS root_hash, CAST(n AS BIGINT) AS operations FROM root_of")
def assembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _ops(spark, sf_dir)
    none = ops.select("run_id").limit(0).withColumns({"path": F.lit(""), "hash": F.lit("")})
    return attest.assemble(ops, none, ["make", "all"]).select("run_id", "process_root", "root_hash", F.col("tree.leaf_count").alias("operations"))


@query("""
WITH a AS (SELECT o_custkey AS key, list_sort(list(DISTINCT o_orderpriority)) AS l FROM orders GROUP BY 1), b AS (SELECT o_custkey AS key, list_sort(list(DISTINCT o_orderpriority)) AS l FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT a.key, array_to_string(list_filter(a.l, lambda x: NOT list_contains(coalesce(b.l, []), x)), ',') AS missing FROM a LEFT JOIN b USING (key)
""")
def list_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that only the first of two lists has."""
    o = _read(spark, sf_dir, "orders")
    listed = lambda df, name: df.groupBy(F.col("o_custkey").alias("key")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias(name))
    both = listed(o, "a").join(listed(o.where("o_orderstatus = 'F'"), "b"), "key", "left")
    return both.select("key", F.array_join(compare.list_delta(F.col("a"), F.coalesce("b", F.array().cast("array<string>")))["missing"], ",").alias("missing"))
