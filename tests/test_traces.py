"""Scenarios as rows, and random traces against a plain walk over the events."""

import hashlib
import random

import pytest
from pyspark.sql import Row

from ledgerloom import plans, schema
from ledgerloom.operators import attest, canonical, enrich, process, provenance, snapshots

ROOT = (1, 0, 0)
P2, P2B = (2, 0, 0), (2, 0, 1)


def ev(kind, proc=ROOT, **k):
    obs = k.pop("obs", None)
    return {"kind": kind, "process": Row(*proc), "external": False, **k, "obs": None if obs is None else Row(*(("content", obs) if isinstance(obs, str) else obs)), "child": Row(*k["child"]) if "child" in k else None}


def frame(spark, *runs):
    names = [f.name for f in spark.createDataFrame([], schema.TRACED_EVENT).schema]
    rows = [tuple({**e, "run_id": r, "seq": i}.get(c) for c in names) for r, events in enumerate(runs) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, schema.TRACED_EVENT)


def roots(spark, n=1):
    return spark.createDataFrame([(r, Row(*ROOT)) for r in range(n)], f"run_id long, root {schema.PROCESS}")


def ops(spark, *events, watch=()):
    return canonical.canonicalize(frame(spark, events), roots(spark), watch).collect()


def kinds(rows):
    return sorted(r.op_type for r in rows)


def test_external_outside(spark):
    assert ops(spark, ev("FileOpen", P2, path="/x/a", flags=0, fd=3, external=True, obs="h"), ev("FileMmap", P2, path="/x/a", flags=1, prot=2, fd=3, external=True, obs="h"), watch=["/w"]) == []


def test_fallback(spark):
    rows = ops(spark, ev("FileOpen", P2, path="/w/a", flags=1, fd=3, obs="h"), ev("Exec", P2B, obs="tool"), ev("FileMmap", P2B, path="/w/b", prot=1, flags=2, fd=4, obs="b"), ev("FileClose", P2B, path="/w/a", fd=3, obs="out"), watch=["/w"])
    assert kinds(rows) == ["Exec", "ExternalFileRead", "ExternalFileWrite"]
    assert next(r for r in rows if r.op_type == "ExternalFileWrite").output_hashes == ["out"]
    assert {r.process_index for r in rows if r.op_type != "Exec"} == {schema.NO_PROCESS}


def test_read_write(spark):
    rows = ops(spark, ev("FileOpen", path="/a", flags=2, fd=3, obs="h"), ev("FileClose", path="/a", fd=3, obs="o"))
    assert kinds(rows) == ["FileRead", "FileWrite"] and [r.output_hashes for r in rows if r.op_type == "FileWrite"] == [["o"]]


def test_unclosed_write_is_a_leaf(spark):
    assert [r.output_hashes for r in ops(spark, ev("FileOpen", path="/a", flags=1, fd=3, obs="h"))] == [[]]


def test_mappings(spark):
    assert kinds(ops(spark, ev("FileMmap", path="/a", prot=3, flags=2, fd=3, obs="h"))) == ["FileRead"]
    rows = ops(spark, ev("FileMmap", path="/a", prot=3, flags=1, fd=3, obs="h"), ev("FileMmap", path="/a", prot=3, flags=1, fd=3, obs="h"), ev("FileClose", path="/a", fd=3, obs="o"))
    assert kinds(rows) == ["FileRead", "FileWrite"]


def test_rename_unlink_and_state(spark):
    rows = ops(spark, ev("FileRename", from_path="/a", to_path="/b", flags=2, obs="h"), ev("FileUnlink", path="/b", flags=0x200, obs="h"), ev("FileOpen", path="/proc/x", flags=2, fd=1, obs="h"), ev("FileOpen", path="/gone", flags=0, fd=2, obs=("missing", "p")))
    by = {r.op_type: r for r in rows}
    assert by["FileRename"].args == ["flags:0x2"] and by["FileDelete"].args == ["flags:0x200"] and by["SystemStateRead"].input_hashes == [schema.SYSTEM_STATE] and by["FileRead"].input_hashes == ["missing:p"]


def test_tools(spark):
    rows = ops(spark, ev("FileOpen", P2, path="/a", flags=0, fd=3, obs="a"), ev("Exec", P2B, obs="t"), ev("FileOpen", P2B, path="/b", flags=0, fd=3, obs="b"))
    assert {(r.input_hashes[0], r.tool_hash) for r in rows if r.op_type == "FileRead"} == {("a", None), ("b", "t")}
    chain = ops(spark, ev("Exec", obs="t"), ev("Fork", child=P2), ev("Fork", P2, child=(3, 0, 0)), ev("FileOpen", (3, 0, 0), path="/a", flags=0, fd=3, obs="a"), ev("Exit", (3, 0, 0), exit_code=0), ev("Exit", (9, 0, 0), exit_code=0), ev("Exit", exit_code=3))
    assert {(r.op_type, r.tool_hash, *r.args) for r in chain} == {("Exec", "t"), ("FileRead", "t"), ("Exit", "t"), ("Exit", "t", "exit:3")}


def test_inherited_write(spark):
    rows = ops(spark, ev("Exec", obs="p"), ev("FileOpen", path="/o", flags=1, fd=3, obs="h"), ev("Fork", child=P2), ev("FileClose", path="/o", fd=3, obs="A"), ev("Exec", P2B, obs="c"), ev("FileClose", P2B, path="/o", fd=3, obs="B"))
    assert [(r.tool_hash, r.output_hashes) for r in rows if r.op_type == "FileWrite"] == [("p", ["B"])]


def outputs(spark, *rows):
    return spark.createDataFrame([(0, *r) for r in rows], "run_id long, path string, hash string")


def sliced(spark, events, *outs):
    return provenance.canonicalize_slice(frame(spark, events), roots(spark), outputs(spark, *outs)).collect()


def write(proc, path, digest, fd=5):
    return [ev("FileOpen", proc, path=path, flags=1, fd=fd, obs="before"), ev("FileClose", proc, path=path, fd=fd, obs=digest)]


def read(proc, path, digest):
    return [ev("FileOpen", proc, path=path, flags=0, fd=9, obs=digest), ev("FileClose", proc, path=path, fd=9, obs=digest)]


def test_slice_keeps_what_explains(spark):
    other = (7, 0, 0)
    rows = sliced(spark, [ev("Exec", P2, obs="cc"), *read(P2, "/src", "s"), *write(P2, "/out", "o"), ev("Exec", other, obs="x"), *read(other, "/y", "y"), *write(other, "/copy", "o"), ev("Exit", exit_code=0)], ("/out", "o"))
    assert {(r.op_type, r.tool_hash, *r.input_hashes, *r.output_hashes) for r in rows} == {("Exec", "cc"), ("FileRead", "cc", "s"), ("FileWrite", "cc", "o"), ("Exit", None)}


def test_slice_orphan(spark):
    rows = sliced(spark, read(P2, "/out", "o"), ("/out", "o"))
    assert [(r.op_type, r.process_index, r.args) for r in rows] == [("FileWrite", schema.NO_PROCESS, ["output"])]


def test_slice_missing_read_vanishes(spark):
    rows = sliced(spark, [ev("FileOpen", P2, path="/t", flags=0, fd=1, obs=("missing", "m")), *write(P2, "/out", "o")], ("/out", "o"))
    assert kinds(rows) == ["FileWrite"]


@pytest.mark.parametrize("late", [False, True])
def test_slice_renames(spark, late):
    mover, moved = (8, 0, 0), ev("FileRename", (8, 0, 0), from_path="/tmp", to_path="/final", flags=0, obs="o")
    wrote = write(P2, "/tmp/x", "o")
    rows = sliced(spark, [ev("Exec", P2, obs="w"), ev("Exec", mover, obs="m"), *([moved, *wrote] if late else [*wrote, moved])], ("/final/x", "o"))
    assert {(r.op_type, r.tool_hash) for r in rows} >= {("FileWrite", "w")}


def test_slice_inherited_descriptor(spark):
    rows = sliced(spark, [ev("Exec", obs="p"), ev("FileOpen", path="/out", flags=1, fd=3, obs="h"), ev("Fork", child=P2), ev("Exec", P2B, obs="c"), ev("FileClose", P2B, path="/out", fd=3, obs="o")], ("/out", "o"))
    assert {(r.op_type, r.tool_hash) for r in rows} == {("Exec", "p"), ("FileWrite", "p")}


def test_slice_without_outputs(spark):
    assert sliced(spark, [ev("Exec", obs="p"), ev("Exit", exit_code=0)]) == []


def test_aliases_need_both_passes(spark):
    rows = spark.createDataFrame([(0, "/a/f", 1, 5)], "run_id long, path string, writer long, avail long")
    renames = spark.createDataFrame([(0, 1, "/b", "/c"), (0, 9, "/a", "/b")], "run_id long, seq long, from_path string, to_path string")
    assert {r.path for r in provenance.aliases(rows, renames).collect()} == {"/a/f", "/b/f", "/c/f"}
    rows = rows.selectExpr("run_id", "path", "writer", "CAST(0 AS BIGINT) AS avail")
    renames = spark.createDataFrame([(0, 1, "/a", "/b"), (0, 2, "/b", "/c")], "run_id long, seq long, from_path string, to_path string")
    assert {r.path for r in provenance.aliases(rows, renames).collect()} == {"/a/f", "/b/f", "/c/f"}


def test_lifetimes(spark):
    rows = [(0, 0, "Exec", 1, None), (0, 1, "Exec", 1, None), (0, 2, "Exec", 1, None), (0, 3, "Fork", 1, 2), (0, 4, "Exec", 2, None), (0, 5, "Exit", 2, None), (0, 6, "Fork", 1, 2), (0, 7, "FileOpen", 2, None)]
    df = process.lifetimes(spark.createDataFrame(rows, "run_id long, seq long, kind string, pid long, child_pid long"), spark.createDataFrame([(0, 1)], "run_id long, pid long"))
    got = {r.seq: (tuple(r.process), None if r.child is None else tuple(r.child)) for r in df.collect()}
    assert [got[i][0][2] for i in (0, 1, 2)] == [0, 1, 2]
    assert got[3][1] == (2, 0, 0) and got[4][0] == (2, 0, 1) and got[6][1] == (2, 1, 0) and got[7][0] == (2, 1, 0)


def test_enrich(spark):
    names = [f.name for f in spark.createDataFrame([], schema.RAW_EVENT).schema]
    raw = [
        {"kind": 3, "timestamp_ns": 1, "pid": 1, "tgid": 1, "path": "/bin/make", "source": 0},
        {"kind": 1, "timestamp_ns": 2, "pid": 1, "tgid": 1, "path": "out\x00\x00", "fd": 3, "dfd": -100, "flags": 0x201, "cwd": "/w", "source": 0},
        {"kind": 2, "timestamp_ns": 3, "pid": 1, "tgid": 1, "fd": 3, "source": 0},
        {"kind": 6, "timestamp_ns": 4, "pid": 1, "tgid": 1, "path": "/a", "operation_id": 9, "flags": 2, "source": 0},
        {"kind": 7, "timestamp_ns": 4, "pid": 1, "tgid": 1, "path": "/b", "operation_id": 9, "flags": 2, "source": 0},
        {"kind": 7, "timestamp_ns": 5, "pid": 1, "tgid": 1, "path": "/c", "operation_id": 10, "flags": 0, "source": 0},
        {"kind": 1, "timestamp_ns": 6, "pid": 5, "tgid": 5, "path": "/else", "fd": 1, "flags": 0, "source": 1},
        {"kind": 2, "timestamp_ns": 7, "pid": 5, "tgid": 5, "fd": 77, "source": 1},
        {"kind": 99, "timestamp_ns": 8, "pid": 1},
    ]
    df = spark.createDataFrame([tuple({"run_id": 0, **r}.get(c) for c in names) for r in raw], schema.RAW_EVENT)
    events, dropped = enrich.traced(df, None, spark.createDataFrame([(0, 1, "/home")], "run_id long, pid long, cwd string"), ["/w"])
    rows = events.orderBy("seq").collect()
    assert [r.kind for r in rows] == ["FileOpen", "FileClose", "FileRename", "FileRename"]
    assert rows[0].path == rows[1].path == "/w/out" and rows[0].obs.hash == schema.EMPTY_CONTENT
    assert [(r.from_path, r.to_path) for r in rows[2:]] == [("/a", "/b"), ("/b", "/a")]
    assert dropped.first().dropped == 2
    with pytest.raises(RuntimeError):
        plans.check_drops(dropped)
    assert plans.check_drops(dropped, allowed=True) == 2 and enrich.exit_code(9) == 137 and enrich.exit_code(3 << 8) == 3


def raw_frame(spark, *runs):
    names = [f.name for f in spark.createDataFrame([], schema.RAW_EVENT).schema]
    rows = [tuple({"run_id": r, "timestamp_ns": i, "source": 0, "tgid": e.get("pid"), **e}.get(c) for c in names) for r, events in enumerate(runs) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, schema.RAW_EVENT)


def opened(pid, path, fd, flags=1, **k):
    return {"kind": 1, "pid": pid, "path": path, "fd": fd, "flags": flags, "dfd": -100, **k}


def closed(pid, fd, **k):
    return {"kind": 2, "pid": pid, "fd": fd, **k}


def mapped(pid, fd, **k):
    return {"kind": 5, "pid": pid, "fd": fd, "prot": 1, "flags": 2, **k}


def forked(pid, child):
    return {"kind": 9, "pid": pid, "tgid": pid, "parent_pid": pid, "child_pid": child}


def moved(pid, a, b, op, flags=0, **k):
    return [{"kind": 6, "pid": pid, "path": a, "operation_id": op, "flags": flags, **k}, {"kind": 7, "pid": pid, "path": b, "operation_id": op, "flags": flags, **k}]


def seen_of(spark, raw):
    """Every event saw something of its own."""
    return raw.selectExpr("run_id", "timestamp_ns", "pid", "kind", "named_struct('kind', 'content', 'hash', concat('h', timestamp_ns)) AS obs")


def test_descriptor_paths(spark):
    fork = [opened(1, "/w/o", 3), forked(1, 2), closed(2, 3)]
    rename = [opened(1, "/w/a/f", 3), *moved(1, "/w/a", "/w/b", 1), closed(1, 3)]
    read_only = [opened(1, "/w/r", 3, flags=0), mapped(1, 3), closed(1, 3)]
    exchange = [opened(1, "/w/x/f", 3), opened(1, "/w/y", 4), *moved(1, "/w/x", "/w/y", 1, flags=2), closed(1, 3), closed(1, 4)]
    twice = [opened(1, "/a", 3), *moved(1, "/a", "/b", 1), forked(1, 2), *moved(1, "/b", "/c", 2), closed(2, 3), *moved(1, "/c", "/a", 3), closed(1, 3)]
    outside = [opened(9, "/else", 3, source=1), closed(9, 3, source=1), opened(9, "/w/s", 3, source=1), forked(9, 8), closed(8, 3, source=1)]
    raw = raw_frame(spark, fork, rename, read_only, exchange, twice, outside)
    events, _ = enrich.traced(raw, seen_of(spark, raw), None, ["/w"])
    got = {}
    for r in events.where("kind IN ('FileClose', 'FileMmap')").orderBy("run_id", "seq").collect():
        got.setdefault(r.run_id, []).append((r.kind, r.path, r.obs and r.obs.hash))
    assert got == {
        0: [("FileClose", "/w/o", "h2")], 1: [("FileClose", "/w/b/f", "h3")], 2: [("FileMmap", "/w/r", "h0"), ("FileClose", "/w/r", None)],
        3: [("FileClose", "/w/y/f", "h4"), ("FileClose", "/w/x", "h5")], 4: [("FileClose", "/c", "h6"), ("FileClose", "/a", "h9")], 5: [("FileClose", "/w/s", "h4")],
    }
    leaf = canonical.canonicalize(events.where("run_id = 0")).where("op_type = 'FileWrite'").first()
    assert leaf.output_hashes == ["h2"]


def test_inheritance_is_followed_to_its_end(spark):
    """Forks 1>2>3>4>5; opened in 1, mapped in 3, closed in 5: the close belongs to the open."""
    from ledgerloom.operators import descriptors

    marks = [(0, "tree", 1, 0, 3, 0, 0, "open", 0), (0, "tree", 3, 0, 3, 3, 0, "map", 3), (0, "tree", 5, 0, 3, 6, 0, "close", None), (0, "tree", 2, 0, 4, 9, 0, "close", None)]
    forks = [(0, s, p, 0, p + 1, 0) for s, p in ((1, 1), (2, 2), (4, 3), (5, 4))]
    found = descriptors.match(spark.createDataFrame(marks, "run_id long, space string, pid long, generation int, fd int, seq long, rank int, action string, op long"), spark.createDataFrame(forks, "run_id long, seq long, pid long, generation int, child_pid long, child_generation int"))
    assert {(r.pid, r.fd): r.pending for r in found.where("action = 'close'").collect()} == {(5, 3): 0, (2, 4): None}
    assert found.where("action = 'map'").first().governs == 0


def test_folders(spark):
    root = spark.createDataFrame([(0, 1, "/home")], "run_id long, pid long, cwd string")
    events = [
        {"kind": 3, "pid": 1, "path": "/bin/make"}, opened(1, "a", 3), opened(1, "b", 4, cwd="/w"), opened(1, "c", 5), forked(1, 2), opened(2, "d", 3), opened(2, "e", 4, dfd=7), opened(2, "f", 5, dfd=7, cwd="/q"),
        forked(2, 3), opened(2, "g", 6, cwd="/v"), opened(3, "h", 3), opened(1, "i", 6), *moved(3, "j", "k", 1, dfd=-100),
    ]
    events, _ = enrich.traced(raw_frame(spark, events), None, root)
    rows = events.orderBy("seq").collect()
    assert [r.path for r in rows if r.kind == "FileOpen"] == ["/home/a", "/w/b", "/w/c", "/w/d", "e", "/q/f", "/v/g", "/w/h", "/w/i"]
    assert [(r.from_path, r.to_path) for r in rows if r.kind == "FileRename"] == [("/w/j", "/w/k")] and not [r for r in rows if r.kind == "Exec"]


def test_source_filters(spark):
    raw = raw_frame(spark, [opened(1, "/w/a", -2), mapped(1, -1), opened(1, "/w/a", 3), forked(1, 2), opened(2, "/w/b", 3), opened(7, "/w/c", 3), forked(7, 8), opened(9, "/w/d", 3, source=1), opened(9, "/x", 4, source=1), opened(9, "rel", 5, source=1, flags=0), opened(9, "rel", 6, source=1, flags=1)])
    assert [(r.kind, r.path, r.fd) for r in enrich.admitted(raw, ["/w"]).orderBy("timestamp_ns").collect() if r.pid == 9] == [(1, "/w/d", 3), (1, "rel", 6)]
    assert [r.fd for r in enrich.admitted(raw, ["/w"]).where("pid = 1 AND kind IN (1, 5)").collect()] == [3]
    kept = enrich.tracked(raw, spark.createDataFrame([(0, 1)], "run_id long, pid long"))
    assert {r.pid for r in kept.collect()} == {1, 2, 9}


def raw_walk(events, watch):
    """Paths and observations of closes and mappings by one pass with a table of descriptors."""
    now, count, table, out, pending = {}, {}, {}, [], None
    near = lambda p: p.startswith(watch + "/")

    def current(pid):
        if pid not in now:
            start(pid)
        return pid, now[pid]

    def start(pid):
        now[pid] = count.get(pid, 0)
        count[pid] = now[pid] + 1

    def under(path, a, b):
        return b + path[len(a) :] if path == a or path.startswith(a + "/") else None

    for i, e in enumerate(events):
        kind, external = e["kind"], e.get("source") == 1
        if kind == 9:
            life = current(e["parent_pid"])
            start(e["child_pid"])
            child = (e["child_pid"], now[e["child_pid"]])
            table.update({(child, fd): list(v) for (o, fd), v in list(table.items()) if o == life})
        elif kind == 6:
            current(e["pid"])
            pending = e["path"]
        elif kind == 7:
            if external and not near(pending) and not near(e["path"]):
                continue
            for v in table.values():
                v[0] = under(v[0], pending, e["path"]) or (e["flags"] & 2 and under(v[0], e["path"], pending)) or v[0]
        else:
            life = current(e["pid"])
            if kind == 1:
                if not external or near(e["path"]):
                    table[life, e["fd"]] = [e["path"], e["flags"], f"h{i}"]
            elif kind == 5:
                v = table.get((life, e["fd"]))
                if v or not external:
                    out.append((i, *((v[0], v[2]) if v else (None, None))))
            elif kind == 2:
                v = table.pop((life, e["fd"]), None)
                if v or not external:
                    out.append((i, *((v[0], f"h{i}" if v[1] & 3 else None) if v else (None, None))))
    return out


def test_random_raw_traces(spark):
    rng, runs = random.Random(11), []
    for _ in range(60):
        events, pids, op = [], [1], 0
        while len(events) < 30:
            pid, fd = rng.choice(pids), rng.randint(1, 3)
            source = int(pid % 4 == 0)
            folder = lambda: rng.choice(["/w/a", "/w/b", "/w/a/b", "/x"])
            kind = rng.choice(["open", "open", "close", "close", "map", "fork", "move"])
            if kind == "open":
                events.append(opened(pid, folder() + "/f", fd, rng.randint(0, 2), source=source))
            elif kind == "close":
                events.append(closed(pid, fd, source=source))
            elif kind == "map":
                events.append(mapped(pid, fd, source=source))
            elif kind == "fork":
                child = rng.choice([p for p in range(1, 7) if p != pid])
                pids = sorted({*pids, child})
                events.append({**forked(pid, child), "source": source})
            else:
                op += 1
                a, b = rng.sample(["/w/a", "/w/b", "/w/c", "/x"], 2)
                events += moved(pid, a, b, op, rng.choice([0, 0, 2]), source=source)
        runs.append(events)
    raw = raw_frame(spark, *runs)
    events, _ = enrich.traced(raw, seen_of(spark, raw), None, ["/w"])
    numbers = {(r.run_id, r.seq): r.timestamp_ns for r in process.sequence(raw).collect()}
    got = {}
    for r in events.where("kind IN ('FileClose', 'FileMmap')").orderBy("run_id", "seq").collect():
        got.setdefault(r.run_id, []).append((numbers[r.run_id, r.seq // 2], r.path, r.obs and r.obs.hash))
    for i, events in enumerate(runs):
        assert got.get(i, []) == raw_walk(events, "/w"), i


def test_followed_in_chunks(spark, monkeypatch):
    from ledgerloom.operators import moves

    monkeypatch.setattr(moves, "CHUNK", 4)
    rng = random.Random(3)
    renames = [(0, 2 * i + 1, *rng.sample(["/a", "/b", "/c", "/a/d"], 2)) for i in range(60)]
    rows = [(0, 2 * t, rng.choice(["/a/f", "/b", "/a/d/x", "/q"]), rng.randint(-1, 2 * t)) for t in range(60)]
    got = {r.seq: r.path for r in moves.followed(spark.createDataFrame(rows, "run_id long, seq long, path string, since long"), spark.createDataFrame(renames, "run_id long, seq long, from_path string, to_path string")).collect()}
    for _, seq, path, since in rows:
        for _, s, a, b in renames:
            if since < s < seq and (path == a or path.startswith(a + "/")):
                path = b + path[len(a) :]
        assert got[seq] == path


def test_snapshots(spark, tmp_path):
    shot = lambda *rows: spark.createDataFrame([(0, "x", *r) for r in rows], schema.SNAPSHOT)
    before = shot(("keep", "File", "1", None), ("gone", "File", "2", None), ("link", "File", "3", "/x"))
    after = shot(("keep", "File", "1", None), ("new", "File", "4", None), ("link", "File", "3", "/y"), ("dir", "Directory", None, None), ("dist/app", "File", "5", None), ("logs/build.log", "File", "6", None))
    assert {r.path for r in snapshots.changed(before, after).collect()} == {"new", "link", "dist/app", "logs/build.log"}
    assert [r.path for r in snapshots.select_outputs(before, after, ["dist"]).collect()] == ["dist/app"]
    wanted = lambda *ps: spark.createDataFrame([(0, p) for p in ps], "run_id long, path string")
    assert [(r.path, r.hash, r.mode) for r in snapshots.select_outputs(before, after, wanted=wanted("keep")).collect()] == [("keep", "1", "explicit")]
    assert {r.path: r.error for r in snapshots.artifacts(after, wanted("keep", "dir", "none")).collect()} == {"keep": None, "dir": "non-regular", "none": "missing"}
    from ledgerloom import sources

    (tmp_path / "a.txt").write_text("x")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "b").write_text("y")
    (tmp_path / "l").symlink_to("a.txt")
    digest = "sha256:" + hashlib.sha256(b"x").hexdigest()
    assert {(r.path, r.kind, r.hash, r.target) for r in sources.local_snapshot(spark, str(tmp_path), 0, "after").collect()} == {("a.txt", "File", digest, None), ("l", "File", digest, "a.txt")}
    assert ("a.txt", digest) in {(r.path, r.hash) for r in sources.snapshot(spark, str(tmp_path), 0, "after").collect()}


def test_attestations(spark, tmp_path):
    leaves = spark.createDataFrame([(r, f"sha256:{r}{i}") for r in (0, 1) for i in range(3)], "run_id long, leaf string")
    docs = attest.assemble(leaves, outputs(spark, ("b", "2"), ("a", "1")), ["make", "x"], {"mode": "explicit", "output_roots": ["dist"]})
    checked = attest.validated(docs).collect()
    assert all(r.error is None and r.warning is None for r in checked)
    from ledgerloom import sources

    sources.write_attestation(docs.where("run_id = 0"), str(tmp_path / "0.json"))
    sources.write_attestation(docs.where("run_id = 1"), str(tmp_path / "1.json"))
    back = sources.read_attestations(spark, str(tmp_path))
    assert [r.error for r in attest.validated(back).collect()] == [None, None]
    both = plans.verify(docs, docs).collect()
    assert [r.verdict for r in both] == [None, None]
    other = attest.assemble(leaves, outputs(spark), ["make", "x"], {"mode": "explicit", "output_roots": ["dist"]})
    assert {r.run_id: r.verdict for r in plans.verify(docs, other).collect()} == {0: "root differs", 1: None}
    assert {r.verdict for r in plans.verify(docs, attest.assemble(leaves, outputs(spark), ["make"])).collect()} == {"command differs"}
    assert {r.verdict for r in plans.verify(docs, docs, pinned="sha256:x").collect()} == {"root differs from the pinned one"}
    rows, summary = plans.stability(back, back.orderBy("source").first().source)
    assert summary.first().root_matches == 1 and not plans.is_stable(summary) and "Runs: 2" in plans.report(rows, summary)
    found = plans.diff(docs.where("run_id = 0"), docs.where("run_id = 1"))
    assert found["leaves"].count() == 6 and {r.change for r in found["outputs"].collect()} == {"missing"} and found["summary"].first().same_command
    assert plans.explain(docs).first().command == "make x"
    with pytest.raises(ValueError):
        plans.harness(frame(spark), roots(spark), ["make"], 1)


def test_documents_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(attest, "MOST_LEAVES", 2)
    with pytest.raises(ValueError, match="run 1 has 3 operations"):
        attest.assemble(spark.createDataFrame([(0, "a"), *((1, x) for x in "abc")], "run_id long, leaf string"), outputs(spark), ["make"])


def test_old_documents(spark):
    nodes = [("r", False), ("l", False), ("r2", False), ("a", True), ("b", True), ("c", True), ("p", True)]
    from ledgerloom.operators import merkle

    root = spark.range(1).select(merkle.root_of(merkle.F.array(*map(merkle.F.lit, ["a", "b", "c"]))).alias("x")).first().x
    rows = [(v, None, h, None, ["make"], None, None, (None, nodes, 3)) for v, h in (("0.1.0", root), ("0.1.0", "tampered"), ("9.9.9", root))]
    got = [(r.error, r.process_root) for r in attest.validated(spark.createDataFrame(rows, schema.ATTESTATION)).collect()]
    assert got == [(None, root), ("root does not match the tree", root), ("unsupported version: 9.9.9", "")] or got[2][0] == "unsupported version: 9.9.9"
    assert got[0] == (None, root) and got[1][0] == "root does not match the tree"


def test_harness(spark):
    build = [ev("Exec", obs="t"), *write(ROOT, "/o", "x"), ev("Exit", exit_code=0)]
    rows, summary = plans.harness(frame(spark, build, build, build[:1] + write(ROOT, "/o", "y") + build[3:]), roots(spark, 3), ["make"], 3)
    assert summary.first().root_matches == 2 and {r.leaf_jaccard for r in rows.collect()} == {1.0, 0.5}


def test_stream_equals_batch(spark, tmp_path):
    from ledgerloom.operators import merkle
    from ledgerloom.streaming import canonicalize_stream

    build = [ev("Exec", obs="t"), *write(ROOT, "/o", "x"), ev("FileUnlink", path="/o", flags=0, obs="x"), ev("Exit", exit_code=0)]
    df = frame(spark, build, [*build, ev("FileUnlink", path="/p", flags=1, obs="x")], build[:2]).coalesce(1)
    for part, condition in (("a", "seq < 2"), ("b", "seq >= 2")):
        df.where(condition).write.mode("append").json(str(tmp_path / "in" / part))
        stream = spark.readStream.schema(schema.TRACED_EVENT).json(str(tmp_path / "in" / "*"))
        q = canonicalize_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), roots(spark, 3)).start()
        q.processAllAvailable()
        q.stop()
    got = {r.run_id: r.root for r in spark.read.parquet(str(tmp_path / "out" / "roots")).collect()}
    want = {r.run_id: r.root for r in merkle.roots(canonical.canonicalize(df.where("run_id < 2"), roots(spark, 3))).collect()}
    assert got == want and set(got) == {0, 1}


def test_late_events_are_counted(spark, tmp_path):
    """What comes for a run after its end changes no root; it is counted, and checking for losses fails."""
    from ledgerloom.streaming import canonicalize_stream, late_events

    build = [ev("Exec", obs="t"), *write(ROOT, "/o", "x"), ev("Exit", exit_code=0)]
    df = frame(spark, build, build[:2])
    late = frame(spark, [ev("FileUnlink", path="/o", flags=0, obs="x")] * 2).withColumn("seq", schema_seq())
    more = frame(spark, [], build).where("run_id = 1 AND seq >= 2")
    for part, rows in (("a", df), ("b", late.unionByName(more)), ("c", late)):
        rows.coalesce(1).write.json(str(tmp_path / "in" / part))
        stream = spark.readStream.schema(schema.TRACED_EVENT).json(str(tmp_path / "in" / "*"))
        q = canonicalize_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), roots(spark, 2)).start()
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(str(tmp_path / "out" / "roots")).collect()
    assert sorted(r.run_id for r in got) == [0, 1] and len({r.root for r in got}) == 1
    lost = late_events(df, str(tmp_path / "out"))
    assert {r.run_id: r.dropped for r in lost.collect()} == {0: 4}
    with pytest.raises(RuntimeError):
        plans.check_drops(lost)
    # Runs that were emitted in an earlier batch have left the state.
    assert not list((tmp_path / "out" / "events").glob("batch=*/run_id=0"))


def schema_seq():
    from pyspark.sql import functions as F

    return F.lit(99).cast("long")


def test_raw_stream_equals_batch(spark, tmp_path):
    from ledgerloom.operators import merkle
    from ledgerloom.streaming import trace_stream

    one = [opened(1, "/w/o", 3), forked(1, 2), *moved(2, "/w", "/v", 1), closed(2, 3), {"kind": 4, "pid": 1, "exit_code": 0}]
    raw = raw_frame(spark, one, one[:3])
    seen = seen_of(spark, raw)
    root = spark.createDataFrame([(r, 1, "/", Row(*ROOT), Row("content", "cc")) for r in (0, 1)], f"run_id long, pid long, cwd string, root {schema.PROCESS}, obs {schema.OBSERVATION}")
    for part, condition in (("a", "timestamp_ns < 2"), ("b", "timestamp_ns >= 2")):
        raw.where(condition).coalesce(1).write.json(str(tmp_path / "in" / part))
        q = trace_stream(spark.readStream.schema(schema.RAW_EVENT).json(str(tmp_path / "in" / "*")), str(tmp_path / "out"), str(tmp_path / "ck"), root, seen).start()
        q.processAllAvailable()
        q.stop()
    events, _ = enrich.traced(raw.where("run_id = 0"), seen, root)
    want = merkle.roots(canonical.canonicalize(enrich.with_root_exec(events, root), root)).where("run_id = 0").first().root
    assert [(r.run_id, r.root) for r in spark.read.parquet(str(tmp_path / "out" / "roots")).collect()] == [(0, want)]


def test_root_exit(spark):
    """The wait status is the root's code; a run that has no exit gets one at its end."""
    events = frame(spark, [ev("Exec", obs="t"), ev("Exit", exit_code=0), ev("Exit", P2, exit_code=0)], [ev("Exec", obs="t"), ev("Exec", (1, 0, 1), obs="u")], [ev("Exit", exit_code=0)])
    known = spark.createDataFrame([(0, Row(*ROOT), 3 << 8), (1, Row(*ROOT), 9), (2, Row(*ROOT), None)], f"run_id long, root {schema.PROCESS}, status int")
    got = {(r.run_id, tuple(r.process)): (r.seq, r.exit_code) for r in enrich.with_root_exit(events, known).where("kind = 'Exit'").collect()}
    assert got == {(0, ROOT): (1, 3), (0, P2): (2, 0), (1, (1, 0, 1)): (2, 137), (2, ROOT): (0, 0)}
    assert [enrich.exit_code(s) for s in (3 << 8, 9)] == [3, 137]


def test_verify_traces_anew(spark):
    raw = raw_frame(spark, [{"kind": 3, "pid": 1, "path": "/bin/make"}, opened(1, "out", 3), closed(1, 3), {"kind": 4, "pid": 1, "exit_code": 0}])
    root = spark.createDataFrame([(0, 1, "/w", Row(*ROOT), Row("content", "cc"), 0)], f"run_id long, pid long, cwd string, root {schema.PROCESS}, obs {schema.OBSERVATION}, status int")
    shot = lambda *rows: spark.createDataFrame([(0, "x", *r) for r in rows], schema.SNAPSHOT)
    before, after = shot(), shot(("/w/out", "File", "h2", None))
    given = (raw, seen_of(spark, raw), root, before, after)
    docs, ops = plans.trace(*given, ["make"])
    assert kinds(ops.collect()) == ["Exec", "Exit", "FileWrite"]
    verdict = lambda expected, tables, *a, **k: plans.verify_trace(expected, *tables, *a, **k)[0].first().verdict
    assert verdict(docs, given, ["make"]) is None and verdict(docs, given, ["make", "x"]) == "command differs"
    changed = (raw, seen_of(spark, raw).selectExpr("run_id", "timestamp_ns", "pid", "kind", "named_struct('kind', 'content', 'hash', concat('z', timestamp_ns)) AS obs"), *given[2:])
    assert verdict(docs, changed, ["make"]) == "root differs"
    chosen, _ = plans.trace(*given, ["make"], output_roots=["/w"])
    assert verdict(chosen, given, ["make"]) == "the outputs were chosen; name them again" and verdict(chosen, given, ["make"], output_roots=["/w"]) is None
    broken = (raw.unionByName(raw.where("kind = 4").selectExpr("* EXCEPT (kind)", "99 AS kind").select(*raw.columns)), *given[1:])
    with pytest.raises(RuntimeError):
        verdict(docs, broken, ["make"])


def test_one_baseline(spark):
    leaves = spark.createDataFrame([(r, f"sha256:{r}{i}") for r in (0, 1) for i in range(3)], "run_id long, leaf string")
    docs = attest.assemble(leaves, outputs(spark), ["make"]).selectExpr("*", "'same' AS source")
    with pytest.raises(Exception, match="(?i)more than one row"):
        plans.stability(docs, "same")[1].collect()
    rows, summary = plans.stability(docs.withColumn("source", docs.run_id.cast("string")), "0")
    assert '"root_matches": 1' in plans.report_json(rows, summary) and "1 of 2 runs have another root" in plans.report(rows, summary, 3)


# --- a plain walk ---------------------------------------------------------------------------------


def digest(tag, tool, args, ins, outs):
    return "sha256:" + hashlib.sha256((tag + (tool or "") + "".join(a + "\0" for a in sorted(args)) + "".join(sorted(ins)) + "".join(sorted(outs))).encode()).hexdigest()


def walk(events, watch):
    """Leaves by one pass with a dictionary of open descriptors."""
    tools, fds, marked, known, out = {}, {}, set(), {ROOT}, []
    near = lambda e: any((e.get(c) or "").startswith(watch + "/") for c in ("path", "from_path", "to_path")) if watch else False
    for e in events:
        who, kind = tuple(e["process"]), e["kind"]
        life, h = who[:2], e["obs"][1] if e["obs"] else None
        if kind == "Exec":
            tools[who] = h
            known.add(who)
            out.append(["exec", h, [], [], []])
        elif kind == "Fork":
            kid = tuple(e["child"])
            if who in tools:
                tools[kid] = tools[who]
            fds.update({("in", kid[:2], fd): op for (s, o, fd), op in list(fds.items()) if s == "in" and o == life})
        elif kind == "Exit":
            if who in known:
                out.append(["exit", tools.get(who), [f"exit:{e['exit_code']}"] if life == ROOT[:2] else [], [], []])
        else:
            candidate = life != ROOT[:2] and near(e)
            outside = candidate and (life in marked if kind == "FileClose" else life in marked or who not in tools)
            space, pre, tool = ("out", "external_", None) if outside else ("in", "", tools.get(who))
            if kind == "FileClose":
                op = fds.pop((space, life, e["fd"]), None)
                if op is not None and h:
                    op[4] = [h]
                continue
            if outside:
                marked.add(life)
            else:
                known.add(who)
            if kind == "FileUnlink":
                out.append([pre + "file_delete", tool, [f"flags:{e['flags']:#x}"], [h], []])
            elif kind == "FileRename":
                out.append([pre + "file_rename", tool, [f"flags:{e['flags']:#x}"], [h], [h]])
            else:
                mapped = kind == "FileMmap"
                if mapped or e["flags"] & 3 != 1:
                    out.append([pre + "file_read", tool, ["mmap"] if mapped else [], [h], []])
                writes = e["prot"] & 2 and e["flags"] & 1 if mapped else e["flags"] & 3
                if writes and not (mapped and (space, life, e["fd"]) in fds):
                    op = [pre + "file_write", tool, [], [], []]
                    out.append(op)
                    fds[space, life, e["fd"]] = op
    return {digest(*o) for o in out}


def test_random_traces(spark):
    rng, runs = random.Random(5), []
    for _ in range(60):
        events, procs, forked = [], [ROOT], 1
        for _ in range(rng.randint(3, 22)):
            who = rng.choice(procs)
            kind = rng.choice(["Exec", "Fork", "FileOpen", "FileOpen", "FileOpen", "FileMmap", "FileClose", "FileClose", "FileClose", "FileUnlink", "FileRename", "Exit"])
            path, fd, h = rng.choice(["/w/a", "/w/b", "/x/a"]), rng.randint(1, 2), f"h{rng.randint(0, 3)}"
            if kind == "Exec":
                who = (who[0], who[1], who[2] + 1)
                procs = [who if p[:2] == who[:2] else p for p in procs]
                events.append(ev("Exec", who, obs=f"t{rng.randint(0, 2)}"))
            elif kind == "Fork":
                forked += 1
                procs.append((forked, 0, 0))
                events.append(ev("Fork", who, child=(forked, 0, 0)))
            elif kind == "FileRename":
                events.append(ev(kind, who, from_path=path, to_path="/w/c", flags=rng.choice([0, 2]), obs=h))
            else:
                events.append(ev(kind, who, path=path, fd=fd, flags=rng.randint(0, 2), prot=rng.choice([1, 3]), obs=h, exit_code=rng.randint(0, 2)))
        runs.append(events)
    df = frame(spark, *runs)
    for watch in ("", "/w"):
        got = {}
        for r in canonical.canonicalize(df, roots(spark, len(runs)), [watch] if watch else []).select("run_id", "leaf").collect():
            got.setdefault(r.run_id, set()).add(r.leaf)
        for i, events in enumerate(runs):
            assert got.get(i, set()) == walk(events, watch), (i, watch)
