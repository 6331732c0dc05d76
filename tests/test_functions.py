import hashlib
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom import dsse, schema
from ledgerloom.functions import hashing, paths
from ledgerloom.operators import merkle


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def sha(text):
    return "sha256:" + hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("/tmp/tmp.ABCDEF/src/gone", "/tmp/<session>/src/gone"),
        ("/tmp/ccABCDEF.s", "/tmp/<compiler-temp>.s"),
        ("/tmp/ccABCDE.s", "/tmp/ccABCDE.s"),
        ("/tmp/rustcABCDE.a.b", "/tmp/<compiler-temp>.a.b"),
        ("/tmp/x/go-build123/b001/gone", "/tmp/x/<go-work>/b001/gone"),
        ("/home/tmp.ABCDEF", "/home/tmp.ABCDEF"),
        ("/dev/pts/7", "/dev/pts/<session>"),
        ("/dev/pts/", "/dev/pts/<session>"),
        ("/dev/pts/7x", "/dev/pts/7x"),
        ("//a/./b//c/", "/a/b/c"),
        ("./a/../b", "./a/../b"),
        ("/", "/"),
        ("", ""),
    ],
)
def test_normalize(spark, path, expected):
    assert value(spark, paths.normalize(F.lit(path))) == expected


@pytest.mark.parametrize(
    ("path", "expected"),
    [("/proc/cpuinfo", True), ("/etc/os-release", True), ("/etc/os-release-evil", False), ("/proc-evil/cpuinfo", False), ("/home/u/.config/go/telemetry/mode", True), ("/srv/go/telemetry-archive/data", False), ("/srv/django/telemetry/data", False), ("/sys", True)],
)
def test_system_state(spark, path, expected):
    assert value(spark, paths.is_system_state(F.lit(path))) is expected


@pytest.mark.parametrize(("path", "prefix", "expected"), [("/tmp/build-evil/out", "/tmp/build", False), ("/tmp/build/out", "/tmp/build/", True), ("/tmp/build", "/tmp/build", True), ("/x", "", True)])
def test_within(spark, path, prefix, expected):
    assert value(spark, paths.within(F.lit(path), F.lit(prefix))) is expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("packagefile fmt=/tmp/go-tmp/go-build123/b002/_pkg_.a\n", "packagefile fmt=$WORK/b002/_pkg_.a\n"),
        ("# import config\npackagefile a=/tmp/go-build1/x/go-build22/y\nimportmap a=b", "# import config\npackagefile a=$WORK/y\nimportmap a=b"),
        ("packagefile fmt=/nix/store/x/fmt.a\n", None),
        ("something else\npackagefile fmt=/tmp/go-build1/x\n", None),
        ("packagefile fmt /tmp/go-build1/x\n", None),
    ],
)
def test_import_config(spark, text, expected):
    assert value(spark, paths.normalize_import_config(F.lit(text))) == expected


def test_control_files(spark):
    a, b = "a" * 64, "b" * 64
    entry = lambda t, n=175: f"v1 {a} {b} {5:>20} {t:>20}\n"[:n]
    path = f"/cache/aa/{a}-a"
    hashed = lambda p, c: value(spark, paths.file_hash(F.lit(p), F.lit(c).cast("binary")))
    assert hashed(path, entry(1)) == hashed(path, entry(999)) == sha(schema.CACHE_ENTRY_DOMAIN + entry(0).encode())
    assert hashed(path, entry(1, 174)) == sha(entry(1, 174))
    assert hashed("/cache/ab/" + a + "-a", entry(1)) == sha(entry(1))
    config = "packagefile x=/t/go-build5/b1/p.a\n"
    assert hashed("/t/go-build5/b1/importcfg", config) == sha(schema.IMPORT_CONFIG_DOMAIN + b"packagefile x=$WORK/b1/p.a\n")
    assert hashed("/workspace/importcfg", config) == sha(config)
    assert hashed("/t/go-builder/b1/importcfg", config) == sha(config)
    assert hashed("/x", "") == schema.EMPTY_CONTENT


def test_rewrite(spark):
    move = lambda p: value(spark, paths.rewrite_prefix(F.lit(p), F.lit("/tmp/old"), F.lit("/tmp/new")))
    assert [move(p) for p in ("/tmp/old/artifact", "/tmp/old", "/tmp/older/unrelated")] == ["/tmp/new/artifact", "/tmp/new", None]
    assert value(spark, paths.ancestors(F.lit("/a/b/"))) == ["", "/a", "/a/b", "/a/b/"]


def test_resolve(spark):
    args = lambda raw, **k: value(spark, paths.resolve(F.lit(raw), F.lit(k.get("target")).cast("string"), F.lit(k.get("base")).cast("string")))
    assert args("/abs", base="/w") == "/abs"
    assert args("a/b", base="/w") == "/w/a/b"
    assert args("a") == "a"
    assert args("a", target="/real/a (deleted)", base="/w") == "/real/a"


def test_shell(spark):
    assert value(spark, paths.shell_command(F.array(*map(F.lit, ["make", "", "a b", "it's", "x=1"])))) == "make '' 'a b' 'it'\"'\"'s' x=1"


GOLDEN = ("sha256:process", ["make", "release"], "explicit", ["dist/app"], ["dist"], [("dist/app", "sha256:artifact")])


def test_commitments(spark):
    df = spark.createDataFrame([GOLDEN, ("sha256:process", ["make"], "inferred", [], [], [])], "root string, command array<string>, mode string, artifacts array<string>, roots array<string>, outputs array<struct<path:string,hash:string>>")
    parts = [F.col(c) for c in df.columns]
    rows = df.select(hashing.commitment_v02(*parts).alias("a"), hashing.commitment_v03(*parts).alias("b")).collect()
    assert rows[0].a == "sha256:acbd954b2c7a7196ef706989898068ac1b26c82237855ccc7c071b592953adc5"
    assert rows[0].b == "sha256:1f819e0c33fd80f8b324a0e528999a588ce1c1c1ca5c9b52061b5dad39b8b151"
    assert rows[1].b == "sha256:ca5c89cc0b8fcdd83c6043fe04430ab3a27bac151d9845fa231ed9586b1f65b2"


def test_commitment_of_many_outputs(spark):
    """Every byte counts, lengths that aren't text included, and the time follows the number of outputs, not its square."""
    n, long = 100_000, "é" * 100
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.concat(i.cast("string"), F.lit(long)).alias("path"), F.lit("sha256:x").alias("hash"))).alias("outputs"))
    framed = lambda x: len(x).to_bytes(4, "little") + x
    none = bytes(4)
    parts = [framed(schema.COMMITMENT_V03.encode()), framed(b"r"), none, framed(b"inferred"), none, none, n.to_bytes(4, "little"), *(framed(f"{i}{long}".encode()) + framed(b"sha256:x") for i in range(1, n + 1))]
    empty = F.array().cast("array<string>")
    commitment = lambda outputs: hashing.commitment_v03(F.lit("r"), empty, F.lit("inferred"), empty, empty, outputs)
    began = time.monotonic()
    assert df.select(commitment(F.col("outputs")).alias("x")).first().x == sha(b"".join(parts))
    assert time.monotonic() - began < 30
    # An output that isn't known is not left out.
    lost = F.array(F.struct(F.lit("a").alias("path"), F.lit(None).cast("string").alias("hash")))
    assert value(spark, commitment(lost)) is None


def fold(leaves):
    if not leaves:
        return merkle.EMPTY
    row = sorted(leaves)
    while len(row) & (len(row) - 1):
        row.append(merkle.PADDING)
    while len(row) > 1:
        row = [hashing.pair(a, b) for a, b in zip(row[::2], row[1::2], strict=True)]
    return row[0]


def test_merkle_blocks(spark):
    leaves = {n: [sha(f"{n}/{i}") for i in range(n)] for n in (1, 2, 3, 4, 5, 8, 9, 17, 33, 64, 65)}
    df = spark.createDataFrame([(n, x) for n, xs in leaves.items() for x in [*xs, xs[0]]], "run_id long, leaf string")
    for bits in (2, 12):
        assert {r.run_id: (r.root, r.leaf_count) for r in merkle.roots(df, bits).collect()} == {n: (fold(xs), n) for n, xs in leaves.items()}
    whole = df.groupBy("run_id").agg(F.sort_array(F.collect_set("leaf")).alias("l")).select("run_id", merkle.root_of(F.col("l")).alias("root"))
    assert {r.run_id: r.root for r in whole.collect()} == {n: fold(xs) for n, xs in leaves.items()}


def test_leaf_sets(spark):
    sets = lambda *rows: spark.createDataFrame(rows, "run_id long, leaf string")
    assert [tuple(r) for r in merkle.leaf_diff(sets((0, "a"), (0, "c")), sets((1, "a"), (1, "b"), (1, "c"))).collect()] == [("added", "b")]
    runs = sets((1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c"))
    rows = {r.run_id: r for r in merkle.stability(runs, sets((1, "a"), (1, "b"))).collect()}
    assert rows[1].leaf_jaccard == rows[2].leaf_jaccard == 1 and rows[3].leaf_jaccard == 1 / 3 and (rows[3].missing_leaves, rows[3].added_leaves) == (1, 1)
    none = runs.limit(0)
    assert merkle.stability(none, none, spark.createDataFrame([(1,)], "run_id long")).first().leaf_jaccard == 1.0


def test_signatures(spark):
    # The first test of RFC 8032.
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    key = dsse.public_key(seed)
    assert key.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert dsse.sign_bytes(seed, b"").hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    good = dsse.envelope(seed, b'{"a":1}', "application/json")
    bad = [good | {"payload": "eyJhIjoyfQ=="}, good | {"signatures": []}, good | {"payloadType": "x"}, good | {"payload": "%%"}]
    df = spark.createDataFrame([good, *bad], schema.ENVELOPE)
    assert [r.verified for r in dsse.verify_envelopes(df, key).collect()] == [True, False, False, False, False]
    assert not any(r.verified for r in dsse.verify_envelopes(df, dsse.public_key(bytes(32))).collect())
    assert value(spark, hashing.pae(F.lit("t"), F.lit("é"))) == dsse.pae("t", "é".encode())


def test_keys(tmp_path):
    from ledgerloom import sources

    path = str(tmp_path / "key")
    key = dsse.generate_key()
    sources.write_key(path, key)
    assert sources.read_key(path) == key and (tmp_path / "key").stat().st_mode & 0o777 == 0o600
    with pytest.raises(FileExistsError):
        sources.write_key(path, key)
    (tmp_path / "short").write_text("abcd")
    with pytest.raises(ValueError):
        sources.read_key(str(tmp_path / "short"))
