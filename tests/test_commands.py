import json

import pytest

from ledgerloom.__main__ import main
from ledgerloom.plans.paths import absolutize, display_path, metadata_path
from test_traces import ROOT, ev, frame, write


def test_paths():
    assert absolutize("a/../b//c/.", "/w") == "/w/b/c" and absolutize("/x/../y", "/w") == "/y"
    assert display_path("/w/a", "/w/") == "a" and display_path("/wide/a", "/w") == "/wide/a" and display_path("/w", "/w") == ""
    assert metadata_path("/w/dist", "/w") == "dist" and metadata_path("dist/", "/w") == "dist/"


def test_round_trip(spark, tmp_path, capsys):
    from pyspark.sql import Row

    from ledgerloom import schema

    raw = [
        (0, 1, 0, 2, 1, 1, 3, -100, 1, None, "out", 3, None, None, None, None, None, "/w"),
        (0, 2, 0, 3, 1, 1, 3, None, None, None, None, None, None, None, None, None, None, None),
        (0, 4, 0, 4, 1, 1, None, None, None, None, None, None, None, 0, None, None, None, None),
    ]
    save = lambda df, name: df.write.parquet(str(tmp_path / "in" / name))
    save(spark.createDataFrame(raw, schema.RAW_EVENT), "events")
    save(spark.createDataFrame([(0, 2, 1, 1, Row("content", "old")), (0, 3, 1, 2, Row("content", "new"))], f"run_id long, timestamp_ns long, pid long, kind int, obs {schema.OBSERVATION}"), "observations")
    save(spark.createDataFrame([(0, 1, "/w", Row(*ROOT), Row("content", "cc"))], f"run_id long, pid long, cwd string, root {schema.PROCESS}, obs {schema.OBSERVATION}"), "roots")
    save(spark.createDataFrame([], schema.SNAPSHOT), "before")
    save(spark.createDataFrame([(0, "after", "/w/out", "File", "new", None)], schema.SNAPSHOT), "after")
    assert main(["trace", str(tmp_path / "in"), "--output", str(tmp_path / "docs"), "make", "all"]) == 0
    doc = str(tmp_path / "docs" / "0.json")
    made = json.loads(open(doc).read())
    assert made["outputs"] == [{"path": "/w/out", "hash": "new"}] and made["tree"]["leaf_count"] == 3 and made["command"] == ["make", "all"]
    again = ["verify-trace", str(tmp_path / "in"), "--expected", str(tmp_path / "docs")]
    assert main([*again, "make", "all"]) == 0 and main([*again, "make"]) == 1
    assert main(["verify", doc, doc]) == 0 and main(["diff", doc, doc]) == 0 and main(["explain", doc]) == 0
    assert main(["stability", doc, doc, "--strict", "--json"]) == 0
    key = str(tmp_path / "key")
    assert main(["generate-key", key]) == 0 and main(["sign", doc, "--key", key, "--output", str(tmp_path / "e.json")]) == 0
    assert main(["verify-signature", str(tmp_path / "e.json"), "--key", key + ".pub"]) == 0
    with pytest.raises(SystemExit):
        main(["verify-signature", str(tmp_path / "e.json"), "--key", key])
    (tmp_path / "bad.json").write_text(json.dumps(made | {"root_hash": "sha256:0"}))
    with pytest.raises(SystemExit):
        main(["explain", str(tmp_path / "bad.json")])
    build = [ev("Exec", obs="t"), *write(ROOT, "/o", "x"), ev("Exit", exit_code=0)]
    frame(spark, build, build).write.parquet(str(tmp_path / "h" / "traced"))
    spark.createDataFrame([(r, Row(*ROOT)) for r in (0, 1)], f"run_id long, root {schema.PROCESS}").write.parquet(str(tmp_path / "h" / "roots"))
    assert main(["harness", str(tmp_path / "h"), "--strict", "--json", "make"]) == 0
    capsys.readouterr()
