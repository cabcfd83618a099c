import json

import pytest

from lithoscope import config
from lithoscope.schemas import problems, read_artifact


def test_config_precedence(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"max_files": 5, "output_dir": "o"}))
    got = config.merged({"output_dir": "cli"}, {"LITHOSCOPE_MAX_FILES": "7", "LITHOSCOPE_PRINT_PATHS": "true"}, tmp_path / "c.json")
    assert (got.output_dir, got.max_files, got.print_paths, got.max_bytes) == ("cli", 7, True, 2_000_000_000)
    (tmp_path / "c.json").write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        config.merged(file=tmp_path / "c.json", env={})
    path = config.create(tmp_path)
    with pytest.raises(FileExistsError):
        config.create(tmp_path)
    assert json.loads(config.create(tmp_path, force=True).read_text())["max_files"] == 50_000 and path.exists()


def test_problems(spark):
    good = {"schemaVersion": "1.0", "nodes": ["a"], "edges": [{"from": "a", "to": "b", "kind": "import", "isExternal": False}]}
    assert problems("facts/depGraph.json", good) == []
    assert problems("facts/depGraph.json", {**good, "schemaVersion": "2.0"})
    assert problems("depGraph.json", {**good, "nodes": "a"}) and problems("depGraph.json", {"schemaVersion": "1.0", "nodes": []})
    assert problems("telemetry.json", {"schemaVersion": "1.0", "scanMs": -1, "graphMs": 0, "topologyMs": 0, "totalMs": 0})
    assert problems("unknown.json", 3) == []


def test_read_artifact(spark, tmp_path):
    path = tmp_path / "telemetry.json"
    path.write_text('{"schemaVersion":"1.0","scanMs":1,"graphMs":2,"topologyMs":3,"totalMs":6}')
    assert read_artifact(spark, str(path)).first().totalMs == 6
    path.write_text('{"schemaVersion":"9","scanMs":1}')
    with pytest.raises(ValueError):
        read_artifact(spark, str(path))


def test_stream(spark, tmp_path):
    import datetime

    from lithoscope.streaming import files

    rows = [("a.ts", "spawn(1)\nspawn(2)", datetime.datetime(2024, 1, 1, 5)), ("b.md", "spawn(1)", datetime.datetime(2024, 1, 1, 6))]
    spark.createDataFrame(rows, files.SCHEMA).write.parquet(str(tmp_path / "in"))
    query = files.signals(files.arriving(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.line for r in spark.table("hits").collect()) == [1, 2]


def test_entry_has_core_queries():
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and {"scan_files", "dep_edges", "pagerank", "gap_rules"} <= set(queries)


def test_command_line(spark, tmp_path, capsys):
    from lithoscope.__main__ import main

    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.ts").write_text("import './b';\n")
    (tmp_path / "r/b.ts").write_text("export const b = 1;\n")
    at = ["--root", str(tmp_path / "r"), "--out", str(tmp_path / "o"), "--clock", "2000-01-01T00:00:00.000Z"]
    assert main(["map", *at]) == 0 and main(["inspect", *at]) == 0
    assert '"dependencies": 1' in capsys.readouterr().out
    assert main(["verify", *at]) == 0 and main(["audit", "--budget", "9"]) == 1
    assert main(["impact", "--target", "b.ts", *at]) == 0 and '"reverse"' in capsys.readouterr().out
    assert main(["export", "--format", "dot", *at]) == 0 and list((tmp_path / "o/export/dot").glob("part-*"))
    assert main(["snapshot-contracts", *at]) == 0 and main(["status", *at]) == 0
