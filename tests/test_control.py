"""Settings, history, the command line and streams."""

import json
from datetime import datetime, timedelta

import pytest

from quillpack.functions.minify import minify
from quillpack.model import Settings
from quillpack.operators import filters
from quillpack.operators.report import Report
from quillpack.plans import cli
from quillpack.sources import history
from quillpack.sources import settings as S
from quillpack.streaming import landing


def test_json_with_comments():
    assert S.read_json('{"a": "// no /* x */", /* c */ "b": [1, 2,], // d\n}') == {"a": "// no /* x */", "b": [1, 2]}


def test_layers_win_in_order(tmp_path, monkeypatch):
    for place, got in (("sys", {"maxFiles": 5, "discovery": "git"}), ("user/quillpack", {"maxFiles": 7, "languages": {"ZZ": "zed"}}), ("work/.quillpack", {"presets": {"web": ["zz"]}, "discovery": None})):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "config.json").write_text(json.dumps(got))
    (tmp_path / "work" / "in").mkdir()
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "user"))
    got = S.load(tmp_path / "work" / "in", tmp_path / "sys")
    assert (got.max_files, got.discovery, got.languages["zz"], got.presets["web"][-1]) == (7, "git", "zed", "zz")


def test_validation():
    assert S.validate(Settings()) == []
    wrong = Settings(max_file_size="x", max_files=0, discovery="no", max_depth=-1, cluster_depth=0, header="h", fence="`", presets={"p": ()}, exclude_path=(" ",))
    found = S.validate(wrong)
    assert sum(s == "error" for s, _ in found) == 6 and sum(s == "warning" for s, _ in found) == 3


def test_schema_init_and_damaged_files(tmp_path):
    assert set(S.schema()["properties"]) == set(json.loads(S.dump(Settings())))
    path = S.init(tmp_path)
    path.write_text("[]")
    assert S.init(tmp_path).read_text() == "[]"
    with pytest.raises(ValueError):
        S.load_file(path)


def test_history(spark, tmp_path):
    start = datetime(2024, 1, 1)
    path = str(tmp_path / "h")
    assert history.read_history(spark, path).count() == 0
    for k in range(3):
        history.record(spark, path, str(tmp_path), ["-e", str(k % 2)], start + timedelta(hours=k))
    got = history.numbered(history.read_history(spark, path)).orderBy("number").collect()
    assert [(r.number, r.arguments[1], r.last_run.hour) for r in got] == [(1, "0", 2), (2, "1", 1)] and len(history.existing(history.read_history(spark, path))) == 2
    many = spark.createDataFrame([("d", [str(k)], start + timedelta(minutes=k)) for k in range(80)], history.SCHEMA)
    assert history.upsert(history.read_history(spark, path), many).count() == history.KEPT


def test_command_line():
    got = cli.parse(["src", "-E", ".CS,py", "md", "--preset", "web", "-b", "--shard", "2/3", "--", "-odd"])
    assert got.errors == [] and cli.pack_options(got) == {"paths": ["src", "-odd"], "extensions": ["cs", "py", "md"], "presets": ["web"], "brain": True, "shard_of": (2, 3)}
    assert len(cli.parse(["--nope", "--depth", "x", "--shard", "4/3", "--preset", "q", "-o"]).errors) == 5


def test_saved_arguments(tmp_path, monkeypatch):
    (tmp_path / ".quillpack-args").write_text("-e cs 'a b' # c\n")
    (tmp_path / "in").mkdir()
    assert cli.saved_arguments(tmp_path / "in") == ["-e", "cs", "a b"]


def test_commands_run(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "a.cs").write_text("class A { }")
    (tmp_path / "b.md").write_text("b")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home"))
    assert cli.main(["-f", "-e", "cs", "-o", "out/doc.md"]) == 0 and (tmp_path / "out/doc.md").read_text().startswith("## File: a.cs\n")
    assert cli.main(["-f", "--explain-filter", "b.md", "-e", "cs"]) == 0 and capsys.readouterr().out == "extension\n"
    assert cli.main(["-f", "--count", "-e", "cs"]) == 0 and capsys.readouterr().out == "4\n"
    assert cli.main(["-f", "--dry-run", "-e", "cs,md", "-x", "out/"]) == 0 and capsys.readouterr().out == "a.cs\nb.md\n"
    assert cli.main(["--nope"]) == 2 and all(cli.main([f"--{c}"]) == 0 for c in ("dump-config", "validate-config", "export-schema", "version", "help"))
    capsys.readouterr()
    assert cli.main(["-f", "-e", "cs", "--stats", "--json-stats", "s.json", "-c", "--compressor", "tr a-z A-Z", "-o", "up.md"]) == 0
    assert "CLASS A" in (tmp_path / "up.md").read_text() and "| shown | 1 |" in capsys.readouterr().out
    assert json.loads((tmp_path / "s.json").read_text())["metrics"]["files"] == "1"
    assert cli.main(["--history"]) == 0 and [x[:2] for x in capsys.readouterr().out.splitlines()] == ["1.", "2."]
    (tmp_path / "out/doc.md").unlink()
    assert cli.main(["--history", "2"]) == 0 and (tmp_path / "out/doc.md").exists() and cli.main(["--history", "9"]) == 2


def test_profiles(tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    monkeypatch.chdir(tmp_path)
    assert cli.main(["-e", "cs", "--save-profile", "Mine"]) == 0 and cli.main(["-e", "py", "--save"]) == 0
    assert cli.main(["--list-profiles"]) == 0 and capsys.readouterr().out == "mine: -e cs\n"
    assert cli.layered(["--profile", "MINE"])[:2] == ["-e", "cs"] and cli.layered(["-b"]) == ["-e", "py", "-b"]
    assert cli.main(["--profile", "other"]) == 2
    (tmp_path / "quillpack" / "profiles.json").write_text("{")
    assert cli.main(["--list-profiles"]) == 0


def test_reports_have_room_for_so_much():
    report = Report()
    for k in range(100):
        with report.stage(f"s{k}"):
            pass
        report.metric(f"m{k}", k)
    got = json.loads(report.to_json())
    assert len(got["stages"]) == 32 and len(got["metrics"]) == 64 and "| m63 | 63 |" in report.to_markdown()


def test_landing_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a.cs", "x // c"), ("b.md", "y"), ("bin/c.cs", "z")], "path string, content string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = landing.stream_sections(landing.landing_rows(spark, str(tmp_path / "in"), rows.schema), filters.PathRules(extensions=("cs",)), brain=True)
    query = stream.writeStream.format("memory").queryName("landed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = spark.table("landed").collect()
    assert [r.relative for r in got] == ["a.cs"] and minify("x // c", "cs") in got[0].section


def test_ledger(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", None)], "display string, content string")
    ledger = landing.ledger_rows(rows)
    new = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", None), ("c", "1")], "display string, content string")
    assert sorted((r.display, r.content) for r in landing.unseen(new, ledger).collect()) == [("a", "2"), ("c", "1")]


def test_log_levels_and_self_test(spark):
    import logging

    from quillpack.plans import selftest

    for words, level in (([], logging.WARNING), (["-v"], logging.INFO), (["-v", "--debug"], logging.DEBUG)):
        cli.set_log_level(cli.parse(words))
        assert cli.log.level == level and sum(type(h) is logging.StreamHandler for h in cli.log.handlers) == 1
    assert set(selftest.self_test(spark).values()) == {"ok"}
    assert selftest.benchmark(spark, 20, 2, 1)["files"] == 20
