import json

import pytest

from siltstone.schemas import IntegrityError
from siltstone.sources import files
from siltstone.streaming import incremental


def test_questions(spark, tmp_path):
    good = {"id": "1", "question": "q", "language": "en", "expected": [{"relative_path": "a.py", "qualified_name": "f", "start_line": 1, "end_line": 2}]}
    path = tmp_path / "q.json"
    path.write_text(json.dumps([good]))
    assert files.questions(spark, str(path)).first()["expected"][0]["end_line"] == 2
    for bad in ({"question": " "}, {"expected": []}, {"language": "de"}, {"expected": [{"relative_path": "a", "start_line": 3, "end_line": 2}]}):
        path.write_text(json.dumps([good | bad]))
        with pytest.raises(IntegrityError):
            files.questions(spark, str(path))
    path.write_text(json.dumps([good, good]))
    with pytest.raises(IntegrityError):
        files.questions(spark, str(path))


def test_logs_and_csv(spark, tmp_path):
    log = tmp_path / "log.ndjson"
    rows = [{"type": "text", "sessionID": "s", "part": {"text": "hello"}}, {"type": "tool_use", "sessionID": "s", "part": {"tool": "read"}}, {"type": "step_finish", "sessionID": "s", "part": {"tokens": {"input": 5, "output": 2, "reasoning": 0, "cache": {"read": 3, "write": 0}}}}]
    log.write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n\n")
    got = files.agent_usage(files.agent_events(spark, str(log))).first()
    assert (got["steps"], got["tool_calls"], got["input"], got["cache_read"], got["texts"]) == (1, 1, 5, 3, "hello")
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.json_lines(spark, str(lines), "a int").count() == 2
    frame = spark.createDataFrame([("x, y", 1)], "t string, n int")
    files.write_csv(frame, str(tmp_path / "csv"))
    assert files.csv(spark, str(tmp_path / "csv"), "t string, n int").first()["t"] == "x, y"
    with pytest.raises(Exception, match="exists"):
        files.write_csv(frame, str(tmp_path / "csv"))


def test_manifest_and_json(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a").write_text("1")
    m = files.manifest(spark, str(tmp_path / "d"))
    digest = files.directory_digest(m).first()
    assert digest["files"] == 1 and files.frozen_violations(m, m.select("path", "sha256")).count() == 0
    target = tmp_path / "out.json"
    files.write_json({"a": 1}, str(target))
    with pytest.raises(FileExistsError):
        files.write_json({"a": 2}, str(target), once=True)
    for bad in ({"api_key": "x"}, {"p": "/home/me/x"}, [{"password": 1}]):
        with pytest.raises(ValueError):
            files.check_portable(bad)


def test_stream(spark, tmp_path):
    arrivals, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a.py", bytearray(b"def f():\n    pass\n"), "1", 1), ("a.py", bytearray(b"def g():\n    pass\n"), "2", 2)]
    frame = spark.createDataFrame(rows, "relative_path string, content binary, sha256 string, s int").selectExpr("relative_path", "content", "sha256", "timestamp_seconds(s) AS seen_at")
    frame.write.parquet(arrivals)
    incremental.start(spark, arrivals, out, str(tmp_path / "cp")).awaitTermination(60)
    assert [r["qualified_name"] for r in spark.read.parquet(out).collect()] == ["g"]
    incremental.start(spark, arrivals, out, str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(out).count() == 1


def test_unreadable_folders_are_error_rows(spark, tmp_path, monkeypatch):
    import os

    from siltstone.sources import repository

    (tmp_path / "shut").mkdir()
    (tmp_path / "a.py").write_text("x = 1\n")
    scandir = os.scandir

    def refusing(path):
        if str(path).endswith("shut"):
            raise PermissionError(13, "no", str(path))
        return scandir(path)

    monkeypatch.setattr(repository.os, "scandir", refusing)
    reader = repository.Reader(str(tmp_path), 10)
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    assert [(r[0], r[6]) for r in rows] == [("a.py", None), ("shut", "PermissionError")]


def test_stream_keeps_the_latest_version(spark, tmp_path):
    import datetime as dt
    import hashlib

    arrivals, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*files):
        rows = [(path, text.encode(), hashlib.sha256(text.encode()).hexdigest(), dt.datetime(2026, 1, 1, 0, minute)) for path, text, minute in files]
        spark.createDataFrame(rows, incremental.ARRIVALS).write.mode("append").parquet(arrivals)
        incremental.start(spark, arrivals, out, str(tmp_path / "cp")).awaitTermination(60)
        return sorted((r["relative_path"], r["qualified_name"]) for r in incremental.current(spark, out).collect())

    assert arrive(("a.py", "def one():\n    pass\n", 1), ("b.py", "def two():\n    pass\n", 1)) == [("a.py", "one"), ("b.py", "two")]
    assert arrive(("a.py", "def new():\n    pass\n", 3), ("b.py", "def broken(:\n", 2)) == [("a.py", "new")]
    assert [r["relative_path"] for r in incremental.current_errors(spark, out).collect()] == ["b.py"]
    assert arrive(("a.py", "def late():\n    pass\n", 2), ("b.py", "def fixed():\n    pass\n", 4)) == [("a.py", "new"), ("b.py", "fixed")]
    assert incremental.current_errors(spark, out).count() == 0


def test_sliding_windows_and_sessions(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2026, 1, 1, 12)
    rows = [(1, 7, "x", 1.0, at), (2, 7, "x", 3.0, at + dt.timedelta(minutes=6)), (3, 7, "x", 5.0, at + dt.timedelta(minutes=60))]
    schema = "event_id long, user_id long, event_type string, value double, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))
    sliding = incremental.event_rates(stream, "10 minutes", "0 minutes", "5 minutes")
    sessions = incremental.user_sessions(stream, "30 minutes", "0 minutes")
    for name, frame in (("slide", sliding), ("sessions", sessions)):
        frame.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r["calls"] for r in spark.table("slide").collect()) == [1, 1, 1, 1, 2]
    assert sorted((r["calls"], r["total"]) for r in spark.table("sessions").collect()) == [(1, 5.0), (2, 4.0)]
