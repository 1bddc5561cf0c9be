import json

import pytest

from siltstone.functions import code
from siltstone.operators import assembly, judging
from siltstone.operators.embed import TransientError
from siltstone.providers import Reply

CRITERIA = ("a", "b")


class Judge:
    """Scores by the prompt's last digit; fails as the prompt says."""

    def __init__(self, credit=True):
        self.credit = credit

    def generate(self, request):
        if not self.credit and "stop" in request.prompt:
            raise judging.CreditExhausted
        if "bad" in request.prompt:
            return Reply('{"a": 99}', "m", "p")
        n = int(request.prompt[-1])
        return Reply(json.dumps({"a": n + 1, "b": n + 2}), "m", "p")


def test_scores():
    assert judging.scores_of('```json\n{"a": 1, "b": 20}\n```', CRITERIA) == {"a": 1, "b": 20}
    for bad in ('{"a": 1}', '{"a": true, "b": 1}', '{"a": 0, "b": 1}', '{"a": 1.0, "b": 1}', "[]", "no"):
        with pytest.raises(ValueError):
            judging.scores_of(bad, CRITERIA)


def test_failures_are_tried_again():
    class Flaky(Judge):
        left = 2

        def generate(self, request):
            if self.left:
                self.left -= 1
                raise TransientError
            return super().generate(request)

    waits = []
    record = judging.judge_one(Flaky(), "x 3", CRITERIA, waits.append)
    assert record["status"] == "usable" and record["attempts"] == 3 and waits == [1.0, 2.0] and record["mean"] == 4.5
    assert judging.judge_one(Judge(), "bad 1", CRITERIA, waits.append)["error_type"] == "ValueError"


def test_passes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(judging, "WAITS", ())
    rows = [(q, arm, "stop 1" if (q, arm) == (1, "y") else f"{'bad' if q == 3 else 'ok'} {q}") for q in range(6) for arm in "xy"]
    answers = spark.createDataFrame(rows, "question int, arm string, prompt string")
    plan, mapping = judging.blind_plan(answers, ["question", "arm"], "s", ["prompt"])
    assert plan.columns == ["blind_id", "prompt"] and sorted(r["blind_id"] for r in plan.collect()) == [f"N{k:08d}" for k in range(1, 13)]
    assert [tuple(r) for r in judging.blind_plan(answers, ["question", "arm"], "s", ["prompt"])[1].orderBy("blind_id").collect()] == [tuple(r) for r in mapping.orderBy("blind_id").collect()]
    log = str(tmp_path / "log")
    first = judging.run_pass(spark, plan.coalesce(1).sortWithinPartitions("blind_id"), "prompt", Judge(credit=False), log, 1, CRITERIA)
    assert first.where("error_type = 'CreditExhausted'").count() == 1 and first.count() <= 12
    second = judging.run_pass(spark, plan, "prompt", Judge(), log, 1, CRITERIA)
    assert second.count() == 12 - first.where("status = 'usable'").count()
    assert judging.usable(judging.records(spark, log)).count() == 10  # question 3 never gives scores
    third = judging.run_pass(spark, plan, "prompt", Judge(), log, 1, CRITERIA, limit=1)
    assert third.count() == 1 and third.first()["status"] == "unavailable" and third.first()["run"] == 3
    sample = judging.second_pass(mapping, ["arm"], 0.3, "s")
    assert sample.count() == 4
    judging.run_pass(spark, plan.join(sample, "blind_id"), "prompt", Judge(), log, 2, CRITERIA)
    units = {(r["question"], r["arm"]): r for r in judging.unit_scores(judging.records(spark, log), mapping, ["question", "arm"], CRITERIA).collect()}
    assert len(units) == 10 and units[2, "x"]["a"] == 3.0 and units[2, "x"]["mean"] == 3.5 and {r["passes"] for r in units.values()} == {1, 2}


def test_assembled_context(spark):
    body = "def load_user(name):\n" + "".join(f"    step_{k} = {k}\n" for k in range(200)) + "    token_cache = name\n" + "".join(f"    after_{k} = {k}\n" for k in range(200))
    rows = [
        (1, "where does load_user fill the token_cache", 1, "hub", "class_overview", "Big", "big.py", 1, "class Big:\n" + "    x = 1\n" * 400), (1, "where does load_user fill the token_cache", 2, "other", "function", "other", "o.py", 5, "def other():\n    pass"),
        (1, "where does load_user fill the token_cache", 3, "user", "function", "load_user", "u.py", 10, body),
    ]
    hits = spark.createDataFrame(rows, "question_id int, text string, rank int, chunk_id string, chunk_type string, qualified_name string, source_file string, start_line int, code string")
    got = assembly.assemble(hits).orderBy("place").collect()
    assert [r["chunk_id"] for r in got] == ["user"] * (len(got) - 1) + ["other"]
    spans = code.excerpt_spans(body, rows[0][1])
    assert [(r["start_line"] - 10, r["end_line"] - 10) for r in got[:-1]] == spans and any("token_cache" in r["code"] for r in got)
    small = assembly.assemble(hits, budget=30).collect()
    assert sum(len(r["code"]) for r in small) <= 30 and [r["chunk_id"] for r in small] in (["user", "other"], ["user"], ["other"])


def test_measured_searches(spark, tmp_path):
    from siltstone.engine import Engine, Hooks
    from siltstone.operators import embed

    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def find_user(name):\n    return name\n")
    ticks = iter(range(1000))
    engine = Engine(spark, str(tmp_path / "i"), embed.HashEmbedder(8), hooks=Hooks(clock=lambda: float(next(ticks))))
    engine.index(str(root))
    rows = engine.measure(["find_user", "name"], ("lexical",), 2).collect()
    assert [(r["question"], r["repetition"]) for r in rows] == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2)] and {r["milliseconds"] for r in rows} == {1000.0} and rows[0]["chunk_ids"]


class Counting(Judge):
    """Writes a file for every call; the credit ends at the third."""

    def __init__(self, folder):
        self.folder = folder

    def generate(self, request):
        import os
        import time
        import uuid

        made = len(os.listdir(self.folder))
        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        if made >= 2:
            raise judging.CreditExhausted
        time.sleep(0.3)
        return Reply(json.dumps({"a": 1, "b": 2}), "m", "p")


def test_all_tasks_stop_at_exhausted_credit(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    plan = spark.createDataFrame([(f"N{k:03d}", f"text {k}") for k in range(200)], "blind_id string, prompt string").repartition(4)
    got = judging.run_pass(spark, plan, "prompt", Counting(str(tmp_path / "calls")), str(tmp_path / "log"), 1, CRITERIA).collect()
    calls = len(list((tmp_path / "calls").iterdir()))
    assert calls == len(got) <= 2 + 2 * 4 and any(r["error_type"] == "CreditExhausted" for r in got)


def test_a_repeated_task_does_not_ask_twice(tmp_path):
    ledger = judging.Ledger(str(tmp_path / "l"))
    assert ledger.kept("a") is None and not ledger.stopped()
    record = {"status": "usable", "scores": {"a": 1}, "mean": 1.0, "attempts": 1, "error_type": None, "at": 2.5}
    ledger.keep("a", record)
    ledger.stop("a")
    again = judging.Ledger(f"file://{tmp_path}/l")
    assert again.kept("a") == record and again.kept("b") is None and again.stopped()
