import json

import pytest

from siltstone.engine import NO_EVIDENCE, Engine, check_request, focus, parse_summary
from siltstone.operators import embed, store
from siltstone.schemas import IntegrityError
from siltstone.sources import repository

AUTH = 'class AuthService:\n    """Tokens."""\n\n    def create_access_token(self):\n        return jwt_token\n'
USERS = "def find_user(name):\n    return db_user\n"


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "app").mkdir(parents=True)
    (root / "app/auth.py").write_text(AUTH)
    (root / "app/users.py").write_text(USERS)
    (root / "venv").mkdir()
    (root / "venv/skip.py").write_text("x = 1")
    (root / "note.txt").write_text("no")
    (root / "link.py").symlink_to(root / "app/auth.py")
    return root


def test_scan(spark, repo):
    rows = repository.scan(spark, str(repo), group=1).collect()
    assert sorted(r["relative_path"] for r in rows) == ["app/auth.py", "app/users.py"]
    assert all(r["size_bytes"] == len(r["content"]) and r["mtime_ns"] > 0 and len(r["sha256"]) == 64 for r in rows)
    with pytest.raises(NotADirectoryError):
        repository.scan(spark, str(repo / "nothing"))


def test_index_search_ask(spark, repo, tmp_path):
    asked = []
    engine = Engine(spark, str(tmp_path / "index"), embed.HashEmbedder(32), lambda system, user: asked.append(user) or ('{"summary": "Finds.", "notes": []}' if "JSON" in system else "From [S1]."))
    job = engine.index(str(repo))
    assert job.strategy == "full" and job.state == "completed" and job.counters["chunks"] == 3 and job.stages[0] == "scanning"
    assert engine.index(str(repo)).strategy == "no-op"
    for method in ("lexical", "semantic", "hybrid"):
        first = engine.search("create_access_token jwt_token", method, 2).collect()
        assert first[0]["qualified_name"].startswith("AuthService") and [r["rank"] for r in first] == list(range(1, len(first) + 1))
    answer = engine.ask("What does AuthService.create_access_token return?")
    assert answer["status"] == "answered" and [c["qualified_name"] for c in answer["citations"]] == ["AuthService.create_access_token"] and "[S1] app/auth.py:4-5" in asked[0]
    assert engine.document("find_user")["facts"]["parameters"] == [{"name": "name", "annotation": None, "default": None}]
    assert engine.document("nothing")["status"] == "not_found"
    assert engine.overview().first().asDict() == {"files": 2, "chunks": 3, "classes": 1}

    (repo / "app/users.py").write_text(USERS + "\ndef drop_user():\n    pass\n")
    (repo / "app/new.py").write_text("def added():\n    pass\n")
    (repo / "app/auth.py").unlink()
    job = engine.index(str(repo))
    assert job.strategy == "incremental" and job.counters["chunks"] == 3
    assert {r["qualified_name"] for r in engine.store.read("chunks").collect()} == {"find_user", "drop_user", "added"}
    # The change is a layer over the first one, so nothing of that is left over.
    assert engine.store.clean() == [] and {t: len(x) for t, x in engine.store.active()["layers"].items()} == {"files": 2, "chunks": 2, "vectors": 2}

    other = Engine(spark, str(tmp_path / "index"), embed.HashEmbedder(16))
    with pytest.raises(IntegrityError):
        other.search("x", "semantic").collect()


def test_failure_keeps_the_active_index(spark, repo, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "index"), embed.HashEmbedder(8))
    engine.index(str(repo))
    before = engine.store.active()
    (repo / "app/extra.py").write_text("def extra():\n    pass\n")
    monkeypatch.setattr(store.Store, "verify", lambda *a: (_ for _ in ()).throw(IntegrityError("no")))
    with pytest.raises(IntegrityError):
        engine.index(str(repo))
    assert engine.store.active() == before and engine.store.read("chunks").count() == 3
    (tmp_path / "index/active.json").write_text(json.dumps({"generation": "x"}))
    with pytest.raises(IntegrityError):
        engine.store.active()


def test_no_evidence(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    engine = Engine(spark, str(tmp_path / "index"), embed.HashEmbedder(8))
    engine.index(str(tmp_path / "empty"))
    assert engine.ask("anything at all")["answer"] == NO_EVIDENCE


def test_requests():
    for bad in (("", 5), ("x", 0), ("x", 51), ("x", True)):
        with pytest.raises(ValueError):
            check_request(*bad)
    hits = [{"qualified_name": n} for n in ("A.run", "B.run", "go")]
    assert focus("how does a.run work", hits) == hits[:1] and focus("what is B", hits) == hits[1:2] and focus("go", hits) == hits[2:] and focus("other", hits) == hits
    assert parse_summary('```json\n{"summary": "s", "notes": []}\n```')["summary"] == "s"
    for bad in ('{"summary": ""}', '{"summary": "s", "notes": [1]}', "[]"):
        with pytest.raises(ValueError):
            parse_summary(bad)


def test_embedding_retries_and_splits():
    class Flaky(embed.HashEmbedder):
        fails = 2

        def embed_texts(self, texts):
            if self.fails:
                self.fails -= 1
                raise embed.TransientError
            return super().embed_texts(texts)

    waits = []
    assert len(embed.embed_batch(Flaky(8), ["a", "b"], waits.append)) == 2 and waits == [0.5, 1.0]
    provider = embed.HashEmbedder(8, limit=30)
    long = "\n".join(f"line {k}" for k in range(20))
    assert len(embed.embed_batch(provider, ["short", long])) == 2
    small = embed.compacted(long, lambda t: len(t) <= 30)
    assert small.startswith("line 0") and "[...]" in small and len(small) <= 30
    assert embed.canonical_endpoint("HTTP://u:p@Host:80/v1/") == "http://host/v1"


def test_embedding_cache(spark):
    sent = []
    texts = spark.createDataFrame([("1", "a b"), ("2", "a b"), ("3", "c")], "chunk_id string, text string")
    empty = spark.createDataFrame([], "key string, vector array<double>")
    rows, fresh = embed.embed_with_cache(texts, empty, embed.HashEmbedder(4), "n")
    assert rows.count() == 3 and fresh.count() == 2 and not sent
    cache = spark.createDataFrame(fresh.collect(), "key string, vector array<double>")
    assert embed.embed_with_cache(texts, cache, embed.HashEmbedder(4), "n")[1].count() == 0


def test_shell_and_pin(spark, repo, tmp_path, capsys):
    import subprocess

    from siltstone.__main__ import main

    assert main(["index", str(tmp_path / "i"), str(repo)]) == 0 and '"full"' in capsys.readouterr().out
    assert main(["search", str(tmp_path / "i"), "create_access_token", "--method", "lexical"]) == 0 and "app/auth.py" in capsys.readouterr().out
    git = ["git", "-C", str(repo), "-c", "user.name=x", "-c", "user.email=x@example.com"]
    for words in (["init", "-q"], ["add", "."], ["commit", "-qm", "x"]):
        subprocess.run([*git, *words], check=True)
    head = subprocess.run([*git, "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()
    repository.check_pin(str(repo), head)
    with pytest.raises(ValueError):
        repository.check_pin(str(repo), "0" * 40)
    (repo / "app/more.py").write_text("")
    with pytest.raises(ValueError):
        repository.check_pin(str(repo), head)


def test_structural_errors_are_fatal(spark, repo, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), embed.HashEmbedder(8))
    engine.index(str(repo))
    before = engine.store.active()
    (repo / "app/broken.py").write_text("def broken(:\n")
    with pytest.raises(IntegrityError, match="app/broken.py"):
        engine.index(str(repo))
    assert engine.store.active() == before
    job = engine.index(str(repo), allowed_errors=("app/broken.py",))
    assert job.state == "completed" and job.counters["errors"] == 1


def test_sources_are_read_only_as_indexed(spark, repo, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), embed.HashEmbedder(8))
    engine.index(str(repo))
    assert engine.source(str(repo), "app/users.py") == USERS
    with pytest.raises(LookupError):
        engine.source(str(repo), "note.txt")
    (repo / "app/users.py").write_text(USERS + "#")
    with pytest.raises(repository.SourceChanged):
        engine.source(str(repo), "app/users.py")
    (repo / "app/users.py").unlink()
    with pytest.raises(repository.SourceUnavailable):
        engine.source(str(repo), "app/users.py")
    with pytest.raises(ValueError):
        repository.read_checked(str(repo), "../x.py", "")


def test_hooks_and_identity(spark, repo, tmp_path):
    from siltstone.engine import Hooks

    ticks, seen = iter(range(100)), []
    hooks = Hooks(clock=lambda: float(next(ticks)), progress=lambda state, counters: seen.append(state), begin_activation=lambda: seen.append("("), end_activation=lambda: seen.append(")"), prompt=lambda text, blocks: f"{len(blocks)} {text}")
    asked = []
    engine = Engine(spark, str(tmp_path / "index"), embed.HashEmbedder(8), lambda system, user: asked.append(user) or "yes", hooks)
    job = engine.index(str(repo))
    assert list(job.entered.values()) == sorted(job.entered.values()) and seen[-4:] == ["activating", "(", ")", "completed"]
    assert engine.ask("find_user db_user")["answer"] == "yes" and asked[0].endswith("find_user db_user")

    class Elsewhere(embed.HashEmbedder):
        endpoint = "http://other/v1"

    other = Engine(spark, str(tmp_path / "index"), Elsewhere(8))
    with pytest.raises(IntegrityError):
        other.search("x", "semantic")
    assert other.index(str(repo)).strategy == "full"


def test_equal_questions_are_embedded_once():
    calls = []

    class Counting(embed.HashEmbedder):
        def embed_texts(self, texts):
            calls.append(texts)
            return super().embed_texts(texts)

    cache = embed.AskedCache(Counting(4), most=2)
    first = cache.vector("a")
    assert cache.vector("a") == first and len(calls) == 1
    cache.vector("b")
    cache.vector("a")
    cache.vector("c")
    assert cache.vector("a") == first and len(calls) == 3 and len(cache.held) == 2


def test_evaluation_run(spark, repo, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), embed.HashEmbedder(32))
    engine.index(str(repo))
    rows = [("1", "create_access_token jwt_token", "en", "r", "c", 1, "en"), ("2", "find_user db_user", "fa", "r", "c", 1, "fa"), ("3", "nothing here", "en", "r", "c", 2, "en")]
    questions = spark.createDataFrame(rows, "question_id string, text string, language string, repository string, category string, pair_id int, side string")
    found = [(r["relative_path"], r["qualified_name"], r["start_line"], r["end_line"]) for r in engine.store.read("chunks").collect()]
    method, user = next(x for x in found if x[1] == "AuthService.create_access_token"), next(x for x in found if x[1] == "find_user")
    gold = spark.createDataFrame([("1", *method), ("2", *user), ("2", "app/users.py", None, 1, 1), ("3", *user)], "question_id string, source_file string, qualified_name string, start_line int, end_line int")
    study = engine.evaluate(questions, gold, ("lexical", "semantic", "hybrid"), 3)
    r = {(x["question_id"], x["method"]): x for x in study["records"].collect()}
    assert len(r) == 9 and r["1", "lexical"]["first_rank"] in (1, 2) and r["2", "lexical"]["first_rank"] == 1 and r["2", "lexical"]["recall_3"] == 0.5 and r["3", "lexical"]["first_rank"] is None
    metrics = {x["method"]: x for x in study["metrics"].collect()}
    assert metrics["lexical"]["questions"] == 3 and metrics["lexical"]["failures"] == 0 and metrics["lexical"]["not_found"] == 1
    assert study["predictions"].count() > 0 and {x["review_type"] for x in study["review_cases"].collect()} >= {"incomplete_multi_symbol"}
    for name, rows in study.items():
        assert rows.columns, name
        rows.count()
