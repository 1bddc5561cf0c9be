import json
import threading
import time
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from siltstone.engine import Engine
from siltstone.operators import embed
from siltstone.operators.vector_index import ParquetVectors
from siltstone.providers import Client, Config, ProviderError, Reply, Request
from siltstone.schemas import IntegrityError
from siltstone.service import Service, serve


@pytest.fixture
def server():
    """A provider that answers from ``answers`` and keeps what it was sent."""
    answers, sent = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            sent.append((self.path, dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, body = answers.pop(0)
            data = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}/v1", answers, sent
    httpd.shutdown()


def test_embedding_dialects(server):
    url, answers, sent = server
    config = Config.read({"SILTSTONE_DIALECT": "openai", "SILTSTONE_ENDPOINT": url + "/", "SILTSTONE_KEY": "secret", "SILTSTONE_EMBEDDING_MODEL": "m", "SILTSTONE_DIMENSIONS": "2"})
    provider = config.embedder()
    answers.append((200, {"data": [{"index": 1, "embedding": [0, 1]}, {"index": 0, "embedding": [1, 0]}]}))
    assert provider.embed_texts(["a", "b"]) == [[1.0, 0.0], [0.0, 1.0]] and embed.identity(provider, "")["model"] == "m"
    assert sent[0][0] == "/v1/embeddings" and sent[0][1]["Authorization"] == "Bearer secret" and "secret" not in repr(config) + repr(provider.client)
    local = Config.read({}, endpoint=url, embedding_model="n").embedder()
    answers.append((200, {"embeddings": [[1, 2, 3]]}))
    assert local.dimensions == 3 and sent[1][0] == "/v1/api/embed" and sent[1][2]["truncate"] is False
    for status, body, error in ((429, {}, embed.TransientError), (503, {}, embed.TransientError), (400, {"error": "maximum context length"}, embed.InputTooLong), (404, {}, ProviderError), (200, b"no json", ProviderError), (200, {"data": [{"index": 0, "embedding": [1]}]}, ProviderError), (200, {"data": [{"index": 0, "embedding": [1]}, {"index": 0, "embedding": [1]}]}, ProviderError), (200, {"data": [{"index": 0, "embedding": [True, 0]}, {"index": 1, "embedding": [1, 2]}]}, ProviderError)):
        answers.append((status, body))
        with pytest.raises(error):
            provider.embed_texts(["a", "b"])
    with pytest.raises(embed.TransientError):
        Client("http://127.0.0.1:9", None, 1).post("x", {})


def test_text_dialects(server):
    url, answers, sent = server
    chat = Config.read({}, dialect="openai", endpoint=url, llm_model="w").writer()
    answers.append((200, {"model": "w-2", "choices": [{"message": {"content": "hello"}, "finish_reason": "stop"}]}))
    assert chat.generate(Request("hi", "be short", most_tokens=5, as_json=True)) == Reply("hello", "w-2", "openai", "stop")
    assert sent[0][2]["messages"][0] == {"role": "system", "content": "be short"} and sent[0][2]["max_tokens"] == 5 and sent[0][2]["response_format"] == {"type": "json_object"}
    plain = Config.read({}, endpoint=url, llm_model="w").writer()
    answers.append((200, {"response": "yes", "done_reason": "stop"}))
    assert plain("system", "prompt") == "yes" and sent[1][2]["system"] == "system" and sent[1][2]["stream"] is False
    answers.append((200, {"choices": []}))
    with pytest.raises(ProviderError):
        chat("s", "p")


def test_configuration():
    for bad in ({"dialect": "other", "embedding_model": "m"}, {"dialect": "openai", "embedding_model": "m"}, {"embedding_model": " "}, {"embedding_model": "m", "dimensions": 0}, {"embedding_model": "m", "seconds": -1.0}, {"embedding_model": "m", "endpoint": "http://u:p@h"}):
        with pytest.raises(ValueError):
            Config.read({}, **bad).embedder()
    with pytest.raises(ValueError):
        Config.read({"SILTSTONE_SECONDS": "soon"})
    with pytest.raises(ValueError):
        Config.read({}).writer()
    for bad in ({"prompt": " "}, {"prompt": "x", "temperature": -1}, {"prompt": "x", "most_tokens": 0}):
        with pytest.raises(ValueError):
            Request(**bad)


def test_vector_collection(spark, tmp_path):
    index = ParquetVectors(spark, str(tmp_path / "v"))
    with pytest.raises(IntegrityError):
        index.list_ids()
    index.initialize()
    index.initialize()

    def records(*rows):
        return spark.createDataFrame([(k, v, p, "h") for k, v, p in rows], "chunk_id string, vector array<double>, project_id long, content_hash string")

    index.upsert(records(("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 2)))
    index.upsert(records(("b", [0.6, 0.8], 2), ("c", [0.0, 2.0], 2)))
    assert sorted(r[0] for r in index.list_ids(2).collect()) == ["b", "c"] and index.list_ids().count() == 3
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "chunk_id string, vector array<double>")
    assert [(r["chunk_id"], r["score"], r["distance"]) for r in index.search(asked, 2).orderBy("rank").collect()] == [("a", 1.0, 0.0), ("b", 0.6, 0.4)]
    one = spark.createDataFrame([("b",), ("x",)], "chunk_id string")
    assert index.get_vectors(one).first()["vector"] == [0.6, 0.8] and "vector" not in index.get(one).columns
    index.set_index_metadata({"a": 1})
    index.set_index_metadata({"b": 2})
    index.delete(one)
    assert index.get_index_metadata() == {"a": 1, "b": 2} and index.list_ids().count() == 2
    ids = spark.createDataFrame([("z",)], "chunk_id string")
    with pytest.raises(IntegrityError):
        index.replace_collection(records(("y", [1.0, 1.0], 1)), {}, ids)
    with pytest.raises(IntegrityError):
        index.upsert(records(("a", [1.0], 1)))
    assert index.list_ids().count() == 2
    index.replace_collection(records(("z", [1.0, 1.0], 1)), {"new": True}, ids)
    assert [r[0] for r in index.list_ids().collect()] == ["z"] and index.get_index_metadata() == {"new": True} and len(index.folder.children()) == 2


def test_service(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def find_user(name):\n    return name\n")
    (tmp_path / "art").mkdir()
    (tmp_path / "art/summary.json").write_text('{"x": 1}')
    service = Service(lambda name: Engine(spark, str(tmp_path / "index" / name), embed.HashEmbedder(8), lambda system, user: "it finds"), str(tmp_path / "art"))
    httpd = serve(service, port=0)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()

    def ask(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{httpd.server_port}{path}", data), timeout=120) as r:
                return r.status, json.loads(r.read() or b"null")
        except urllib.error.HTTPError as bad:
            return bad.code, json.loads(bad.read())["error"]["code"]

    assert ask("/health") == (200, {"status": "ok"}) and ask("/projects") == (200, []) and ask("/nothing")[0] == 404
    assert ask("/projects/p")[1] == "project_not_found" and ask("/projects/index", {"project": "p"})[1] == "invalid_request"
    assert ask("/projects/index", {"project": "p", "path": str(root)})[1]["strategy"] == "full"
    assert ask("/projects/p")[1]["files"] == 1 and [f["relative_path"] for f in ask("/projects/p/files")[1]] == ["a.py"]
    assert ask("/projects/p/files/a.py")[1]["content"].startswith("def find_user") and ask("/projects/p/files/b.py")[0] == 404
    assert [s["qualified_name"] for s in ask("/projects/p/symbols?file=a.py")[1]] == ["find_user"] and ask("/projects/p/symbols?file=b.py")[1] == []
    assert ask("/projects/p/search", {"text": "find_user", "method": "lexical", "limit": 1})[1]["results"][0]["qualified_name"] == "find_user"
    assert ask("/projects/p/search", {"text": "x", "limit": 0}) == (422, "invalid_request")
    assert ask("/projects/p/ask", {"text": "what does find_user do"})[1]["answer"] == "it finds"
    assert ask("/projects/p/documentation", {"identifier": "nothing"}) == (404, "not_found")
    assert ask("/evaluation")[1]["data"] == {"x": 1} and ask("/evaluation/other") == (503, "evaluation_unavailable")
    status, job = ask("/projects/index-jobs", {"project": "p", "path": str(root)})
    assert status == 202
    for _ in range(100):
        if (done := ask(f"/jobs/{job['id']}")[1])["state"] != "running":
            break
        time.sleep(0.3)
    assert done["state"] == "completed" and done["result"]["strategy"] == "no-op" and ask("/jobs/active") == (204, None) and ask("/jobs/none")[0] == 404
    (root / "a.py").write_text("changed = 1\n")
    assert ask("/projects/p/files/a.py") == (409, "source_changed")
    httpd.shutdown()
