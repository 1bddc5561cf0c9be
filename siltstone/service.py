"""The engine over HTTP: JSON in, JSON out, on the standard library's server.

GET /health /projects /projects/{id} /projects/{id}/files /projects/{id}/files/{path} /projects/{id}/symbols
/jobs /jobs/{id} /jobs/active /evaluation /evaluation/{name}; POST /projects/index /projects/index-jobs
/projects/{id}/search /projects/{id}/ask /projects/{id}/documentation. Errors are
{"error": {"code", "message"}}; unexpected ones show no details.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import functions as F

from siltstone.engine import Engine, check_request
from siltstone.operators.embed import TransientError
from siltstone.providers import ProviderError
from siltstone.schemas import IntegrityError
from siltstone.sources.repository import SourceChanged, SourceUnavailable


class Refused(Exception):
    """An answer other than success."""

    def __init__(self, status: int, code: str, message: str):
        super().__init__(message)
        self.status, self.code = status, code


#: What failures below the service become; the first class that fits.
FAILURES = (
    (SourceChanged, 409, "source_changed"), (SourceUnavailable, 409, "source_unavailable"), (LookupError, 404, "not_found"), (IntegrityError, 409, "index_state_invalid"),
    (TransientError, 504, "provider_unavailable"), (ProviderError, 502, "provider_failed"), (ValueError, 422, "invalid_request"), (OSError, 400, "invalid_path"),
)


class Service:
    """Projects by name, each with an engine and the folder it was indexed from; one indexing job at a time."""

    def __init__(self, engine_for: Callable[[str], Engine], artifacts: str | None = None):
        self.engine_for, self.artifacts = engine_for, artifacts
        self.projects: dict[str, dict] = {}
        self.jobs: dict[str, dict] = {}
        self.lock, self.indexing = threading.Lock(), threading.Lock()

    # Projects and jobs

    def project(self, name: str) -> dict:
        with self.lock:
            if name not in self.projects:
                raise Refused(404, "project_not_found", "there is no such project")
            return self.projects[name]

    def engine(self, name: str) -> Engine:
        return self.project(name)["engine"]

    def index(self, body: dict, job_id: str | None = None) -> dict:
        name, path = body.get("project"), body.get("path")
        if not isinstance(name, str) or not re.fullmatch(r"[\w.-]{1,100}", name) or not isinstance(path, str):
            raise Refused(422, "invalid_request", "project and path are required")
        if not self.indexing.acquire(blocking=False):
            raise Refused(409, "job_active", "another project is being indexed")
        try:
            with self.lock:
                engine = self.projects[name]["engine"] if name in self.projects else self.engine_for(name)
            job = engine.index(path, tuple(body.get("allowed_errors") or ()))
            with self.lock:
                self.projects[name] = {"engine": engine, "path": path}
            return {"project": name, "strategy": job.strategy, "state": job.state, "counters": job.counters}
        finally:
            self.indexing.release()

    def start(self, body: dict) -> dict:
        job = {"id": uuid.uuid4().hex, "project": body.get("project"), "state": "running", "error": None, "result": None}
        with self.lock:
            if any(j["state"] == "running" for j in self.jobs.values()):
                raise Refused(409, "job_active", "another job is running")
            self.jobs[job["id"]] = job

        def run() -> None:
            try:
                job["result"] = self.index(body)
                job["state"] = "completed"
            except Exception as bad:  # noqa: BLE001  a job ends with its error, not the thread
                job["error"], job["state"] = answer_of(bad)[1]["error"], "failed"

        threading.Thread(target=run, daemon=True).start()
        return dict(job)

    def job(self, job_id: str) -> dict | None:
        with self.lock:
            if job_id == "active":
                return next((dict(j) for j in self.jobs.values() if j["state"] == "running"), None)
            if job_id not in self.jobs:
                raise Refused(404, "job_not_found", "there is no such job")
            return dict(self.jobs[job_id])

    # Reading

    def overview(self, name: str) -> dict:
        return {"project": name, "path": self.project(name)["path"], **self.engine(name).overview().first().asDict()}

    def files(self, name: str) -> list[dict]:
        return [r.asDict() for r in self.engine(name).files().toLocalIterator()]

    def symbols(self, name: str, file: str | None) -> list[dict]:
        rows = self.engine(name).store.read("chunks")
        rows = rows if file is None else rows.where(F.col("relative_path") == file)
        return [r.asDict() for r in rows.select("chunk_id", "chunk_type", "qualified_name", "relative_path", "start_line", "end_line").orderBy("relative_path", "start_line", "chunk_id").toLocalIterator()]

    def source(self, name: str, file: str) -> dict:
        return {"relative_path": file, "content": self.engine(name).source(self.project(name)["path"], file)}

    def search(self, name: str, body: dict) -> dict:
        text, method, limit = body.get("text"), body.get("method", "hybrid"), body.get("limit", 10)
        check_request(text, limit, method)
        rows = self.engine(name).search(text, method, limit).collect()
        return {"results": [{k: r[k] for k in ("rank", "score", "chunk_id", "source_file", "qualified_name", "start_line", "end_line", "code")} for r in rows]}

    def ask(self, name: str, body: dict) -> dict:
        check_request(body.get("text"), body.get("limit", 5))
        return self.engine(name).ask(body["text"], body.get("limit", 5))

    def document(self, name: str, body: dict) -> dict:
        if not isinstance(body.get("identifier"), str) or not body["identifier"].strip():
            raise Refused(422, "invalid_request", "identifier is required")
        found = self.engine(name).document(body["identifier"])
        if found["status"] != "resolved":
            raise Refused(404 if found["status"] == "not_found" else 409, found["status"], ", ".join(found["candidates"]) or "no such symbol")
        return found

    def evaluation(self, name: str = "summary") -> dict:
        path = Path(self.artifacts or "", f"{name}.json")
        if self.artifacts is None or not re.fullmatch(r"[\w-]+", name) or not path.is_file():
            raise Refused(503, "evaluation_unavailable", "there is no such artifact")
        raw = path.read_bytes()
        return {"artifact_sha256": hashlib.sha256(raw).hexdigest(), "data": json.loads(raw)}

    # Routes

    def routes(self) -> list[tuple[str, str, Callable]]:
        """(method, pattern of the path, what answers: (groups, body, query))."""
        return [
            ("GET", r"/health", lambda g, b, q: {"status": "ok"}), ("GET", r"/projects", lambda g, b, q: [self.overview(n) for n in sorted(self.projects)]),
            ("POST", r"/projects/index", lambda g, b, q: self.index(b)), ("POST", r"/projects/index-jobs", lambda g, b, q: (202, self.start(b))),
            ("GET", r"/jobs", lambda g, b, q: [self.job(j) for j in list(self.jobs)]), ("GET", r"/jobs/([\w-]+)", lambda g, b, q: self.job(g[0]) or (204, None)),
            ("GET", r"/projects/([^/]+)", lambda g, b, q: self.overview(g[0])), ("GET", r"/projects/([^/]+)/files", lambda g, b, q: self.files(g[0])),
            ("GET", r"/projects/([^/]+)/files/(.+)", lambda g, b, q: self.source(g[0], g[1])), ("GET", r"/projects/([^/]+)/symbols", lambda g, b, q: self.symbols(g[0], q.get("file"))),
            ("POST", r"/projects/([^/]+)/search", lambda g, b, q: self.search(g[0], b)), ("POST", r"/projects/([^/]+)/ask", lambda g, b, q: self.ask(g[0], b)),
            ("POST", r"/projects/([^/]+)/documentation", lambda g, b, q: self.document(g[0], b)), ("GET", r"/evaluation", lambda g, b, q: self.evaluation()),
            ("GET", r"/evaluation/([^/]+)", lambda g, b, q: self.evaluation(g[0])),
        ]

    def answer(self, method: str, target: str, raw: bytes = b"") -> tuple[int, object]:
        """Status and JSON value of one request."""
        try:
            parts = urlsplit(target)
            for verb, pattern, act in self.routes():
                if verb == method and (m := re.fullmatch(pattern, unquote(parts.path))):
                    body = json.loads(raw) if raw else {}
                    if not isinstance(body, dict):
                        raise Refused(422, "invalid_request", "the body must be a JSON object")
                    got = act(m.groups(), body, {k: v[-1] for k, v in parse_qs(parts.query).items()})
                    return got if isinstance(got, tuple) else (200, got)
            raise Refused(404, "not_found", "there is no such route")
        except Exception as bad:  # noqa: BLE001  every failure is an answer
            return answer_of(bad)


def answer_of(bad: Exception) -> tuple[int, dict]:
    if isinstance(bad, Refused):
        return bad.status, {"error": {"code": bad.code, "message": str(bad)}}
    for kind, status, code in FAILURES:
        if isinstance(bad, kind):
            return status, {"error": {"code": code, "message": str(bad)}}
    return 500, {"error": {"code": "internal_error", "message": "an internal error occurred"}}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server for the service; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            status, value = service.answer(method, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            data = b"" if value is None else json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802  the names that the server calls
            self._reply("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._reply("POST")

        def log_message(self, *_) -> None:
            """Requests may hold questions; nothing is logged."""

    return ThreadingHTTPServer((host, port), Handler)
