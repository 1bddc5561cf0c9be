"""``python -m siltstone ACTION INDEX [VALUE]``: the engine from a shell.

index FOLDER [--pin COMMIT] [--allow PATH], search TEXT, ask TEXT, document NAME, files, serve. Vectors
are offline ones, or those of a configured provider with ``--provider``.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from siltstone.engine import METHODS, Engine
from siltstone.operators.embed import HashEmbedder
from siltstone.providers import DIALECTS, Config
from siltstone.sources.repository import check_pin


def engine_of(args: argparse.Namespace, root: str) -> Engine:
    config = Config.read(dialect=args.provider, endpoint=args.endpoint, embedding_model=args.embedding_model, llm_model=args.llm_model, dimensions=args.dimensions if args.provider else None)
    provider = config.embedder() if args.provider else HashEmbedder(args.dimensions or 64)
    return Engine(SparkSession.builder.getOrCreate(), root, provider, config.writer() if config.llm_model else None)


def main(words: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    parser.add_argument("action", choices=("index", "search", "ask", "document", "files", "serve"))
    parser.add_argument("index")
    parser.add_argument("value", nargs="?", default="")
    parser.add_argument("--method", choices=METHODS, default="hybrid")
    parser.add_argument("--limit", type=int, default=10)
    parser.add_argument("--budget", type=int, default=6000, help="characters of context for an answer")
    parser.add_argument("--dimensions", type=int)
    parser.add_argument("--pin", help="the commit that the folder must be at, without changes")
    parser.add_argument("--allow", action="append", default=[], help="a file whose errors do not fail the job")
    parser.add_argument("--provider", choices=DIALECTS)
    parser.add_argument("--endpoint")
    parser.add_argument("--embedding-model")
    parser.add_argument("--llm-model")
    parser.add_argument("--port", type=int, default=8000)
    args = parser.parse_args(words)
    if args.action == "serve":
        from siltstone.service import Service, serve

        server = serve(Service(lambda name: engine_of(args, f"{args.index}/{name}"), args.value or None), port=args.port)
        print(f"http://127.0.0.1:{server.server_port}", flush=True)
        server.serve_forever()
        return 0
    engine = engine_of(args, args.index)
    if args.action == "index":
        if args.pin:
            check_pin(args.value, args.pin)
        job = engine.index(args.value, tuple(args.allow))
        print(json.dumps({"strategy": job.strategy, "state": job.state, "counters": job.counters}))
    elif args.action == "search":
        for r in engine.search(args.value, args.method, args.limit).collect():
            print(json.dumps({k: r[k] for k in ("rank", "score", "source_file", "qualified_name", "start_line", "end_line")}))
    elif args.action == "ask":
        print(json.dumps(engine.ask(args.value, args.limit, args.budget)))
    elif args.action == "document":
        print(json.dumps(engine.document(args.value)))
    else:
        for r in engine.files().toLocalIterator():
            print(r["relative_path"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
