"""The engine: index a repository, search it, ask about it, document its functions.

>>> engine = Engine(spark, "/data/index", HashEmbedder())
>>> engine.index("/src/project")
>>> engine.search("where are tokens made", method="hybrid")
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import code
from siltstone.operators import assess, context, embed, rank, store
from siltstone.runtime import sound_unions, stage_table
from siltstone.schemas import IntegrityError, assert_empty
from siltstone.sources import repository

NO_EVIDENCE = "There is not enough retrieved evidence to answer this question."
METHODS = ("lexical", "semantic", "hybrid")
STATES = ("preflight", "scanning", "parsing", "chunking", "embedding", "verifying", "activating", "completed")


@dataclass
class Job:
    """Progress of one indexing run; a failed one tells whether the previous index is still live."""

    state: str = "preflight"
    strategy: str = ""
    stages: list[str] = field(default_factory=list)
    counters: dict[str, int] = field(default_factory=dict)
    error: str | None = None
    previous_index_preserved: bool = True
    entered: dict[str, float] = field(default_factory=dict)
    clock: Callable[[], float] = time.time
    progress: Callable[[str, dict], None] | None = None

    def enter(self, state: str) -> None:
        if state not in self.stages:
            self.stages.append(state)
            self.entered[state] = self.clock()
        self.state = state
        if self.progress:
            self.progress(state, dict(self.counters))


@dataclass
class Hooks:
    """What an engine reads and tells the world by; tests and hosts put their own in."""

    scan: Callable[[SparkSession, str], DataFrame] = repository.scan
    chunks: Callable[[DataFrame], DataFrame] = code.chunks
    clock: Callable[[], float] = time.time
    progress: Callable[[str, dict], None] | None = None
    begin_activation: Callable[[], None] = lambda: None
    end_activation: Callable[[], None] = lambda: None
    system: str = "Answer from the numbered sources only."
    prompt: Callable[[str, list], str] = lambda text, blocks: prompt(text, blocks)


def check_request(text: str, limit: int, method: str = "lexical") -> None:
    if not isinstance(text, str) or not text.strip():
        raise ValueError("the question is blank")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 50:
        raise ValueError("the limit must be a whole number from 1 to 50")
    if method not in METHODS:
        raise ValueError(f"the method must be one of {METHODS}")


class Engine:
    def __init__(self, spark: SparkSession, root: str, provider: embed.EmbeddingProvider, llm: Callable[[str, str], str] | None = None, hooks: Hooks | None = None):
        sound_unions(spark)
        self.spark, self.provider, self.llm, self.hooks = spark, provider, llm, hooks or Hooks()
        self.store, self.asked = store.Store(spark, root), embed.AskedCache(provider)

    # Indexing

    def index(self, path: str, allowed_errors: tuple[str, ...] = ()) -> Job:
        """Full, incremental or no-op indexing; the live index changes only in the last step.

        Files and folders that cannot be read, and files that cannot be parsed, fail the job; parse
        and chunk errors of the paths in ``allowed_errors`` are left out instead.
        """
        job = Job(clock=self.hooks.clock, progress=self.hooks.progress)
        try:
            return self._index(path, allowed_errors, job)
        except Exception as bad:
            job.state, job.error = "failed", f"{type(bad).__name__}: {bad}"
            raise

    def _index(self, path: str, allowed_errors: tuple[str, ...], job: Job) -> Job:
        active, identity = self.store.active(), embed.identity(self.provider)
        active_usable = active is not None and {k: active.get(k) for k in identity} == identity
        job.enter("scanning")
        scanned = stage_table(self.hooks.scan(self.spark, path), "scanned")
        good = scanned.where("error_type IS NULL")
        job.counters["files"] = good.count()
        self._fail(job, scanned.where("error_type IS NOT NULL").select(F.lit("scan").alias("stage"), "relative_path", "error_type", "message", F.lit(None).cast("int").alias("error_line")))
        job.enter("parsing")
        snapshot = repository.snapshot(scanned)
        changed = good
        delta = None
        if active_usable:
            delta = stage_table(store.file_delta(self.store.read("files"), snapshot), "delta")
            if not delta.where("change <> 'unchanged'").take(1):
                job.strategy = "no-op"
                job.enter("completed")
                return job
            job.strategy = "incremental"
            fresh_paths = delta.where("change IN ('added', 'modified')").select("relative_path")
            changed = good.join(fresh_paths, "relative_path", "left_semi")
            kept_chunks = store.retained(self.store.read("chunks").select("relative_path", "chunk_id", "content_hash"), delta)
            kept_vectors = store.reusable_vectors(kept_chunks, self.store.read("vectors"), self.provider.model, self.provider.dimensions)
            assert_empty(kept_chunks.select("chunk_id").join(kept_vectors.select("chunk_id"), "chunk_id", "left_anti"), "a retained chunk has no vector")
        else:
            job.strategy = "full"
        job.enter("chunking")
        chunks, errors = code.split_errors(stage_table(self.hooks.chunks(changed), "parsed"), "chunk")
        job.counters["errors"] = errors.count()
        self._fail(job, errors.where(~F.col("relative_path").isin(*allowed_errors)) if allowed_errors else errors)
        job.enter("embedding")
        vectors = self._vectors(chunks)
        job.enter("verifying")
        if delta is None:
            staged = self.store.stage(snapshot, chunks, vectors, identity)
        else:
            fresh = snapshot.join(delta.where("change IN ('added', 'modified')").select("relative_path"), "relative_path", "left_semi").select(*snapshot.columns)
            staged = self.store.stage_change(delta, fresh, chunks, vectors, identity)
        again = repository.snapshot(self.hooks.scan(self.spark, path))
        if store.symmetric_difference(snapshot, again).take(1):
            self.store.discard(staged)
            raise IntegrityError("the sources changed while they were indexed")
        job.enter("activating")
        self.hooks.begin_activation()
        try:
            self.store.activate(staged, active["generation"] if active else None)
        finally:
            self.hooks.end_activation()
        job.previous_index_preserved = False
        job.counters["chunks"] = self.store.read("chunks").count()
        job.enter("completed")
        return job

    def _fail(self, job: Job, errors: DataFrame, shown: int = 20) -> None:
        """Structural errors end the job before anything is staged."""
        first = errors.orderBy("relative_path", "error_type").limit(shown).collect()
        if first:
            job.counters["fatal_errors"] = errors.count()
            raise IntegrityError("indexing failed: " + "; ".join(f"{r['stage']} {r['relative_path']}{':' + str(r['error_line']) if r['error_line'] else ''}: {r['error_type']}" for r in first))

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        """Vectors of staged chunks; equal texts are embedded once."""
        texts = chunks.select("chunk_id", F.col("embedding_text").alias("text"))
        none = self.spark.createDataFrame([], "key string, vector array<double>")
        done, _ = embed.embed_with_cache(texts, none, self.provider, self.provider.model)
        extra = chunks.select("chunk_id", "content_hash")
        return done.join(extra, "chunk_id").withColumns({"embedding_model": F.lit(self.provider.model), "dimensions": F.lit(self.provider.dimensions)}).select("chunk_id", "vector", "content_hash", "embedding_model", "dimensions")

    # Retrieval

    def _chunks(self) -> DataFrame:
        return self.store.read("chunks").withColumnRenamed("relative_path", "source_file")

    def search_many(self, questions: DataFrame, method: str = "hybrid", limit: int = 10) -> DataFrame:
        """Rankings of a table of (question_id, text), in one job."""
        if method not in METHODS:
            raise ValueError(f"the method must be one of {METHODS}")
        keyed = questions.select(F.col("question_id").cast("string").alias("key"), "text")
        return self._search(questions, lambda: embed.embed(keyed, self.provider).withColumnRenamed("key", "chunk_id"), method, limit)

    def _search(self, questions: DataFrame, vectors: Callable[[], DataFrame], method: str, limit: int) -> DataFrame:
        found = []
        if method in ("semantic", "hybrid"):
            active = self.store.active()
            if active is None or {k: active.get(k) for k in embed.identity(self.provider)} != embed.identity(self.provider):
                raise IntegrityError("the index was made with another embedding model")
            places = self._chunks().select("chunk_id", "source_file", "start_line")
            found.append(rank.semantic(vectors(), self.store.read("vectors").select("chunk_id", "vector").join(places, "chunk_id", "left"), limit, exclude_self=False))
        if method in ("lexical", "hybrid"):
            found.append(rank.lexical(questions, self._chunks(), limit))
        hits = (found[0] if len(found) == 1 else rank.fuse(found[0], found[1], limit)).select("question_id", "rank", "chunk_id", "score")
        return rank.hydrate(hits, self._chunks().drop("embedding_text"), strict=True)

    def search(self, text: str, method: str = "hybrid", limit: int = 10) -> DataFrame:
        check_request(text, limit, method)
        one = self.spark.createDataFrame([("q", text)], "question_id string, text string")
        return self._search(one, lambda: self.spark.createDataFrame([("q", self.asked.vector(text))], "chunk_id string, vector array<double>"), method, limit).orderBy("rank")

    def evaluate(self, questions: DataFrame, expected: DataFrame, methods: tuple[str, ...] = METHODS, limit: int = 20) -> dict[str, DataFrame]:
        """Search all questions with every method and assess the rankings.

        ``questions``: (question_id, text, language, repository, category, pair_id, side); ``expected``:
        (question_id, source_file, qualified_name, start_line, end_line), of which a hit has all, where
        no name equals no name. The tables are those of ``assess.study``, and the predictions.
        """
        if set(methods) - set(METHODS):
            raise ValueError(f"the methods must be some of {METHODS}")
        hits = [self.search_many(questions, method, limit).select("question_id", F.lit(method).alias("method"), "rank", "chunk_id", "source_file", "qualified_name", "start_line", "end_line") for method in methods]
        predictions = stage_table(reduce(DataFrame.unionByName, hits), "predictions")
        chunks = self._chunks().select("chunk_id", "source_file", "qualified_name", "start_line", "end_line").alias("c")
        key = ("source_file", "qualified_name", "start_line", "end_line")
        same = reduce(lambda a, b: a & b, [F.col(f"e.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key])
        # An expected citation that no chunk has can never be found, but counts among the expected.
        gold = expected.select(F.col("question_id").cast("string").alias("question_id"), *key).distinct().alias("e").join(chunks, same, "left")
        gold = gold.select("e.question_id", F.coalesce("c.chunk_id", F.concat(F.lit("none "), F.sha2(F.to_json(F.struct(*[f"e.{k}" for k in key])), 256))).alias("chunk_id")).distinct()
        asked = questions.drop("text").withColumn("question_id", F.col("question_id").cast("string"))
        r = stage_table(assess.records(asked, methods, predictions.withColumn("question_id", F.col("question_id").cast("string")), gold), "records")
        return assess.study(r, methods[0], methods[-1]) | {"predictions": predictions}

    def measure(self, questions: list[str], methods: tuple[str, ...] = METHODS, repeats: int = 3, limit: int = 10) -> DataFrame:
        """(method, question, repetition, milliseconds, chunk_ids) of single searches, one after another; repetition 0 warms up."""
        rows = []
        for method in methods:
            for repetition in range(repeats + 1):
                for number, text in enumerate(questions[:1] if repetition == 0 else questions):
                    began = self.hooks.clock()
                    found = [r["chunk_id"] for r in self.search(text, method, limit).collect()]
                    rows.append((method, number, repetition, 1000.0 * (self.hooks.clock() - began), found))
        return self.spark.createDataFrame(rows, "method string, question int, repetition int, milliseconds double, chunk_ids array<string>")

    # Answers

    def context(self, text: str, limit: int = 5, budget: int = context.BUDGET) -> tuple[list, int]:
        """Blocks that fit in the budget, focused on symbols that the question names, and how many did not fit."""
        hits = self.search(text, "hybrid", limit).collect()
        focused = focus(text, hits)
        blocks, used, omitted, seen = [], 0, 0, set()
        for h in sorted(focused, key=lambda h: (-h["score"], h["source_file"], h["start_line"], h["chunk_id"])):
            if h["chunk_id"] in seen:
                continue
            seen.add(h["chunk_id"])
            if used + len(h["code"]) <= budget:
                blocks.append(h)
                used += len(h["code"])
            else:
                omitted += 1
        return blocks, omitted

    def ask(self, text: str, limit: int = 5, budget: int | None = None) -> dict:
        """Answer with citations out of the metadata; without evidence the model is not asked."""
        blocks, omitted = self.context(text, limit, budget or context.BUDGET)
        citations = [{"source_file": b["source_file"], "qualified_name": b["qualified_name"], "start_line": b["start_line"], "end_line": b["end_line"]} for b in blocks]
        if not blocks:
            return {"status": "no_evidence", "answer": NO_EVIDENCE, "citations": [], "omitted": omitted}
        if self.llm is None:
            raise ValueError("no language model is set")
        return {"status": "answered", "answer": self.llm(self.hooks.system, self.hooks.prompt(text, blocks)), "citations": citations, "omitted": omitted}

    def document(self, name: str) -> dict:
        """Facts of one function, by chunk id, qualified name or short name, and a summary if a model is set."""
        chunks = self._chunks().where("chunk_type IN ('function', 'method')")
        tier = F.when(F.col("chunk_id") == name, 1).when(F.col("qualified_name") == name, 2).when(F.element_at(F.split("qualified_name", r"\."), -1) == name, 3)
        found = chunks.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", "source_file", "start_line").collect()
        found = [r for r in found if r["tier"] == found[0]["tier"]]
        if len(found) != 1:
            return {"status": "ambiguous" if found else "not_found", "candidates": [r["qualified_name"] for r in found]}
        row = found[0]
        facts = code.facts_of(row["code"], row["qualified_name"].rsplit(".", 1)[-1])
        out = {"status": "resolved", "qualified_name": row["qualified_name"], "source_file": row["source_file"], "start_line": row["start_line"], "end_line": row["end_line"], "facts": facts}
        if self.llm:
            out["summary"] = parse_summary(self.llm("Reply with JSON: summary, notes.", row["code"]))
        return out

    # Explorer

    def source(self, root: str, relative: str) -> str:
        """The text of an indexed file under ``root``, if it is still what was indexed."""
        row = self.store.read("files").where(F.col("relative_path") == relative).select("sha256").first()
        if row is None:
            raise LookupError(f"{relative} is not indexed")
        return repository.read_checked(root, relative, row["sha256"])

    def files(self) -> DataFrame:
        return self.store.read("files").orderBy("relative_path")

    def overview(self) -> DataFrame:
        chunks = self.store.read("chunks")
        return chunks.agg(F.countDistinct("relative_path").alias("files"), F.count("*").alias("chunks"), F.count_if(F.col("chunk_type") == "class_overview").alias("classes"))


def focus(text: str, hits: list) -> list:
    """Hits whose dotted name the question mentions, else those of a class it mentions, else of a bare symbol, else all."""

    def mentioned(name: str, flags: int, after: str) -> bool:
        return re.search(rf"(?<![\w.]){re.escape(name)}{after}", text, flags) is not None

    tiers = (
        lambda n: "." in n and mentioned(n, re.I, r"(?!\w)"),
        lambda n: mentioned(n.split(".", 1)[0], 0, r"(?![\w.])"),
        lambda n: not n.rsplit(".", 1)[-1].startswith("__") and mentioned(n.rsplit(".", 1)[-1], 0, r"(?![\w.])"),
    )
    for tier in tiers:
        if best := [h for h in hits if tier(h["qualified_name"])]:
            return best
    return hits


def prompt(text: str, blocks: list) -> str:
    sources = "\n\n".join(f"[S{k}] {b['source_file']}:{b['start_line']}-{b['end_line']}\n{b['code']}" for k, b in enumerate(blocks, 1))
    return f"{sources}\n\nQuestion: {text}"


def parse_summary(reply: str) -> dict:
    """Strict JSON reply, with one code fence or none: a bounded summary and at most 50 bounded notes."""
    fenced = re.fullmatch(r"\s*```(?:json)?\s*(.*?)\s*```\s*", reply, re.S)
    data = json.loads(fenced[1] if fenced else reply)
    good = isinstance(data, dict) and set(data) == {"summary", "notes"} and isinstance(data["summary"], str) and 0 < len(data["summary"]) <= 8000
    if not good or not isinstance(data["notes"], list) or len(data["notes"]) > 50 or not all(isinstance(n, str) and len(n) <= 8000 for n in data["notes"]):
        raise ValueError("the model's reply has the wrong form")
    return data


