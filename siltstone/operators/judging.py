"""Blinded judging in passes: a plan that hides arms, calls in parallel, an append-only log, resumption and a stop.

The log is a Parquet folder; every run of a pass appends its records, and the latest usable one of a
blind id counts. A run takes up only what has no usable record yet, so a stopped pass goes on where it
ended. Records say why they are unusable and are never scored.

While a run is under way, a folder beside the log holds what its tasks tell each other: a stop mark, which
every task looks for before each call, and the record of each call that was made, so that a task that is
run again, or twice, does not ask twice. It is reached from the tasks by Arrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.embed import TransientError
from siltstone.providers import LLMProvider, Request
from siltstone.runtime import numbered, stage_table

CRITERIA = ("correctness", "completeness", "relevance", "clarity", "reasoning")
MOST = 20
WAITS = (1.0, 2.0, 4.0)
RECORD = "blind_id string, pass int, run int, status string, scores map<string,int>, mean double, attempts int, error_type string, at double"


class CreditExhausted(RuntimeError):
    """The provider gives no more answers; nothing else of the pass is asked."""


def scores_of(reply: str, criteria: tuple[str, ...] = CRITERIA, most: int = MOST) -> dict[str, int]:
    """The criteria of a JSON reply, with one code fence or none; each a whole number from 1 to ``most``."""
    fenced = re.fullmatch(r"\s*```(?:json)?\s*(.*?)\s*```\s*", reply, re.S)
    data = json.loads(fenced[1] if fenced else reply)
    found = {c: data.get(c) for c in criteria} if isinstance(data, dict) else {}
    if not found or any(isinstance(v, bool) or not isinstance(v, int) or not 1 <= v <= most for v in found.values()):
        raise ValueError("the reply holds no usable scores")
    return found


def blind_plan(answers: DataFrame, keys: list[str], seed: str, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(blind_id, texts...) in a seeded order that shows no key, and the mapping (blind_id, keys...)."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256)
    placed = numbered(answers.withColumn("_digest", digest), ["_digest", *keys], "_place")
    placed = stage_table(placed.withColumn("blind_id", F.concat(F.lit("N"), F.lpad(F.col("_place").cast("string"), 8, "0"))), "blind")
    return placed.select("blind_id", *texts), placed.select("blind_id", *keys)


def second_pass(mapping: DataFrame, by: list[str], share: float, seed: str) -> DataFrame:
    """The blind ids of a second pass: the share of every group, rounded up, by hash."""
    group = Window.partitionBy(*by)
    order = group.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "blind_id"), 256), "blind_id")
    chosen = mapping.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count("*").over(group))
    return chosen.where(F.col("_k") <= F.ceil(F.col("_n") * share)).select("blind_id")


def judge_one(provider: LLMProvider, prompt: str, criteria: tuple[str, ...], sleep: Callable[[float], None] = time.sleep) -> dict:
    """One record: scores, or why there are none; failures worth it are tried again."""
    error = ""
    for attempt in range(1, len(WAITS) + 2):
        try:
            got = scores_of(provider.generate(Request(prompt, as_json=True)).text, criteria)
            return {"status": "usable", "scores": got, "mean": sum(got.values()) / len(got), "attempts": attempt, "error_type": None}
        except CreditExhausted as bad:
            error = type(bad).__name__
            break
        except (TransientError, ValueError, RuntimeError) as bad:
            error = type(bad).__name__
            if attempt <= len(WAITS):
                sleep(WAITS[attempt - 1])
    return {"status": "unavailable", "scores": None, "mean": math.nan, "attempts": attempt, "error_type": error}


class Ledger:
    """What the tasks of one run tell each other, as small files in a folder that all reach."""

    STOP = "stop"

    def __init__(self, folder: str):
        self.folder = folder

    def _at(self, name: str) -> tuple[pyarrow.fs.FileSystem, str]:
        system, path = pyarrow.fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), self.folder)
        return system, f"{path}/{name}"

    def _write(self, name: str, text: str) -> None:
        system, path = self._at(name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        # Written aside and moved, so a reader never sees a part.
        aside = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as out:
            out.write(text.encode())
        system.move(aside, path)

    def _read(self, name: str) -> str | None:
        system, path = self._at(name)
        if system.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            return None
        with system.open_input_stream(path) as held:
            return held.read().decode()

    @staticmethod
    def _name(blind_id: str) -> str:
        return f"calls/{hashlib.sha256(blind_id.encode()).hexdigest()}.json"

    def stopped(self) -> bool:
        return self._read(self.STOP) is not None

    def stop(self, blind_id: str) -> None:
        self._write(self.STOP, blind_id)

    def kept(self, blind_id: str) -> dict | None:
        """The record of a call that was made before."""
        text = self._read(self._name(blind_id))
        return None if text is None else json.loads(text)

    def keep(self, blind_id: str, record: dict) -> None:
        self._write(self._name(blind_id), json.dumps(record))


def run_pass(spark: SparkSession, plan: DataFrame, prompt: str, provider: LLMProvider, log: str, number: int, criteria: tuple[str, ...] = CRITERIA, limit: int | None = None) -> DataFrame:
    """Judge what the pass still lacks and append it to the log; returns the records of this run.

    ``plan``: blind_id and the column ``prompt``. ``limit`` is a number of calls that a run may make. The
    run stops as a whole at exhausted credit: that record keeps the evidence, and no task asks for another
    row once the stop mark is there. Calls that are under way then still end, one a task at most.
    """
    done = records(spark, log).where(F.col("pass") == number)
    run = (done.agg(F.max("run").alias("r")).first()["r"] or 0) + 1
    todo = plan.join(usable(done).select("blind_id"), "blind_id", "left_anti").select("blind_id", F.col(prompt).alias("prompt"))
    todo = todo if limit is None else todo.orderBy("blind_id").limit(limit)
    ledger = Ledger(f"{log.rstrip('/')}.running/{number}-{run}-{uuid.uuid4().hex}")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for blind, text in zip(frame["blind_id"], frame["prompt"], strict=True):
                record = ledger.kept(blind)
                if record is None:
                    if ledger.stopped():
                        break
                    record = judge_one(provider, text, criteria) | {"at": time.time()}
                    if record["error_type"] == CreditExhausted.__name__:
                        ledger.stop(blind)
                    ledger.keep(blind, record)
                rows.append({"blind_id": blind, "pass": number, "run": run} | record)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    judged = stage_table(todo.mapInPandas(work, RECORD), "judged")  # calls are made once, whatever reads the records
    judged.write.mode("append").parquet(log)
    return judged


def records(spark: SparkSession, log: str) -> DataFrame:
    """All records of a log; none before its first run."""
    from siltstone.operators.folder import Folder

    return spark.read.schema(RECORD).parquet(log) if Folder(spark, log).exists() else spark.createDataFrame([], RECORD)


def usable(log: DataFrame) -> DataFrame:
    """The latest usable record of every blind id and pass."""
    good = log.where("status = 'usable'")
    names = [c for c in log.columns if c not in ("blind_id", "pass")]
    return good.groupBy("blind_id", "pass").agg(F.max_by(F.struct(*names), F.struct("run", "at")).alias("r")).select("blind_id", "pass", "r.*")


def unit_scores(log: DataFrame, mapping: DataFrame, keys: list[str], criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Unblinded units (keys..., passes, mean, criteria...): means over the usable passes."""
    joined = usable(log).join(mapping, "blind_id")
    return joined.groupBy(*keys).agg(F.count("*").alias("passes"), F.avg("mean").alias("mean"), *[F.avg(F.col("scores")[c]).alias(c) for c in criteria])
