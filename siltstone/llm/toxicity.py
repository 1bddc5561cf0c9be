"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its lower-cased words and their first 4, 5 and 6 bytes, as 32-bit hashes;
presence counts, not frequency. The score is the logistic function of a bias, a weight per term
and, for every pair of terms, the inner product of their factor vectors, so a combination such as
an insult with a group mention can weigh more than the sum of its parts. The terms that the
machine covers are those that differ most between the classes (chi-square) in the sample.

It is fitted on the driver from a bounded sample of labelled rows (``positives`` and ``negatives``
rows); the model's size does not depend on the data. Defined cases: a null or empty text has the
score of the bias alone; very long texts are scored whole; without labelled rows of both classes all
scores are 0; a document with several labels counts as toxic if one of them is; a null id is not held
out; repeated rows are scored each and learnt once; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.sampling import first_of_each, held_out, once, per_class
from siltstone.llm.textbytes import flatten, lean, lower_ascii, slices, span_hashes, trim
from siltstone.runtime import small_batches

PREFIXES = (4, 5, 6)
SLOT_BITS = 20


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 32-bit hash of every term occurrence; words are runs of letters, digits and non-ASCII bytes."""
    raw = lower_ascii(raw)
    inside = ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw >= 128)
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    before[cuts] = False
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    owner, begin, end = [text], [starts], [ends]
    for n in PREFIXES:
        long = ends - starts > n
        owner.append(text[long])
        begin.append(starts[long])
        end.append(starts[long] + n)
    at = np.concatenate(begin)
    kind = np.repeat(np.arange(len(owner), dtype=np.uint64), [len(x) for x in owner])
    return np.concatenate(owner), ((span_hashes(raw, at, np.concatenate(end)) + kind) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Machine:
    slots: np.ndarray  # high hash bits -> whether a term has them
    hashes: np.ndarray  # sorted
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, width = len(offsets) - 1, len(self.hashes)
        text, hashed = terms(raw, offsets)
        at = np.flatnonzero(self.slots[hashed >> np.uint32(32 - SLOT_BITS)])
        term = np.minimum(np.searchsorted(self.hashes, hashed[at]), width - 1)
        right = self.hashes[term] == hashed[at]
        pairs = np.unique(text[at[right]] * width + term[right])
        text, term = pairs // width, pairs % width
        value = self.bias + np.bincount(text, self.linear[term], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            value += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return 1 / (1 + np.exp(-np.clip(value, -40, 40)))


def fit(documents: list[np.ndarray], labels: np.ndarray, most_terms: int = 1000, factors: int = 8, rounds: int = 200, penalty: float = 2e-3, seed: int = 5) -> Machine | None:
    """``documents`` are arrays of distinct term hashes; classes weigh alike. Full-batch Adam on the logistic loss."""
    labels = np.asarray(labels, np.float32)
    total = np.array([(labels == 0).sum(), (labels == 1).sum()], np.float64)
    if not total.all():
        return None
    every = np.concatenate(documents)
    owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    hashes, inverse = np.unique(every, return_inverse=True)
    toxic = np.bincount(inverse, labels[owner], len(hashes))
    clean = np.bincount(inverse, minlength=len(hashes)) - toxic
    share1, share0 = toxic / total[1], clean / total[0]
    mean = (toxic + clean) / total.sum()
    chi = (share1 - share0) ** 2 / np.maximum(mean * (1 - mean), 1e-12) * (total[0] * total[1] / total.sum())
    chi[toxic + clean < 3] = 0
    order = np.lexsort((hashes, -chi))[:most_terms]
    chosen = np.sort(order[chi[order] > 10])
    if not len(chosen):
        chosen = np.sort(order[:1])
    columns = np.full(len(hashes), -1)
    columns[chosen] = np.arange(len(chosen))
    hit = columns[inverse] >= 0
    x = np.zeros((len(documents), len(chosen)), np.float32)
    x[owner[hit], columns[inverse[hit]]] = 1
    rng = np.random.default_rng(seed)
    state = [np.zeros(1, np.float32), np.zeros(len(chosen), np.float32), rng.normal(0, 0.02, (len(chosen), factors)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    weight = np.where(labels == 1, 0.5 / total[1], 0.5 / total[0]).astype(np.float32)
    for step in range(1, rounds + 1):
        bias, linear, v = state
        inner = x @ v
        value = bias + x @ linear + 0.5 * (inner**2 - x @ (v * v)).sum(axis=1)
        error = weight * (1 / (1 + np.exp(-np.clip(value, -40, 40))) - labels)
        pulled = x.T @ error
        slopes = [np.array([error.sum()]), pulled + penalty * linear / len(linear), x.T @ (error[:, None] * inner) - v * pulled[:, None] + penalty * v / len(linear)]
        for k, g in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            state[k] = (state[k] - 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    slots = np.zeros(1 << SLOT_BITS, bool)
    slots[hashes[chosen] >> np.uint32(32 - SLOT_BITS)] = True
    return Machine(slots, hashes[chosen], float(state[0][0]), state[1].astype(np.float64), state[2].astype(np.float64))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean()
    seen: set[int] = set()
    for batch in batches:
        for part in slices(first_of_each(batch, "h", seen), "text"):
            raw, offsets = flatten(part.column("text"))
            text, hashed = terms(raw, offsets)
            pairs = np.unique((text.astype(np.uint64) << np.uint64(32)) | hashed)
            cuts = np.searchsorted(pairs >> np.uint64(32), np.arange(1, part.num_rows).astype(np.uint64))
            held = [p.tobytes() for p in np.split((pairs & np.uint64(0xFFFFFFFF)).astype("<u4"), cuts)]
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("toxic"), pa.array(held, pa.binary())], ["h", "toxic", "terms"])
    trim()


def train(docs: DataFrame, labels: DataFrame, positives: int = 2000, negatives: int = 4000) -> Machine | None:
    """Fit on about ``positives`` + ``negatives`` labelled documents that are not held out.

    Labels of one document are merged before any is chosen. The chosen ones are few whatever the
    tables' sizes, so they are broadcast to the documents. Where one id has several texts, the rows
    found are thinned to the same numbers once more, by a hash of id and text.
    """
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
    chosen = per_class(known.where("toxic = 1"), "toxic", "doc_id", positives).unionByName(per_class(known.where("toxic = 0"), "toxic", "doc_id", negatives))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "toxic", "text")
    rows = per_class(rows.where("toxic = 1"), "toxic", "h", positives).unionByName(per_class(rows.where("toxic = 0"), "toxic", "h", negatives))
    got = sorted(once(rows.mapInArrow(_terms, "h long, toxic int, terms binary"), "h").collect(), key=lambda r: (r["h"], r["toxic"], bytes(r["terms"])))
    return fit([np.frombuffer(bytes(r["terms"]), "<u4") for r in got], np.array([r["toxic"] for r in got])) if got else None


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        machine: Machine | None = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                raw, offsets = flatten(part.column("text"))
                values = machine.scores(raw, offsets) if machine is not None else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])
        trim()

    return score


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.select("doc_id", "text").mapInArrow(_scorer(shared), "doc_id long, score double")


def op5_toxicity(spark, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Toxicity of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
