"""A stored term index: for each term the chunks that hold it, with their weights, and a greatest weight a block.

Chunks are numbered in the order of equal scores (file, line, id), so a smaller number wins a tie. A block is
65,536 numbers; the numbers of a term in a block are coded as differences, of one to three bytes, beside a
byte of weight each. Rows lie in buckets of terms, which are Parquet partitions, and by term inside
these, so a search opens the buckets of its terms only and skips the row groups without them. A term that
every chunk holds is as many rows as there are blocks; no task gathers it.

The index is built without a row for each term of each chunk. The chunks are dealt into ranges of their
order and staged once, so a task meets neighbouring numbers; it gathers PAIRS terms and codes them where
they lie, and only coded pieces are shuffled, in which the pieces of a term and block are put together.

A search first reads the greatest weights without the numbers. Their sum over a question's terms bounds
what a block can give; the block with the largest bound is scored first and gives the score that a
question's k-th best row has at least. Blocks whose bound is below that are not scored. Scores are sums of
whole numbers, so nothing is rounded, and the result equals ``rank.lexical``.

Defined cases: chunks with a null id are left out; ids should be unique; null fields have no terms;
questions without terms find nothing; blocks of questions of BLOCK rows and TEXT_BYTES of text at most
run one after another; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import text as tx
from siltstone.operators.rank import FIELD_WEIGHTS, PLACE, canonical, top_k
from siltstone.runtime import partitions_for, session_partitions, small_batches, stage_table

#: Numbers of a block (two to the power of), buckets of terms, questions and bytes of their texts at a time.
BITS, BUCKETS, BLOCK, TEXT_BYTES = 16, 64, 1024, 16 << 20
#: Terms of chunks that a task codes at a time, and blocks (two to the power of) of a bucket that are written together.
PAIRS, TOGETHER = 1 << 22, 2
ROWS = "term string, block long, n int, top int, numbers binary, weights binary"


def _bytes_of(step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of seven bits a byte, the last byte of each with its high bit clear, and where each ends."""
    size = 1 + (step >= 1 << 7) + (step >= 1 << 14)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(3):
        has = size > k
        out[(ends - size)[has] + k] = ((step[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, ends


def _steps_of(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.append(0, last[:-1] + 1)[: len(last)]
    step = np.zeros(len(last), np.int64)
    for k in range(3):
        at = first + k
        has = at <= last
        step[has] += (raw[at[has]].astype(np.int64) & 127) << (7 * k)
    return step


def pack(numbers: np.ndarray) -> bytes:
    """Rising numbers under 2**BITS as coded differences."""
    return _bytes_of(np.diff(numbers, prepend=0).astype(np.int64))[0].tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_steps_of(np.frombuffer(data, np.uint8)))


def _pieces(weights: list[int]):
    """Codes rows (number, a list of terms for each weight), PAIRS terms at a time: a row a term and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs = [], 0
        for batch in batches:
            number = batch.column(0).to_numpy()
            for n, weight in enumerate(weights):
                column = batch.column(1 + n)
                terms = column.flatten()
                if len(terms):
                    held.append((terms.dictionary_encode(), np.repeat(number, pc.list_value_length(column).to_numpy(zero_copy_only=False)), np.full(len(terms), weight, np.uint8)))
                    pairs += len(terms)
            if pairs >= PAIRS:
                yield from _coded_terms(held)
                held, pairs = [], 0
        if held:
            yield from _coded_terms(held)

    return run


def _coded_terms(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    terms = pa.chunked_array([t for t, _, _ in held]).unify_dictionaries()
    code = np.concatenate([c.indices.to_numpy() for c in terms.chunks])
    rows = _coded(terms.chunks[-1].dictionary, code, np.concatenate([n for _, n, _ in held]), np.concatenate([w for _, _, w in held]))
    for low in range(0, rows.num_rows, 1 << 14):
        yield rows.slice(low, 1 << 14)


def _coded(terms: pa.Array, code: np.ndarray, number: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """Rows by term and block of (place of the term, number, weight) in any order; the weights of a number that comes for several fields are summed."""
    order = np.lexsort((number, code)) if number.max() >> 40 or len(terms) >> 22 else np.argsort((code.astype(np.int64) << 40) | number)
    code, number, weight = code[order], number[order], weight[order]
    at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (number[1:] != number[:-1])))
    weight, code, number = np.add.reduceat(weight, at, dtype=np.int64).astype(np.uint8), code[at], number[at]
    block, inside = number >> BITS, number & ((1 << BITS) - 1)
    cuts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])))
    step = np.diff(inside, prepend=0)
    step[cuts] = inside[cuts]
    data, ends = _bytes_of(step)
    upto = np.append(cuts, len(number))
    spans = [np.append(0, ends)[upto], upto]
    columns = [
        terms.take(pa.array(code[cuts])), pa.array(block[cuts]), pa.array(np.diff(upto).astype(np.int32)), pa.array(np.maximum.reduceat(weight, cuts).astype(np.int32)),
        *[pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(values)]) for at, values in zip(spans, (data, weight), strict=True)],
    ]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "top", "numbers", "weights"])


def _raw(column: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column, one behind the other."""
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]


def _joined(rows: pa.RecordBatch, group: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """The pieces of each term and block as one row; ``group`` numbers them and ``first`` is where each begins."""
    n = rows.column("n").to_numpy().astype(np.int64)
    step, begins = _steps_of(_raw(rows.column("numbers"))), np.cumsum(n) - n
    inside = np.cumsum(step)
    inside -= np.repeat(inside[begins] - step[begins], n)
    return _coded(rows.column("term").take(pa.array(first)), np.repeat(group, n), (np.repeat(rows.column("block").to_numpy(), n) << BITS) + inside, _raw(rows.column("weights")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pieces in the order of terms and blocks, put together; what a batch cuts off is carried on."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
        if not table:
            continue
        whole = table[0]
        term, block = whole.column("term").dictionary_encode().indices.to_numpy(), whole.column("block").to_numpy()
        new = np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))
        first = np.flatnonzero(new)
        end = int(first[-1])
        held = whole.slice(end)
        if end:
            yield _joined(whole.slice(0, end), (np.cumsum(new) - 1)[:end], first[:-1])
    if held is not None and held.num_rows:
        yield _joined(held, np.zeros(held.num_rows, np.int64), np.zeros(1, np.int64))


class TermIndex:
    """An index in a folder that all tasks reach: ``chunks`` (number, id, file, line), ``postings`` by bucket, and ``meta``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.buckets = spark.read.parquet(f"{folder}/meta").first()["buckets"]

    @staticmethod
    def build(chunks: DataFrame, folder: str, weights: dict[str, int] | None = None, buckets: int = BUCKETS) -> TermIndex:
        """Index the fields of ``chunks`` (chunk_id, fields, optionally source_file and start_line) that have a weight."""
        spark = chunks.sparkSession
        small_batches(spark)
        weights = {f: w for f, w in (weights or FIELD_WEIGHTS).items() if f in chunks.columns}
        keys = [c for c in PLACE if c in chunks.columns]
        chunks = chunks.where(F.col("chunk_id").isNotNull())
        # Ranges of the order of ties; the number of a row is its place in its range and the rows of the ranges before.
        ranged = chunks.select(*dict.fromkeys([*keys, *weights])).repartitionByRange(partitions_for(chunks), *keys).sortWithinPartitions(*keys)
        staged = stage_table(ranged.withColumn("place", F.monotonically_increasing_id()), "ranged").withColumn("range", F.shiftright("place", 33))
        starts, before = [], 0
        for r in staged.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():
            starts.append((r["range"], before - (r["range"] << 33)))
            before += r["n"]
        numbers = staged.join(F.broadcast(spark.createDataFrame(starts, "range long, start long")), "range").withColumn("number", F.col("place") + F.col("start"))
        numbers.select(*keys, "number").write.parquet(f"{folder}/chunks")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/meta")
        said = numbers.select("number", *[tx.word_set(F.coalesce(f, F.lit(""))).alias(f"_terms_{n}") for n, f in enumerate(weights)])
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        # A frequent term is dealt over tasks by its blocks.
        dealt = said.mapInArrow(_pieces(list(weights.values())), ROWS).repartition(partitions_for(chunks), bucket, F.shiftright("block", TOGETHER))
        coded = dealt.sortWithinPartitions(bucket, "term", "block").mapInArrow(_blocks, ROWS).withColumn("bucket", bucket)
        coded.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{folder}/postings")
        return TermIndex(spark, folder)

    def rows(self, terms: list[str], buckets: list[int]) -> DataFrame:
        """The postings of some terms, of their buckets only."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        found = self.spark.read.schema(f"{ROWS}, bucket int").parquet(f"{self.folder}/postings").where(F.col("bucket").isin(buckets))
        return (found.where(F.col("term").isin(terms)) if len(terms) <= 256 else found).join(F.broadcast(asked), "term", "left_semi")

    def _best(self, rows: DataFrame, asked: dict[str, list[int]], floors: np.ndarray, k: int, only: dict[int, list[int]] | None = None) -> DataFrame:
        """(question int, number, score): the best k of each question in each block, where the block's bound reaches the question's floor."""
        shared = self.spark.sparkContext.broadcast((asked, floors, only))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owners, floor, chosen = shared.value

            def done(block: int, held: list[tuple]) -> pa.RecordBatch | None:
                bound, mine = np.zeros(len(floor)), {}
                for at, (term, top, _, _) in enumerate(held):
                    for q in owners[term]:
                        bound[q] += top
                        mine.setdefault(q, []).append(at)
                wanted = [q for q in mine if bound[q] >= floor[q] and (chosen is None or q in chosen.get(block, ()))]
                if not wanted:
                    return None
                used = sorted({at for q in wanted for at in mine[q]})
                open_ = {at: (unpack(held[at][2]), np.frombuffer(held[at][3], np.uint8)) for at in used}
                out = [[], [], []]
                for q in wanted:
                    score = np.zeros(1 << BITS, np.int64)
                    for at in mine[q]:
                        number, weight = open_[at]
                        score[number] += weight
                    hit = np.flatnonzero(score)
                    if len(hit) > k:
                        bar = np.partition(score[hit], len(hit) - k)[len(hit) - k]
                        hit = hit[score[hit] >= bar]
                    hit = hit[np.lexsort((hit, -score[hit]))][:k]
                    for column, value in zip(out, (np.full(len(hit), q, np.int32), hit + (block << BITS), score[hit].astype(np.float64)), strict=True):
                        column.append(value)
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["question", "number", "score"])

            block, held = None, []
            for batch in batches:
                for b, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "term", "top", "numbers", "weights")), strict=True):
                    if b != block and held:
                        if (got := done(block, held)) is not None:
                            yield got
                        held = []
                    block = b
                    held.append(tuple(row))
            if held and (got := done(block, held)) is not None:
                yield got

        dealt = rows.select("block", "term", "top", "numbers", "weights").repartition(session_partitions(self.spark), "block").sortWithinPartitions("block")
        return dealt.mapInArrow(run, "question int, number long, score double")

    def search(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """(question_id, rank, chunk_id, source_file, start_line, score) of the best chunks of each question (question_id, text)."""
        spark = self.spark
        small_batches(spark)
        chunks = spark.read.parquet(f"{self.folder}/chunks")
        keys = [c for c in PLACE if c in chunks.columns]
        schema = T.StructType([questions.schema["question_id"], *[chunks.schema[c] for c in keys], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        size = questions.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
        blocks = max(-(-size["n"] // BLOCK), -(-int(size["b"] or 0) // TEXT_BYTES))
        found = None
        for b in range(blocks):
            part = self._search_block(questions.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b), chunks, keys, k)
            if part is not None:
                found = part if found is None else found.unionAll(part)
        return spark.createDataFrame([], schema) if found is None else found

    def _search_block(self, questions: DataFrame, chunks: DataFrame, keys: list[str], k: int) -> DataFrame | None:
        spark = self.spark
        got = questions.select("question_id", tx.word_set(F.col("text")).alias("terms")).collect()
        asked: dict[str, list[int]] = {}
        for q, r in enumerate(got):
            for term in r["terms"] or []:
                asked.setdefault(term, []).append(q)
        if not asked:
            return None
        terms = sorted(asked)
        named = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket")).distinct()
        rows = self.rows(terms, sorted(r["bucket"] for r in named.collect()))
        # The block with the largest bound for each question, from the greatest weights alone.
        owners = spark.createDataFrame([(t, q) for t, qs in asked.items() for q in qs], "term string, question int")
        bounds = rows.select("term", "block", "top").join(F.broadcast(owners), "term").groupBy("question", "block").agg(F.sum("top").alias("bound"))
        first = bounds.groupBy("question").agg(F.max(F.struct("bound", (-F.col("block")).alias("block"))).alias("m")).select("question", (-F.col("m.block")).alias("block")).collect()
        only: dict[int, list[int]] = {}
        for r in first:
            only.setdefault(r["block"], []).append(r["question"])
        floors = np.zeros(len(got))
        if bounds.agg(F.count_distinct("block")).first()[0] > 1:
            opened = rows.where(F.col("block").isin(list(only)))
            kth = top_k(self._best(opened, asked, floors, k, only), ["question"], [F.desc("score"), F.asc("number")], k).where(F.col("rank") == k)
            for r in kth.select("question", "score").collect():
                floors[r["question"]] = r["score"]
        best = top_k(self._best(rows, asked, floors, k), ["question"], [F.desc("score"), F.asc("number")], k)
        names = spark.createDataFrame([(q, r["question_id"]) for q, r in enumerate(got)], T.StructType([T.StructField("question", T.IntegerType()), questions.schema["question_id"]]))
        full = stage_table(best, "matched").join(F.broadcast(names), "question").join(chunks, "number")
        return full.select("question_id", *keys, "score", "rank")
