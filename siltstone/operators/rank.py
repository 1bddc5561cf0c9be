"""Rankers and rank fusion. Rankings are rows (question_id, method, rank, chunk_id, score).

Every order is total: score descending, then source file, start line and chunk id where the chunks
have them, else the chunk id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.functions import text as tx
from siltstone.runtime import estimated_bytes, spread, stage_table

#: Fixed weights of the lexical fields, and the constant of reciprocal rank fusion.
FIELD_WEIGHTS = {"qualified_name": 3, "source_file": 2, "code": 1, "embedding_text": 1}
RRF_K = 60
QUERY_BLOCK = 4096
BROADCAST_BYTES = 64 << 20


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their 1-based place; ``order`` must be total."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def canonical(columns: list[str]) -> list[Column]:
    return [F.desc("score"), *[F.asc(c) for c in ("source_file", "start_line", "chunk_id") if c in columns]]


def lexical(questions: DataFrame, chunks: DataFrame, k: int = 10, weights: dict[str, int] | None = None) -> DataFrame:
    """Weight of every field times the number of distinct question terms in it; only positive scores.

    ``questions``: (question_id, text); ``chunks``: chunk_id (unique), the weighted fields, optionally
    source_file, start_line. Terms are sets, so there is no term or document frequency. Chunks are scored
    where they lie: their terms are looked up in those of a block of QUERY_BLOCK questions, and a task
    sends on its best k for each question, so the shuffle holds neither terms nor all pairs that match.
    Several blocks run one after another, each staged before the next is fetched.
    """
    spark = chunks.sparkSession
    weights = {f: w for f, w in (weights or FIELD_WEIGHTS).items() if f in chunks.columns}
    keys = [c for c in ("chunk_id", "source_file", "start_line") if c in chunks.columns]
    terms = spread(chunks.select(*dict.fromkeys([*keys, *weights]))).select(*keys, *[tx.word_set(F.col(f)).alias(f"_terms_{n}") for n, f in enumerate(weights)])
    schema = T.StructType([questions.schema["question_id"], *[chunks.schema[c] for c in keys], T.StructField("score", T.DoubleType())])
    blocks = max(1, -(-questions.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        asked = questions.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b).select("question_id", tx.word_set(F.col("text")).alias("terms")).collect()
        part = terms.mapInArrow(_term_scores([(r["question_id"], r["terms"] or []) for r in asked], list(weights.values()), keys, k, schema), schema)
        if blocks > 1:
            part = stage_table(top_k(part, ["question_id"], canonical(keys), k).drop("rank"), "matched")
        found = part if found is None else found.unionAll(part)
    return top_k(found, ["question_id"], canonical(keys), k)


#: Cells of a table of scores (chunks x questions) at a time, and matches of terms that are counted at a time.
CELLS, MATCHES = 1 << 20, 1 << 20


def _term_scores(asked: list[tuple], weights: list[int], keys: list[str], k: int, schema: T.StructType):
    """Scores batches of (keys..., a list of terms for each weight) and keeps the best k of each question."""
    ids = list(dict.fromkeys(q for q, _ in asked))
    place = {q: n for n, q in enumerate(ids)}
    by_term: dict[str, list[int]] = {}
    for q, words in asked:
        for word in words:
            by_term.setdefault(word, []).append(place[q])
    vocabulary = list(by_term)
    counts = np.array([len(v) for v in by_term.values()], np.int64)
    first, owners = np.cumsum(counts) - counts, np.array([n for v in by_term.values() for n in v], np.int64)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, arrow = pa.array(vocabulary, pa.string()), to_arrow_schema(schema)
        questions = pa.array(ids, arrow.field(0).type)
        step = max(1, CELLS // max(1, len(ids)))
        floor = np.full(len(ids), -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows if ids else 0, step):
                part = batch.slice(start, step)
                rows = part.num_rows
                score = np.zeros(rows * len(ids))
                for n, weight in enumerate(weights):
                    column = part.column(len(keys) + n)
                    values = column.flatten()
                    row = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
                    term = pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy(zero_copy_only=False)
                    hit = np.flatnonzero(term >= 0)
                    term, row = term[hit], row[hit]
                    upto = np.cumsum(counts[term])
                    low = 0
                    while low < len(term):
                        # A frequent term has many owners, so their number is bounded and not that of the terms.
                        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + MATCHES, side="right")))
                        size, from_, to = counts[term[low:high]], row[low] * len(ids), (row[high - 1] + 1) * len(ids)
                        at = np.repeat(first[term[low:high]] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                        score[from_:to] += weight * np.bincount(np.repeat(row[low:high], size) * len(ids) - from_ + owners[at], minlength=to - from_)
                        low = high
                score = score.reshape(rows, len(ids))
                order = tie_order(part, keys)
                # Questions x chunks, in the total order of equal scores.
                question, chunk, value = best_of(np.ascontiguousarray(score[order].T), k, 0, floor)
                picked = pa.array(order[chunk])
                yield pa.RecordBatch.from_arrays([questions.take(pa.array(question)), *[part.column(i).take(picked) for i in range(len(keys))], pa.array(value)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(scored(batches), k)

    return run


def small(rows: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows come from files under the broadcast bound, with room for what an explode adds."""
    size = estimated_bytes(rows)
    return size is not None and size <= most


#: What orders chunks of equal scores, in turn.
PLACE = ("source_file", "start_line", "chunk_id")


def tie_order(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Places of a batch's rows in the order of equal scores."""
    table = pa.table({c: batch.column(c) for c in keys})
    return pc.sort_indices(table, sort_keys=[(c, "ascending") for c in PLACE if c in keys], null_placement="at_start").to_numpy()


def best_of(score: np.ndarray, k: int, least: float = -np.inf, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, place, score) of the best ``k`` columns of each row above ``least``, earlier columns first among equals.

    ``floor`` holds for each row the greatest k-th score met in the tables before; scores under it are left out and it is raised.
    """
    n = score.shape[1]
    bar = np.partition(score, n - k, axis=1)[:, n - k, None] if n > k else np.full((len(score), 1), -np.inf)
    if floor is not None:
        np.fmax(floor, bar[:, 0], out=floor)
        bar = floor[:, None]
    question, place = np.nonzero((score >= bar) & (score > least))
    value = score[question, place]
    best = np.lexsort((place, -value, question))
    question, place, value = question[best], place[best], value[best]
    good = np.arange(len(question)) - np.searchsorted(question, question) < k
    return question[good], place[good], value[good]


#: Rows that a task gathers before it leaves out those that cannot be among the best.
GATHERED = 1 << 17


def trimmed(rows: pa.Table, k: int) -> pa.Table:
    """The best ``k`` rows of each question, in the order of ranks."""
    keys = [("question_id", "ascending"), ("score", "descending"), *[(c, "ascending") for c in PLACE if c in rows.column_names]]
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
    code = rows.column("question_id").combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    return rows.filter(pa.array(place < k))


def gathered(parts: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` rows of each question over all batches of a task, so that what is sent on follows the tasks and not the batches."""
    held, n, most = [], 0, GATHERED
    for part in parts:
        if part.num_rows:
            held.append(part)
            n += part.num_rows
        if n > most:
            best = trimmed(pa.Table.from_batches(held), k)
            held, n = best.to_batches(), best.num_rows
            most = max(GATHERED, 2 * n)
    if held:
        yield from trimmed(pa.Table.from_batches(held), k).to_batches(max_chunksize=1 << 16)


def scores_of(block: np.ndarray, lengths: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Scores (queries x rows), rounded to 9 digits."""
    products = block @ rows.T
    own = np.sqrt((rows * rows).sum(axis=1))
    if metric == "cosine":
        bottom = lengths[:, None] * own[None, :]
        values = np.divide(products, bottom, out=np.zeros_like(products), where=bottom > 0)
    elif metric == "dot":
        values = products
    else:
        values = -np.sqrt(np.maximum(0, lengths[:, None] ** 2 - 2 * products + own[None, :] ** 2))
    return np.round(values, 9) + 0.0


def _block_scores(block_ids: list, block: np.ndarray, metric: str, k: int, keys: list[str], schema: T.StructType):
    lengths = np.sqrt((block * block).sum(axis=1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        asked = pa.array(block_ids, arrow.field(0).type)
        step, floor = max(1, min(2048, CELLS // len(block))), np.full(len(block), -np.inf)
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                order = tie_order(batch, keys)
                rows = np.asarray(batch.column("vector").flatten(), np.float64).reshape(batch.num_rows, -1)[order]
                # The best k + 1 of this batch for each query, as itself may be among them.
                question, place, value = best_of(scores_of(block, lengths, rows, metric), k + 1, floor=floor)
                picked = pa.array(order[place])
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(question)), *[batch.column(c).take(picked) for c in keys], pa.array(value)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(scored(batches), k + 1)

    return run


def semantic(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", exclude_self: bool = True) -> DataFrame:
    """Exact nearest vectors by ``cosine``, ``dot`` or ``l2``, scores rounded to 9 digits.

    ``queries``: (chunk_id, vector); ``vectors``: (chunk_id, vector) and optionally source_file and
    start_line, which order equal scores. The queries are taken in blocks of QUERY_BLOCK, each multiplied
    with the vectors batch by batch where these lie; a task sends on its best k for each query. Several
    blocks run one after another, each with its best rows staged before the next is fetched, so memory and
    broadcast are bounded by the block whatever the number of queries.
    """
    spark = vectors.sparkSession
    keys = [c for c in ("chunk_id", "source_file", "start_line") if c in vectors.columns]
    asked_as = T.StructField("question_id", queries.schema["chunk_id"].dataType)
    schema = T.StructType([asked_as, *[T.StructField(c, vectors.schema[c].dataType) for c in keys], T.StructField("score", T.DoubleType())])
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)) == b).select("chunk_id", "vector").orderBy("chunk_id").collect()
        if not rows:
            continue
        block = np.array([list(r["vector"]) for r in rows], np.float64)
        part = vectors.select(*keys, "vector").mapInArrow(_block_scores([r["chunk_id"] for r in rows], block, metric, k, keys, schema), schema)
        if blocks > 1:
            part = stage_table(top_k(part.where("question_id <> chunk_id") if exclude_self else part, ["question_id"], canonical(keys), k).drop("rank"), "nearest")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    if exclude_self:
        found = found.where("question_id <> chunk_id")
    return top_k(found, ["question_id"], canonical(keys), k)


def fuse(first: DataFrame, second: DataFrame, k: int = 10, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal rank fusion, w / (60 + rank), the first list's part added first.

    Equal sums are common; they are ordered by source_file, start_line and chunk_id as far as both lists have them.
    """
    keys = [c for c in ("source_file", "start_line") if c in first.columns and c in second.columns]
    parts = [r.select("question_id", "chunk_id", *keys, *[(F.lit(w) / (RRF_K + F.col("rank")) if side == mine else F.lit(None).cast("double")).alias(side) for side in ("a", "b")]) for r, mine, w in ((first, "a", weights[0]), (second, "b", weights[1]))]
    both = parts[0].unionAll(parts[1]).groupBy("question_id", "chunk_id").agg(F.max("a").alias("a"), F.max("b").alias("b"), *[F.max(c).alias(c) for c in keys])
    scored = both.select("question_id", "chunk_id", *keys, F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 12).alias("score"))
    return top_k(scored, ["question_id"], canonical(["chunk_id", *keys]), k)


def merge_lists(tagged: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Keep the first row of each chunk in ``order`` and the first ``k`` chunks of each question."""
    first = tagged.withColumn("turn", F.row_number().over(Window.partitionBy("question_id", "chunk_id").orderBy(*order))).where("turn = 1").drop("turn")
    return top_k(first, ["question_id"], order, k, "place")


def interleave(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """Alternate the lists, the first one's row before the second's at each rank; repeats are dropped."""
    tagged = first.select("question_id", "chunk_id", "rank", F.lit(0).alias("side")).unionAll(second.select("question_id", "chunk_id", "rank", F.lit(1).alias("side")))
    return merge_lists(tagged, [F.asc("rank"), F.asc("side"), F.asc("chunk_id")], k)


def head_then_rest(first: DataFrame, second: DataFrame, head: int, k: int = 10) -> DataFrame:
    """The first ``head`` rows of the first list, then the second's that are not among them."""
    tagged = first.where(F.col("rank") <= head).select("question_id", "chunk_id", "rank", F.lit(0).alias("side")).unionAll(second.select("question_id", "chunk_id", "rank", F.lit(1).alias("side")))
    return merge_lists(tagged, [F.asc("side"), F.asc("rank"), F.asc("chunk_id")], k)


def round_robin(pieces: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """One piece of each original rank a turn: order by (turn, rank)."""
    turns = pieces.withColumn("turn", F.row_number().over(Window.partitionBy(group, "rank").orderBy(*order)))
    return turns.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy("turn", "rank")))


def overlap_rerank(ranking: DataFrame, overlap: Column, strength: float, depth: int = 10) -> DataFrame:
    """strength * overlap - 0.001 * rank over the first ``depth`` ranks."""
    scored = ranking.where(F.col("rank") <= depth).withColumn("rescored", F.round(F.lit(strength) * overlap - F.lit(0.001) * F.col("rank"), 6))
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("rescored"), F.asc("rank"))))


def hydrate(hits: DataFrame, chunks: DataFrame, strict: bool = False) -> DataFrame:
    """Attach chunk attributes; a hit without a chunk is left out, or if strict fails the query.

    ``missing_hits`` lists such hits.
    """
    if not strict:
        return hits.join(chunks, "chunk_id")
    joined = hits.join(chunks.withColumn("_known", F.lit(True)), "chunk_id", "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("a hit has no chunk: "), F.col("chunk_id").cast("string")))).otherwise(F.col("chunk_id"))
    return joined.withColumn("chunk_id", checked).drop("_known")


def missing_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    return hits.join(chunks, "chunk_id", "left_anti")
