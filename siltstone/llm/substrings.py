"""Substring dedup: passages that a document with a smaller id holds too are removed.

Every window of ``width`` consecutive words gets a Rabin-Karp hash (a polynomial of word hashes);
the hashes of all windows are counted in Spark through ``exchange``. Documents are grouped by
ranges of their id, so a window that an earlier range has, or an earlier document of its own group,
also starts in a document with a smaller id. The words of such windows merge into maximal removal
intervals. Windows are judged on the input, not on what is left of it.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Defined cases: null and empty texts have no words;
texts of fewer than ``width`` words have no window; rows with the same id do not remove each
other's words; rows with a null id neither lose words nor cost others theirs; extra columns are
kept by ``dedup_texts`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.exchange import assignment, deal, exchange, group_count, range_points
from siltstone.llm.textbytes import flatten, lean, slices, span_hashes, trim, window_hashes, word_spans
from siltstone.runtime import small_batches

WIDTH = 13
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
SALT = 0x51


def _windows(width: int):
    def run(table: pa.Table, twice: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        first, second, owner, row = [], [], [], 0
        for batch in table.to_batches():
            for part in slices(batch, "text"):
                raw, offsets = flatten(part.column("text"))
                starts, ends, text = word_spans(raw, offsets)
                words = span_hashes(raw, starts, ends)
                n = max(0, len(words) - width + 1)
                whole = np.flatnonzero(text[:n] == text[width - 1 :]) if n else np.empty(0, np.int64)
                first.append(window_hashes(words, width)[whole])
                if twice:
                    second.append(window_hashes(span_hashes(raw, starts, ends, SALT), width, SALT)[whole])
                owner.append((text[whole] + row).astype(np.int32))
                row += part.num_rows
        none = np.empty(0, np.uint64)
        return np.concatenate([none, *first]), np.concatenate([none, *second]) if twice else None, np.concatenate([none.astype(np.int32), *owner])

    return run


def _removed(table: pa.Table, distinct, owner: np.ndarray, later: np.ndarray) -> np.ndarray:
    """For each window, in order, whether it is removed."""
    ids = table.column("doc_id").to_numpy()
    own = ids[owner]
    return (later[distinct.inverse] > 0) | (own > distinct.least(own)[distinct.inverse]) if len(own) else np.empty(0, bool)


def _covered(part: pa.RecordBatch, removed: np.ndarray, width: int) -> tuple:
    """Words of a slice and which of them are covered; ``removed`` starts at its first window; also the windows used."""
    raw, offsets = flatten(part.column("text"))
    starts, ends, text = word_spans(raw, offsets)
    n = max(0, len(starts) - width + 1)
    whole = np.flatnonzero(text[:n] == text[width - 1 :]) if n else np.empty(0, np.int64)
    at = whole[removed[: len(whole)]]
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return raw, offsets, starts, ends, text, np.cumsum(step)[:-1] > 0, len(whole)


def _digests(part: pa.RecordBatch, covered: tuple) -> pa.RecordBatch:
    raw, offsets, starts, ends, text, gone, _ = covered
    rows = part.num_rows
    n, lost = np.bincount(text, minlength=rows), np.bincount(text, gone, rows).astype(np.int64)
    a, b, t = starts[~gone], ends[~gone], text[~gone]
    size = b - a + 1
    place = np.cumsum(size) - size
    source = np.repeat(a - place, size) + np.arange(int(size.sum()))
    out = np.append(raw, np.uint8(32))[np.minimum(source, len(raw))]
    out[place + size - 1] = 32
    cuts = np.concatenate([place, [len(out)]])[np.searchsorted(t, np.arange(rows + 1))]
    sha = [hashlib.sha256(out[i : max(i, j - 1)].tobytes()).hexdigest() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(part: pa.RecordBatch, covered: tuple) -> pa.RecordBatch:
    """The rows with each removal interval cut out, from its first word to the next kept word."""
    raw, offsets, starts, ends, text, gone, _ = covered
    keep = np.ones(len(raw) + 1, np.int64)
    step = np.zeros(len(raw) + 2, np.int64)
    stop = np.append(starts[1:], len(raw)) if len(starts) else starts
    stop = np.minimum(stop, offsets[text + 1]) if len(starts) else stop
    np.add.at(step, starts[gone], 1)
    np.add.at(step, stop[gone], -1)
    keep = np.cumsum(step)[: len(raw)] == 0
    ends_kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    data = raw[keep].tobytes()
    touched = np.bincount(text, gone, part.num_rows) > 0
    column = part.column("text")
    texts = [data[i:j].decode().rstrip(" \t\n\v\f\r") if t else None for i, j, t in zip(ends_kept[:-1].tolist(), ends_kept[1:].tolist(), touched.tolist(), strict=True)]
    new = pa.array([x if t else column[k].as_py() for k, (x, t) in enumerate(zip(texts, touched.tolist(), strict=True))], column.type)
    return part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), new)


def _finish(width: int, make):
    def run(table: pa.Table, distinct, owner: np.ndarray, later: np.ndarray, _) -> pa.Table:
        removed, at, out = _removed(table, distinct, owner, later), 0, []
        for batch in table.to_batches():
            for part in slices(batch, "text"):
                covered = _covered(part, removed[at:], width)
                at += covered[-1]
                out.append(make(part, covered))
        return pa.Table.from_batches(out)

    return run


def _alone(width: int, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "text"):
                yield make(part, _covered(part, np.zeros(len(flatten(part.column("text"))[0]) + 1, bool), width))
        trim()

    return run


def _dedup(docs: DataFrame, width: int, make, schema) -> DataFrame:
    small_batches(docs.sparkSession)
    known = docs.where(F.col("doc_id").isNotNull())
    size = int(known.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)
    groups = group_count(size)
    assign = assignment(range_points(known, groups))
    # A word and the space behind it have about six bytes; it only sets the number of buckets.
    done = exchange(deal(known, assign, groups), _windows(width), lambda d, owner: np.zeros(len(d.hashes), np.uint8), _finish(width, make), schema, "later", size // 6)
    return done.unionByName(docs.where(F.col("doc_id").isNull()).mapInArrow(_alone(width, make), schema))


def dedup_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of (doc_id, text)."""
    return _dedup(docs.select("doc_id", "text"), width, _digests, DIGEST)


def dedup_texts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of ``text``."""
    return _dedup(docs, width, _texts, docs.schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Substring dedup of ``documents`` with windows of 13 words."""
    return dedup_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') END AS w FROM documents),
s AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM t WHERE len(w) >= 13),
x AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM s),
m AS (
  SELECT k, min(doc_id) AS first FROM x GROUP BY k HAVING min(doc_id) < max(doc_id)),
r AS (
  SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + 13)) AS p FROM x JOIN m ON x.k = m.k WHERE m.first < x.doc_id),
g AS (
  SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(t.w) + 1), lambda p: g.gone IS NULL OR NOT list_contains(g.gone, p)), lambda p: t.w[p]), ' '), '')) AS kept_sha256
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""
