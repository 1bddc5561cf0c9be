"""N-gram Jaccard self-join by vertical partitioning, and the classes that its links form.

A document's set are the distinct shingles of five words (A-Z in lower case); two documents link
when 100 |x & y| >= 75 |x | y|. The steps:

1. ``exchange`` counts in how many documents each shingle is and gives the shared ones ids in one
   global order. A document with over a quarter of shingles of its own cannot link and is done.
2. Equal sets fall into one class, which its smallest document stands for from here on.
3. A document's prefix are its floor(n / 4) + 1 rarest shingles. Documents that link share a prefix
   shingle; of the shingles that just the same documents have in their prefix only the first is
   kept. What is left are the candidate lists.
4. Clusters are found first: a document joins a random part of at most about BLOCK documents of
   each of two of its lists; there the global order is cut into fragments, the partial overlaps of
   the part's documents are counted in each fragment and summed, and links found. Components of
   these links are formed.
5. What may still link, documents of one list in different components, is then compared pair by
   pair: sizes and prefix places must allow the overlap, then partial overlaps are counted per
   fragment and summed per pair. Pairs within a component cannot change it and are left out, so a
   large group of near copies costs its size, not its square. Lists are cut by length, and of a pair
   at least one document, the shorter one, must be open: its place in the list leaves room for a link
   with a document of its own size. So a list that many documents share behind shingles of their own
   costs its open documents times its length.

Nothing is capped: every pair that could join two components is counted exactly. Joins on a shingle
or a node have staged tables on both sides, so that a frequent one can be dealt out. Defined cases:
null and empty texts have an empty set and link with nothing; fewer than five words are one shingle;
very long texts are used whole; rows with one id and different texts are judged each by its own text;
a null id has a null component; extra columns are not looked at. Ids are below 2**62.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import connected
from siltstone.llm.exchange import Distinct, assignment, deal, exchange, group_count, range_points, squeeze, unsqueeze
from siltstone.llm.textbytes import flatten, hash_order, lower_ascii, mix, slices, span_hashes, window_hashes, word_spans
from siltstone.runtime import small_batches, sound_unions, stage_table

SHINGLE = 5
SALT = 0x2B
BLOCK = 64
FRAGMENTS = 4
#: Lengths of documents that link differ by less than this factor.
LENGTHS = 1.34
SETS = "doc_id long, mark long, n int, signature binary, ids binary, shared int, prefix binary"
SETS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("signature", pa.binary()), ("ids", pa.binary()), ("shared", pa.int32()), ("prefix", pa.binary())])


def shingles(table: pa.Table, twice: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """The distinct shingles of every row: hash, second hash, row, ordered by row and hash."""
    none = np.empty(0, np.uint64)
    first, second, owner, row = [none], [none], [none.astype(np.int32)], 0
    for batch in table.to_batches():
        for part in slices(batch, "text"):
            raw, offsets = flatten(part.column("text"))
            raw = lower_ascii(raw)
            starts, ends, text = word_spans(raw, offsets)
            words = span_hashes(raw, starts, ends)
            n = max(0, len(words) - SHINGLE + 1)
            whole = np.flatnonzero(text[:n] == text[SHINGLE - 1 :]) if n else np.empty(0, np.int64)
            begin = np.searchsorted(text, np.arange(part.num_rows + 1))
            sizes = np.diff(begin)
            short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))

            def hashed(salt: int) -> np.ndarray:
                own = words if not salt else span_hashes(raw, starts, ends, salt)
                spans = [own[begin[k] : begin[k + 1]] for k in short.tolist()]
                return np.concatenate([window_hashes(own, SHINGLE, salt)[whole], *[window_hashes(w, len(w), salt) for w in spans]])

            a, own = hashed(0), np.concatenate([text[whole], short])
            b = hashed(SALT) if twice else None
            order = hash_order(a) if b is None else np.lexsort((b, a))
            # Rows of a slice are few, so their sort is a radix sort.
            order = order[np.argsort(own[order].astype(np.uint16 if part.num_rows < 1 << 16 else np.int64), kind="stable")]
            a, own, b = a[order], own[order], None if b is None else b[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (own[1:] != own[:-1])
            if b is not None:
                new[1:] |= b[1:] != b[:-1]
                second.append(b[new])
            first.append(a[new])
            owner.append((own[new] + row).astype(np.int32))
            row += part.num_rows
    return np.concatenate(first), np.concatenate(second) if twice else None, np.concatenate(owner)


def _sets(table: pa.Table, distinct: Distinct, owner: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> pa.Table:
    """A row for each document; those that may link have their shared shingles and prefix."""
    rows = table.num_rows
    begin = np.searchsorted(owner, np.arange(rows + 1))
    n = np.diff(begin)
    known, number = counts[distinct.inverse], ids[distinct.inverse]
    shared = np.bincount(owner, known > 0, rows).astype(np.int64)
    out: list[list] = [[], [], [], []]
    for k in range(rows):
        if not n[k] or 4 * shared[k] < 3 * n[k]:
            for column in out:
                column.append(None)
            continue
        count, held = known[begin[k] : begin[k + 1]], number[begin[k] : begin[k + 1]]
        count, held = count[count > 0], held[count > 0]  # hashes, and so ids, rise
        own = int(n[k] - shared[k])
        first = np.lexsort((held, count))[: max(0, int(n[k]) // 4 + 1 - own)]
        whole = distinct.hashes[distinct.inverse[begin[k] : begin[k + 1]]]
        with np.errstate(over="ignore"):
            signature = np.array([whole.sum(dtype=np.uint64), mix(whole).sum(dtype=np.uint64), n[k]], np.uint64).tobytes()
        prefix = np.empty((len(first), 2), np.uint64)
        prefix[:, 0], prefix[:, 1] = held[first], count[first]
        for column, value in zip(out, (signature, squeeze(held), len(held), prefix.tobytes()), strict=True):
            column.append(value)
    arrays = [table.column("doc_id").combine_chunks(), table.column("mark").combine_chunks(), pa.array(n, pa.int32()), *[pa.array(c, f.type) for c, f in zip(out, list(SETS_SCHEMA)[3:], strict=True)]]
    return pa.Table.from_arrays(arrays, schema=SETS_SCHEMA)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [np.frombuffer(p.as_buffer(), np.uint64).reshape(-1, 2) for p in batch.column("prefix")]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = np.concatenate([np.empty((0, 2), np.uint64), *raw])
        n, shared = batch.column("n").to_numpy(), batch.column("shared").to_numpy()
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(n - shared, sizes)
        columns = [pa.array(flat[:, 0].astype(np.int64)), pa.array(flat[:, 1].astype(np.int16)), pa.array(place.astype(np.int32)), pa.array(np.repeat(batch.column("doc_id").to_numpy(), sizes)), pa.array(np.repeat(n, sizes), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["h", "c", "place", "doc_id", "n"])


def links_of(ids: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, fragments: int = FRAGMENTS) -> list[tuple[int, int]]:
    """Links (root, member) that give the components of a small set of documents.

    The shingles are put in their global order, cut into fragments, and the overlaps of all
    documents counted in each fragment by a matrix product; the parts are summed.
    """
    m = len(sets)
    order, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    overlap = np.zeros((m, m), np.float32)
    step = max(1, min(8192, -(-len(order) // fragments)))
    for low in range(0, len(order), step):
        inside = (column >= low) & (column < low + step)
        held = np.zeros((m, step), np.float32)
        held[row[inside], column[inside] - low] = 1
        overlap += held @ held.T
    total = sizes[:, None] + sizes[None, :]
    linked = 7 * overlap >= 3 * total  # 4 o >= 3 (total - o)
    label = np.arange(m)
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    label = rank.copy()
    while True:
        new = np.where(linked, label[None, :], m).min(axis=1)
        new = np.minimum(new, label)
        if (new == label).all():
            break
        label = new
    root = np.argsort(ids, kind="stable")[label]
    return [(int(ids[r]), int(ids[k])) for k, r in enumerate(root.tolist()) if ids[r] != ids[k]]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _block(table: pa.Table) -> pa.Table:
    ids = table.column("doc_id").to_numpy()
    sets = [unsqueeze(s.as_py(), k) for s, k in zip(table.column("ids"), table.column("shared").to_pylist(), strict=True)]
    got = links_of(ids, sets, table.column("n").to_numpy().astype(np.int64)) if len(ids) > 1 else []
    return pa.Table.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], schema=LINKS)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's shared shingles cut at fixed places of the global order."""
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for key, data, k in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("shared").to_pylist(), strict=True):
            ids = unsqueeze(data.as_py(), k)
            part = mix(ids >> np.uint64(12)) % np.uint64(FRAGMENTS)  # runs of the order, dealt evenly
            for f in range(FRAGMENTS):
                held = ids[part == f]
                for column, value in zip(rows, (key, f, len(held), squeeze(held) if len(held) else b""), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.binary())], ["doc_id", "fragment", "size", "held"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {name: batch.column(name).to_pylist() for name in ("size_a", "held_a", "size_b", "held_b")}
        count = [len(np.intersect1d(unsqueeze(x, m), unsqueeze(y, k), assume_unique=True)) if m and k else 0 for m, x, k, y in zip(c["size_a"], c["held_a"], c["size_b"], c["held_b"], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("total"), pa.array(count, pa.int64())], ["a", "b", "total", "overlap"])


def candidate_lists(reps: DataFrame) -> DataFrame:
    """(h, doc_id, n, place, cnt): for every kept shingle, the documents with it in their prefix."""
    postings = reps.select("doc_id", "n", "shared", "prefix").mapInArrow(_postings, "h long, c short, place int, doc_id long, n int")
    lists = postings.groupBy("h").agg(F.count("*").alias("cnt"), F.min("c").alias("c"), F.bit_xor(F.xxhash64("doc_id")).alias("s"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("t")).where("cnt > 1")
    kept = lists.groupBy("cnt", "s", "t").agg(F.min(F.struct("c", "h")).alias("m")).select(F.col("m.h").alias("h"), "cnt")
    return stage_table(postings.drop("c").join(kept, "h"), "lists")


def cluster_links(lists: DataFrame, reps: DataFrame) -> DataFrame:
    """Links among random parts of the larger lists: of the longest one and of one more of each document."""
    chosen = lists.where("cnt > 2").groupBy("doc_id").agg(F.max(F.struct("cnt", "h")).alias("longest"), F.max(F.struct(F.xxhash64("h").alias("x"), "cnt", "h")).alias("other"))
    rounds = F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"{c}.cnt").alias("cnt"), F.col(f"{c}.h").alias("h")) for r, c in enumerate(("longest", "other"))])
    members = chosen.select("doc_id", F.explode(rounds).alias("m")).select("doc_id", "m.r", "m.h", F.pmod(F.xxhash64("doc_id", "m.r"), F.ceil(F.col("m.cnt") / BLOCK)).alias("part"))
    return members.join(reps.select("doc_id", "n", "shared", "ids"), "doc_id").groupBy("r", "h", "part").applyInArrow(_block, "a long, b long")


def open_pairs(lists: DataFrame, components: DataFrame) -> DataFrame:
    """(a, b, total): pairs of one list in different components whose sizes and places allow a link.

    Of every list, the documents outside its most frequent component meet all of the list.
    """
    labelled = lists.join(components.select(F.col("node").alias("doc_id"), "parent"), "doc_id", "left").select("h", "doc_id", "n", "place", F.coalesce("parent", "doc_id").alias("comp"))
    # The size that a partner may have at most, so that the places leave room for the overlap.
    cap = F.floor(7 * (F.col("n") - F.col("place")) / 3) - F.col("n")
    labelled = stage_table(labelled.withColumns({"cap": cap, "length": F.floor(F.log("n") / math.log(LENGTHS))}), "labelled")
    share = labelled.groupBy("h", "comp").agg(F.count("*").alias("k"))
    major = share.groupBy("h").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("h", F.col("m.comp").alias("major"))
    minor = labelled.join(stage_table(major, "major"), "h").where("comp <> major")
    near = F.explode(F.array(*[F.col("length") + k for k in (-1, 0, 1)]))
    minor = stage_table(minor.select("h", near.alias("length"), "major", *[F.col(c).alias(f"o_{c}") for c in ("doc_id", "n", "cap", "comp")]), "minor")
    fits = (F.col("comp") != F.col("o_comp")) & ((F.col("comp") == F.col("major")) | (F.col("o_doc_id") < F.col("doc_id"))) & (F.col("n") <= F.col("o_cap")) & (F.col("o_n") <= F.col("cap"))
    sides = ((minor.where("o_n <= o_cap"), labelled), (minor.where("o_n > o_cap"), labelled.where("n <= cap")))
    met = [x.join(y, ["h", "length"]).where(fits).select(F.least("o_doc_id", "doc_id").alias("a"), F.greatest("o_doc_id", "doc_id").alias("b"), (F.col("n") + F.col("o_n")).cast("long").alias("total")) for x, y in sides]
    return met[0].unionAll(met[1]).distinct()


def pair_links(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that link, by the sum of their partial overlaps."""
    parts = reps.select("doc_id", "shared", "ids").mapInArrow(_fragments, "doc_id long, fragment int, size int, held binary")
    first = parts.select(F.col("doc_id").alias("a"), "fragment", F.col("size").alias("size_a"), F.col("held").alias("held_a"))
    last = parts.select(F.col("doc_id").alias("b"), "fragment", F.col("size").alias("size_b"), F.col("held").alias("held_b"))
    both = pairs.join(first, "a").join(last, ["b", "fragment"]).select("a", "b", "total", "size_a", "held_a", "size_b", "held_b")
    partial = both.mapInArrow(_partial, "a long, b long, total long, overlap long")
    return partial.groupBy("a", "b", "total").agg(F.sum("overlap").alias("overlap")).where("7 * overlap >= 3 * total").select("a", "b")


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, first) of every row of (doc_id, text) with an id.

    ``mark`` is a hash of the text, ``first`` says whether its set stands for the whole component.
    """
    sound_unions(docs.sparkSession)
    small_batches(docs.sparkSession)
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("mark"))
    size, top = known.agg(F.sum(F.octet_length("text")).alias("n"), F.max("doc_id").alias("top")).first()
    groups = group_count(int(size or 0))
    assign = assignment(range_points(known, groups))

    def per_hash(distinct: Distinct, owner: np.ndarray) -> np.ndarray:
        return distinct.totals(np.ones(len(owner), np.int64))

    sets = stage_table(exchange(deal(known, assign, groups), shingles, per_hash, _sets, SETS, "shared", int(size or 0) // 6), "sets")
    open_sets = sets.where("ids IS NOT NULL")
    # A class is named by its smallest id; further classes of the same smallest id get numbers beyond all ids.
    least = stage_table(open_sets.groupBy("signature").agg(F.min("doc_id").alias("class_id")), "classes")
    named_first = stage_table(least.groupBy("class_id").agg(F.min("signature").alias("named")), "named")
    node = F.when(F.col("signature") == F.col("named"), F.col("class_id")).otherwise(F.lit((top or 0) + 1) + F.monotonically_increasing_id())
    classes = stage_table(least.join(named_first, "class_id").select("signature", "class_id", node.alias("node")), "classes")
    found = open_sets.join(classes.withColumnRenamed("class_id", "doc_id"), ["doc_id", "signature"]).dropDuplicates(["node"])
    reps = stage_table(found.select(F.col("node").alias("doc_id"), "n", "ids", "shared", "prefix"), "reps")
    lists = candidate_lists(reps)
    clusters = connected(cluster_links(lists, reps))
    found = stage_table(pair_links(open_pairs(lists, clusters), reps), "pairs")
    components = connected(clusters.select(F.col("node").alias("a"), F.col("parent").alias("b")).unionAll(found))
    rooted = stage_table(classes.join(components, "node", "left").select("signature", "class_id", "node", F.coalesce("parent", "node").alias("root")), "rooted")
    chosen = stage_table(rooted.groupBy("root").agg(F.min(F.struct("class_id", "node")).alias("c")).select("root", F.col("c.class_id").alias("component_id"), F.col("c.node").alias("chosen")), "chosen")
    labels = stage_table(rooted.join(chosen, "root").select("signature", "component_id", (F.col("node") == F.col("chosen")).alias("stands")), "labels")
    shown = ("doc_id", "mark", F.col("n").cast("long").alias("n_shingles"))
    linked = open_sets.select("doc_id", "mark", "n", "signature").join(labels, "signature").select(*shown, "component_id", (F.col("stands") & (F.col("doc_id") == F.col("component_id"))).alias("first"))
    return linked.unionByName(sets.where("ids IS NULL").select(*shown, F.col("doc_id").alias("component_id"), F.lit(True).alias("first")))


def similarity_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    none = docs.where(F.col("doc_id").isNull()).mapInArrow(_sizes, "doc_id long, n_shingles long, component_id long")
    return _judged(docs).select("doc_id", "n_shingles", "component_id").unionByName(none)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            own = shingles(pa.Table.from_batches([part]), False)[2]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.bincount(own, minlength=part.num_rows), pa.int64()), part.column("doc_id")], ["doc_id", "n_shingles", "component_id"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text stands for its component; of rows with equal id and text, one stays."""
    mark = "mark"
    while mark in docs.columns:
        mark += "_"
    kept = _judged(docs.select("doc_id", "text")).where("first").select("doc_id", F.col("mark").alias(mark)).distinct()
    known = docs.where(F.col("doc_id").isNotNull()).withColumn(mark, F.xxhash64("text")).join(kept, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return known.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents`` at a Jaccard similarity of 0.75."""
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') END AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * p.o >= 75 * (len(x.s) + len(y.s) - p.o)),
b AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, b.b FROM r JOIN b ON b.a = r.seen)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.seen) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY ALL
"""
