"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared in lower case (A-Z and U+00C0 to U+00DE) with white-space
runs as one space. An occurrence of an item of n bytes with at most e edits, a tenth of n, shares at
least n + 1 - q (e + 1) q-grams with it, all on diagonals (place in the text minus place in the item)
that differ by at most e. So the q-grams of a text are looked up in an index of the items, shared
ones are counted per item in bands of diagonals that overlap by e, and only bands that reach the
bound are verified, by an edit-distance alignment that does not leave the band. q is 8, or for an
item under 32 bytes the largest number for which the bound is positive, so short items are found too;
one of under ten bytes has to occur unchanged. What is counted is the places of a text that share a
q-gram with a band. Places of an item with the same gram that are no further apart than a band is
wide form one interval of the index, and equal grams in a row of a text one run of places, so rules of
dashes, blank forms and other repeated characters cost an entry a band and not one a pair of places;
entries are made and added up in parts of PART. Where many bands are left, the least distance of each is
found first, for all of them at once by bit vectors, and only those that can still give the best
occurrence are aligned.

Items go out in blocks of at most about ``block_bytes``, whose index takes about 20 bytes a byte of
text on the driver and in a worker, so neither grows with the benchmark. One block is searched in
one pass; several in one pass each, whose finds are staged by the hashes of the text (two of 64 bits)
and joined to the documents at the end. Defined cases: null or empty texts and items match nothing;
texts are searched whole, however long; repeated rows are searched each, repeated items once; an
empty benchmark leaves all documents clean; extra columns are kept, but one named ``hits`` is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.langid import lower_latin
from siltstone.llm.textbytes import HEADS, eights, flatten, lean, slices, trim
from siltstone.runtime import small_batches, sound_unions, stage_table

Q = 8
RATE = 0.1
SLOT_BITS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Entries that are counted at a time, and regions from which on least distances are found together, and how many together.
PART, MANY, TOGETHER = 1 << 18, 16, 1 << 12
HIT = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())]))
HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case, white-space runs as one space and none at the ends; offsets; source place of each byte."""
    raw = lower_latin(raw)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    raw = np.where(space, np.uint8(32), raw)
    after_space = np.concatenate([[True], space[:-1]]) if len(raw) else space
    after_space[offsets[:-1][offsets[:-1] < len(raw)]] = True
    keep = np.flatnonzero(~(space & after_space))
    ends = np.searchsorted(keep, offsets)
    # A space left at a text's end has nothing behind it.
    last = ends[1:][np.diff(ends) > 0] - 1
    drop = last[raw[keep[last]] == 32]
    if len(drop):
        keep = np.delete(keep, drop)
        ends = np.searchsorted(keep, offsets)
    return raw[keep], ends, keep


@dataclass
class Grams:
    """The q-grams of the items of one q: the intervals of their places, ordered by the gram."""

    q: int
    present: np.ndarray
    keys: np.ndarray  # distinct
    firsts: np.ndarray  # of each key in the intervals, and the end
    items: np.ndarray
    lows: np.ndarray
    highs: np.ndarray


@dataclass
class Index:
    item_ids: list[int]
    texts: list[bytes]
    sizes: np.ndarray
    edits: np.ndarray
    bounds: np.ndarray
    widths: np.ndarray  # of a band, a power of two above the edits
    grams: list[Grams]


def gram_index(texts: list[bytes], chosen: np.ndarray, q: int, widths: np.ndarray) -> Grams:
    sizes = np.array([len(texts[k]) for k in chosen], np.int64)
    raw = np.frombuffer(b"".join(texts[k] for k in chosen), np.uint8)
    counts = sizes + 1 - q
    begin = np.repeat((np.cumsum(sizes) - sizes).astype(np.uint32), counts)
    places = np.arange(len(begin), dtype=np.uint32) - np.repeat((np.cumsum(counts) - counts).astype(np.uint32), counts)
    every = eights(raw)[begin + places] & HEADS[q]
    del begin
    order = np.argsort(every, kind="stable").astype(np.uint32)
    every = every[order]
    places = places[order]
    items = np.repeat(chosen.astype(np.uint32), counts)[order]
    del order
    apart = np.ones(len(every), bool)
    apart[1:] = (every[1:] != every[:-1]) | (items[1:] != items[:-1]) | (places[1:].astype(np.int64) - places[:-1] > widths[items[1:]])
    lows = np.flatnonzero(apart)
    highs = np.append(lows[1:], len(every)) - 1
    every, items, lows, highs = every[lows], items[lows], places[lows], places[highs]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    firsts = np.append(np.flatnonzero(new), len(every)).astype(np.uint32)
    keys = every[new]
    present = np.zeros(1 << SLOT_BITS, bool)
    present[(keys * MULTIPLIER) >> np.uint64(64 - SLOT_BITS)] = True
    return Grams(q, present, keys, firsts, items, lows, highs)


def build_index(rows: list[tuple[int, str]], rate: float = RATE) -> Index:
    ids, texts = [], []
    for key, text in sorted({(k, t) for k, t in rows if k is not None and t}):
        raw = np.frombuffer(text.encode(), np.uint8)
        clean = normalise(raw, np.array([0, len(raw)]))[0].tobytes()
        if clean:
            ids.append(key)
            texts.append(clean)
    sizes = np.array([len(t) for t in texts], np.int64)
    edits = (rate * sizes).astype(np.int64)
    q = np.minimum(Q, np.maximum(1, sizes // (edits + 1)))
    widths = 1 << np.maximum(4, np.ceil(np.log2(edits + 1)).astype(np.int64)) if len(texts) else np.empty(0, np.int64)
    return Index(ids, texts, sizes, edits, np.maximum(1, sizes + 1 - q * (edits + 1)), widths, [gram_index(texts, np.flatnonzero(q == k), k, widths) for k in np.unique(q).tolist()])


_FAR = 1 << 62


def align(item: bytes, region: bytes, most: int, low: int | None = None, high: int | None = None) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of ``item`` in ``region`` with at most ``most`` edits.

    Row i holds, for each diagonal from ``low`` to ``high`` (all, if not given), the cost of the item's
    first i bytes against a part of the region that ends i bytes behind the diagonal; nothing outside
    the band is computed. Cost and start are packed, so that a minimum carries its start along.
    """
    at = region.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    if not most:
        return None
    n = len(region)
    low, high = max(-len(item), -most if low is None else low), min(n, n - len(item) + most if high is None else high)
    if high < low:
        return None
    # Place j of the region is padded[j + len(item)].
    padded = np.full(n + 2 * len(item) + 1, 256, np.int16)
    padded[len(item) : len(item) + n] = np.frombuffer(region, np.uint8)
    diagonals = np.arange(low, high + 1)
    rise = np.arange(len(diagonals)) << 32
    cell = np.where((diagonals >= 0) & (diagonals <= n), diagonals, _FAR)
    for i, byte in enumerate(item, 1):
        new = cell + ((padded[low + i - 1 + len(item) : high + i + len(item)] != byte).astype(np.int64) << 32)
        new[:-1] = np.minimum(new[:-1], cell[1:] + (1 << 32))
        cell = np.minimum.accumulate(new - rise) + rise
        if low + i < 0:
            cell[: -(low + i)] = _FAR
        if high + i > n:
            cell[n - high - i :] = _FAR
        cell = np.minimum(cell, _FAR)
        if not len(cell) or cell.min() >> 32 > most:
            return None
    k = int((cell >> 32).argmin())
    cost, start = int(cell[k]) >> 32, int(cell[k]) & 0xFFFFFFFF
    return (cost, start, low + k + len(item)) if cost <= most else None


def candidates(index: Index, grams: Grams, chunks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (text number, item, first diagonal of the band) whose shared q-grams reach the bound."""
    none = np.empty((0, 3), np.int64)
    keys = chunks & HEADS[grams.q]
    at = np.flatnonzero(grams.present[(keys * MULTIPLIER) >> np.uint64(64 - SLOT_BITS)])
    place = np.minimum(np.searchsorted(grams.keys, keys[at]), len(grams.keys) - 1)
    good = grams.keys[place] == keys[at]
    at, place = at[good], place[good]
    doc = np.searchsorted(offsets, at, side="right") - 1
    inside = at + grams.q <= offsets[doc + 1]
    at, place, doc = at[inside], place[inside], doc[inside]
    if not len(at):
        return none
    # Runs of places with the same gram.
    starts = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
    lasts = np.append(starts[1:], len(at)) - 1
    begin, end, place, doc = at[starts] - offsets[doc[starts]], at[lasts] - offsets[doc[starts]], place[starts], doc[starts]
    first = grams.firsts[place].astype(np.int64)
    count = grams.firsts[place + 1] - first
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    # Bands are 16 wide at least, and edits fewer than an item's bytes.
    before = (int(index.sizes.max()) >> 3) + 8
    span = before + (int((offsets[1:] - offsets[:-1]).max()) >> 4) + 8
    for which, entry in _parts(first, count):
        item = grams.items[entry].astype(np.int64)
        width, most = index.widths[item], index.edits[item]
        low, high = begin[which] - grams.highs[entry], end[which] - grams.lows[entry]
        bands_first, bands = (low - most) // width, high // width - (low - most) // width + 1
        # The bands of an entry: a band from diagonal d on reaches to d + width + edits.
        for entries, band in _parts(bands_first, bands):
            d = band * width[entries]
            reach = np.minimum(end[which[entries]], d + (width + most)[entries] - 1 + grams.highs[entry[entries]])
            places = reach - np.maximum(begin[which[entries]], d + grams.lows[entry[entries]]) + 1
            packed = (doc[which[entries]] * len(index.texts) + item[entries]) * span + band + before
            got, inverse = np.unique(packed, return_inverse=True)
            keys, sums = _added(keys, sums, got, np.bincount(inverse, places).astype(np.int64))
    item = keys // span % len(index.texts)
    keep = sums >= index.bounds[item]
    keys, item = keys[keep], item[keep]
    return np.stack([keys // span // len(index.texts), item, (keys % span - before) * index.widths[item]], axis=1)


def _parts(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers k and first[k] .. first[k] + count[k] - 1 for all k, at most PART at a time."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, PART):
        every = np.arange(low, min(total, low + PART))
        which = np.searchsorted(ends, every, side="right")
        yield which, first[which] + every - (ends[which] - count[which])


def _added(keys: np.ndarray, sums: np.ndarray, more: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of sums by key as one."""
    if not len(keys):
        return more, counts
    every, inverse = np.unique(np.concatenate([keys, more]), return_inverse=True)
    return every, np.bincount(inverse, np.concatenate([sums, counts])).astype(np.int64)


def least_distances(items: list[bytes], which: np.ndarray, text: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Least edit distance of items[which[k]] to any part of text[begins[k] : stops[k]], for all k.

    Columns of the alignment are bit vectors of differences, 64 rows a word; one step a byte of the
    regions updates all of them.
    """
    out = np.empty(len(which), np.int64)
    words = np.array([-(-len(items[k]) // 64) for k in which.tolist()])
    sizes = stops - begins
    for n in np.unique(words).tolist():
        rows = np.flatnonzero(words == n)
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        step = max(1, TOGETHER // n)
        for low in range(0, len(rows), step):
            chosen = rows[low : low + step]
            out[chosen] = _distances(items, which[chosen], text, begins[chosen], sizes[chosen], n)
    return out


def _distances(items: list[bytes], which: np.ndarray, text: np.ndarray, begins: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    some, lane = np.unique(which, return_inverse=True)
    equal = np.zeros((n, len(some) * 257), np.uint64)
    for k, item in enumerate(some.tolist()):
        raw = np.frombuffer(items[item], np.uint8)
        rows = np.arange(len(raw))
        np.bitwise_or.at(equal, (rows >> 6, k * 257 + raw.astype(np.int64)), np.uint64(1) << (rows & 63).astype(np.uint64))
    base = lane * 257
    length = np.array([len(items[k]) for k in some.tolist()])[lane]
    top = [np.full(len(which), 63, np.uint64)] * (n - 1) + [((length - 1) & 63).astype(np.uint64)]
    up, down = [np.full(len(which), (1 << 64) - 1, np.uint64) for _ in range(n)], [np.zeros(len(which), np.uint64) for _ in range(n)]
    score, least, one = length.copy(), length.copy(), np.uint64(1)
    for t in range(int(sizes.max())):
        inside = t < sizes
        byte = np.where(inside, text[np.minimum(begins + t, len(text) - 1)], 256).astype(np.int64)
        more = less = np.zeros(len(which), np.uint64)
        for b in range(n):
            same = equal[b][base + byte]
            vertical = same | down[b]
            same = same | less
            level = (((same & up[b]) + up[b]) ^ up[b]) | same
            right_more, right_less = down[b] | ~(level | up[b]), up[b] & level
            out_more, out_less = (right_more >> top[b]) & one, (right_less >> top[b]) & one
            right_more, right_less = right_more << one | more, right_less << one | less
            up[b], down[b] = right_less | ~(vertical | right_more), right_more & vertical
            more, less = out_more, out_less
        score = score + more.astype(np.int64) - less.astype(np.int64)
        least = np.where(inside, np.minimum(least, score), least)
    return least


def _regions(index: Index, rows: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and stop of the part of the texts that the bands of ``rows`` cover, and their lowest and highest diagonal there."""
    doc, item, diagonal = rows.T
    most, size = index.edits[item], index.sizes[item]
    low, high = diagonal - most, diagonal + index.widths[item] + 2 * most
    begin = np.maximum(0, low)
    stop = np.maximum(begin, np.minimum(ends[doc + 1] - ends[doc], high + size))
    return begin + ends[doc], stop + ends[doc], low - begin, high - begin


def search(index: Index, raw: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """For each text, the best verified occurrence of each item, in byte places of the given texts."""
    text, ends, source = normalise(raw, offsets)
    found: list[dict[int, tuple]] = [{} for _ in range(len(offsets) - 1)]
    chunks = eights(text)[: len(text)] if index.grams and len(text) else None
    for grams in index.grams if chunks is not None else ():
        rows = candidates(index, grams, chunks, ends)
        if not len(rows):
            continue
        begins, stops, lows, highs = _regions(index, rows, ends)
        # The first unchanged occurrence is the best one, whatever else there is.
        pairs = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)))
        for a, b in zip(pairs.tolist(), np.append(pairs[1:], len(rows)).tolist(), strict=True):
            doc, item = rows[a, :2].tolist()
            base, first = int(ends[doc]), int(begins[a])
            at = text[first : int(stops[b - 1])].tobytes().find(index.texts[item])
            if at >= 0:
                begins[a:b] = -1
                at += first
                found[doc][item] = (0, at - base, at - base + len(index.texts[item]))
        left = np.flatnonzero((begins >= 0) & (index.edits[rows[:, 1]] > 0))
        least = np.zeros(len(rows), np.int64)
        if len(left) >= MANY:
            least[left] = least_distances(index.texts, rows[left, 1], text, begins[left], stops[left])
            left = left[least[left] <= index.edits[rows[left, 1]]]
            left = left[np.argsort(least[left], kind="stable")]
        for k in left.tolist():
            doc, item = rows[k, :2].tolist()
            base, begin = int(ends[doc]), int(begins[k])
            best = found[doc].get(item)
            if best is not None and (int(least[k]), begin - base) > best[:2]:
                continue
            got = align(index.texts[item], text[begin : int(stops[k])].tobytes(), int(index.edits[item]), int(lows[k]), int(highs[k]))
            if got is not None:
                hit = (got[0], begin - base + got[1], begin - base + got[2])
                found[doc][item] = min(hit, best or hit)
    out = []
    for doc, items in enumerate(found):
        base, zero = int(ends[doc]), int(offsets[doc])
        out.append([{"item_id": index.item_ids[i], "start": int(source[base + a]) - zero, "end": int(source[base + b - 1]) - zero + 1, "edits": e} for i, (e, a, b) in sorted(items.items())])
    return out


def _annotator(shared, keep: list[int]):
    """Appends the hits to the columns at ``keep``."""

    def annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        index: Index = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                hits = pa.array(search(index, *flatten(part.column("text"))), HIT_ARROW)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], hits], [*[part.schema.names[k] for k in keep], "hits"])
        trim()

    return annotate


def _with_hits(docs: DataFrame, shared) -> DataFrame:
    keep = [k for k, c in enumerate(docs.columns) if c != "hits"]
    return docs.mapInArrow(_annotator(shared, keep), T.StructType([*[docs.schema.fields[k] for k in keep], T.StructField("hits", HIT)]))


def _spare(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def annotate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = 4 << 20) -> DataFrame:
    """Add ``hits`` to every row: the items that occur in its text, with byte places and edits."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(size) // block_bytes))

    def block(k: int):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        return spark.sparkContext.broadcast(build_index([(r["item_id"], r["text"]) for r in rows], rate))

    if blocks == 1:
        return _with_hits(docs, block(0))
    docs = docs.drop("hits")
    a, b = _spare(docs.columns, "text_a"), _spare(docs.columns, "text_b")
    # A hash seeds that of the next column, so the constant of the second one comes before the text.
    first, second = F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))
    marks = [first.alias(a), second.alias(b)]
    found = []
    for k in range(blocks):
        shared = block(k)
        texts = docs.select("text", *marks).where(F.col("text").isNotNull())
        found.append(stage_table(_with_hits(texts, shared).where(F.size("hits") > 0).select(a, b, F.explode("hits").alias("hit")).distinct(), "hits"))
        shared.destroy()
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    sound_unions(spark)
    # Staged, so that the join below has two plain sides, whose frequent texts can be dealt out.
    lists = stage_table(every.groupBy(a, b).agg(F.sort_array(F.collect_list("hit")).alias("hits")), "hits")
    joined = docs.withColumns({a: first, b: second}).join(lists, [a, b], "left")
    return joined.select(*docs.columns, F.coalesce("hits", F.array().cast(HIT)).alias("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; same columns."""
    return annotate(docs, benchmark, rate).where(F.size("hits") == 0).select(*docs.columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """The best occurrence of every ``benchmark`` item in every text of ``documents``; clean documents have no row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", F.explode("hits").alias("h"))
    return hits.select("doc_id", "h.item_id", F.col("h.start").alias("start_byte"), F.col("h.end").alias("end_byte"), "h.edits")
