"""Compact exchange of the hashes of all windows of a corpus.

Rows are dealt into groups by ranges of their id and shuffled once, packed and compressed. Ranges
hold about as many bytes each; an id with more than a range's share is a range by itself, whose rows
are dealt over several groups, so no group grows with the rows of one id. Every group
reduces its windows to one sorted list of distinct 64-bit hashes; the list is cut into buckets by
the high bits, differences of neighbours are stored in as few byte planes as they need, and the
pieces of one bucket from all groups meet in one task. What is said about a hash there (a flag or a
count) goes back to the groups as an array over their sorted list, so neither the hashes nor the
texts travel again. Group and bucket counts follow the size of the input; a hash that is everywhere
costs one entry a group, whatever its number of occurrences.

Where the input is so large that equal 64-bit hashes of different windows become likely, part of a
second hash is carried along, of other word hashes and another polynomial: ``hash_width`` gives the
bytes that keep the expected number of false equals below 2**-10.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.textbytes import flatten, hash_order, lean, slices, trim
from siltstone.runtime import session_partitions

GROUP_BYTES = 8 << 20
BUCKET_ENTRIES = 1 << 20
PACK = "grp int, pack binary"
#: A group's number is its range's number times this, plus the place among the range's groups.
PER_RANGE = 1 << 10
#: Bytes of text that count as one row when ranges are cut.
UNIT_BYTES = 4096


def group_count(size: int) -> int:
    """Groups for ``size`` bytes of text: of 8 MB up to 160 GB in all, then larger ones, 256 MB at most, so
    that the pieces that groups and buckets exchange do not shrink to single hashes."""
    return max(1, -(-size // min(max(GROUP_BYTES, size // 20_000), 256 << 20)))


def bucket_count(windows: int) -> int:
    """Buckets of a million hashes, of up to eight million once there are more than 100,000 buckets."""
    return max(1, -(-windows // min(max(BUCKET_ENTRIES, windows // 100_000), 8 << 20)))


def hash_width(windows: int) -> int:
    """Bytes of the second hash. Polynomials of the same words in another order differ in 58 bits at least."""
    bits = 2 * math.log2(max(2, windows)) + 10 - 58
    return min(8, max(0, math.ceil(bits / 8)))


def pack_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(pack) -> pa.Table:
    return pa.ipc.open_stream(pack.as_buffer() if isinstance(pack, pa.Scalar) else pack).read_all()


def range_points(docs: DataFrame, groups: int, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Ids that cut the rows of ``docs`` into ``groups`` ranges of about as many bytes; an id of many bytes comes several times."""
    if groups < 2:
        return np.empty(0, np.int64)
    points = [k / groups for k in range(1, groups)]
    units = docs.select(key, F.explode(F.sequence(F.lit(1), 1 + (F.coalesce(F.octet_length(text), F.lit(0)) / UNIT_BYTES).cast("int"))).alias("unit"))
    got = units.agg(F.percentile_approx(key, points, max(10_000, 20 * groups)).alias("p")).first()["p"]
    return np.array(got or [], np.int64)


def assignment(points: np.ndarray, key: str = "doc_id", text: str = "text") -> Callable[[pa.RecordBatch], np.ndarray]:
    """A function that gives every row of a batch its group; ranges rise with the id."""
    heavy, times = np.unique(points, return_counts=True)
    heavy, times = heavy[times > 1], np.minimum(times[times > 1] + 1, PER_RANGE)
    bounds = np.unique(np.concatenate([points, heavy[heavy < np.iinfo(np.int64).max] + 1]))

    def assign(part: pa.RecordBatch) -> np.ndarray:
        ids = part.column(key).to_numpy()
        group = np.searchsorted(bounds, ids, side="right") * PER_RANGE
        if len(heavy):
            place = np.minimum(np.searchsorted(heavy, ids), len(heavy) - 1)
            at = np.flatnonzero(heavy[place] == ids)
            if len(at):
                raw, offsets = flatten(part.column(text))
                mark = np.array([zlib.crc32(raw[offsets[k] : offsets[k + 1]]) + k for k in at.tolist()], np.int64)
                group[at] += mark % times[place[at]]
        return group

    return assign


def _packer(assign: Callable[[pa.RecordBatch], np.ndarray], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, text):
                group = assign(part)
                order = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.diff(group[order])) + 1
                rows = [o for o in np.split(order, cuts) if len(o)]
                packs = [pack_rows(part if len(o) == part.num_rows and (np.diff(o) == 1).all() else part.take(pa.array(o))) for o in rows]
                yield pa.RecordBatch.from_arrays([pa.array([int(group[o[0]]) for o in rows], pa.int32()), pa.array(packs, pa.binary())], ["grp", "pack"])
        trim()

    return run


def deal(rows: DataFrame, assign: Callable[[pa.RecordBatch], np.ndarray], groups: int, text: str = "text") -> DataFrame:
    """(grp, pack): rows by the group that ``assign`` gives them, shuffled to it."""
    return rows.mapInArrow(_packer(assign, text), PACK).repartition(max(groups, session_partitions(rows.sparkSession)), "grp")


def group_table(packs: pa.Table) -> pa.Table:
    return pa.concat_tables([unpack_rows(p) for p in packs.column("pack")]).combine_chunks()


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Rising with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def squeeze(values: np.ndarray) -> bytes:
    """Sorted u64 values as byte planes of their differences."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(gaps[1:].max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[1:, :width].T)
    return bytes([width]) + values[:1].astype("<u8").tobytes() + zstandard.compress(planes.tobytes(), 1)


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    width = data[0]
    planes = np.frombuffer(zstandard.decompress(data[9:]) if n > 1 else b"", np.uint8).reshape(width, n - 1)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[1:, :width] = planes.T
    gaps[0] = np.frombuffer(data[1:9], np.uint8)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


class Distinct:
    """The sorted distinct (hash, second hash) of a group's windows."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None):
        order = hash_order(first) if second is None else np.lexsort((second, first)).astype(np.int32 if len(first) < 1 << 31 else np.int64)
        a = first[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        if second is not None:
            new[1:] |= second[order][1:] != second[order][:-1]
        self.order, self.starts = order, np.flatnonzero(new).astype(order.dtype)
        self.hashes = a[self.starts]
        self.second = None if second is None else second[order][self.starts]
        self.inverse = np.empty_like(order)
        self.inverse[order] = np.cumsum(new, dtype=order.dtype) - 1

    def least(self, values: np.ndarray) -> np.ndarray:
        """Smallest value of each distinct hash."""
        return np.minimum.reduceat(values[self.order], self.starts) if len(self.starts) else values[:0]

    def totals(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.order], self.starts) if len(self.starts) else values[:0]


BLOB = "bucket int, grp int, n int, blob binary, extra binary, counts binary"


def blobs(group: int, distinct: Distinct, counts: np.ndarray, buckets: int, width: int) -> pa.RecordBatch:
    """One row for each bucket that the group has hashes in; counts are capped at 255."""
    bucket = bucket_of(distinct.hashes, buckets)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    small = np.minimum(counts, 255).astype(np.uint8)
    extra = [b"" if not width else np.ascontiguousarray(distinct.second[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes() for a, b in spans]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([group] * len(spans), pa.int32()), pa.array([b - a for a, b in spans], pa.int32()),
         pa.array([squeeze(distinct.hashes[a:b]) for a, b in spans], pa.binary()), pa.array(extra, pa.binary()), pa.array([zstandard.compress(small[a:b].tobytes(), 1) for a, b in spans], pa.binary())],
        ["bucket", "grp", "n", "blob", "extra", "counts"],
    )


REPLY = "grp int, bucket int, flags binary, ranks binary"
REPLY_SCHEMA = pa.schema([("grp", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary()), ("ranks", pa.binary())])
#: Ranks of one bucket are below this; ids of shared hashes are bucket * RANKS + rank and rise with the hash.
RANKS = 1 << 24


def _meet(rule: str, width: int):
    """``later``: 1 where a group of an earlier range has the hash. ``shared``: where all groups' counts add
    up to 2 or more, the sum (capped at 255) and the rank of the hash among such hashes of the bucket."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        table = table.sort_by("grp")
        sizes = table.column("n").to_numpy()
        first = np.concatenate([unsqueeze(b.as_py(), n) for b, n in zip(table.column("blob"), sizes.tolist(), strict=True)])
        second = None
        if width:
            raw = np.frombuffer(b"".join(e.as_py() for e in table.column("extra")), np.uint8).reshape(-1, width)
            second = np.pad(raw, ((0, 0), (0, 8 - width))).view("<u8").ravel()
        # RANKS bounds their number.
        order = hash_order(first) if second is None else np.lexsort((np.arange(len(first)), second, first)).astype(np.int32)
        a = first[order]
        same = a[1:] == a[:-1]
        if second is not None:
            same &= second[order][1:] == second[order][:-1]
        del a, first, second
        flags = np.zeros(len(order), np.uint8)
        ranks = None
        run_of = np.zeros(len(order), np.int32)
        np.cumsum(~same, out=run_of[1:])
        if rule == "later":
            place = np.repeat(table.column("grp").to_numpy() // PER_RANGE, sizes)[order]
            flags[order] = place > place[np.flatnonzero(np.append(True, ~same))][run_of]
        else:
            counts = np.frombuffer(b"".join(zstandard.decompress(c.as_py()) for c in table.column("counts")), np.uint8)
            total = np.bincount(run_of, counts[order]).astype(np.int64)
            rank = np.cumsum(total > 1) - 1
            flags[order] = np.where(total > 1, np.minimum(total, 255), 0)[run_of]
            ranks = np.empty(len(order), np.uint64)
            ranks[order] = rank[run_of].astype(np.uint64)
        rows = [], [], [], []
        at = 0
        for group, bucket, n in zip(table.column("grp").to_pylist(), table.column("bucket").to_pylist(), sizes.tolist(), strict=True):
            own = flags[at : at + n]
            if own.any():
                data = np.packbits(own).tobytes() if rule == "later" else own.tobytes()
                places = squeeze(ranks[at : at + n][own > 0]) if ranks is not None else b""
                for column, value in zip(rows, (group, bucket, zstandard.compress(data, 1), places), strict=True):
                    column.append(value)
            at += n
        del order, flags, ranks, run_of
        trim()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, REPLY_SCHEMA, strict=True)], schema=REPLY_SCHEMA)

    return run


def flags_of(distinct: Distinct, replies: pa.Table, buckets: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The replies to one group as arrays over its distinct hashes: flags, and ids (0 where there is no flag)."""
    bucket = bucket_of(distinct.hashes, buckets)
    out, ids = np.zeros(len(bucket), np.uint8), np.zeros(len(bucket) if rule == "shared" else 0, np.uint64)
    for b, flags, ranks in zip(replies.column("bucket").to_pylist(), replies.column("flags"), replies.column("ranks"), strict=True):
        low, high = np.searchsorted(bucket, [b, b + 1])
        data = np.frombuffer(zstandard.decompress(flags.as_py()), np.uint8)
        out[low:high] = np.unpackbits(data, count=high - low) if rule == "later" else data
        if rule == "shared":
            at = low + np.flatnonzero(data)
            ids[at] = unsqueeze(ranks.as_py(), len(at)) + np.uint64(b * RANKS)
    return out, ids


Windows = Callable[[pa.Table, bool], tuple[np.ndarray, np.ndarray | None, np.ndarray]]


def exchange(packs: DataFrame, windows: Windows, per_hash: Callable[[Distinct, np.ndarray], np.ndarray], finish: Callable[[pa.Table, Distinct, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: T.StructType | str, rule: str, n_windows: int) -> DataFrame:
    """Run one round: ``windows`` gives a group's hashes, second hashes (if asked) and a value (the row) each;
    ``per_hash`` the count to send for each distinct hash; ``finish`` the group's result from what came back.
    """
    buckets, width = bucket_count(n_windows), hash_width(n_windows)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        lean()
        first, second, value = windows(group_table(table), width > 0)
        distinct = Distinct(first, second)
        del first, second
        out = pa.Table.from_batches([blobs(key[0].as_py(), distinct, per_hash(distinct, value), buckets, width)])
        del distinct, value
        trim()
        return out

    def close(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        lean()
        rows = group_table(table)
        first, second, value = windows(rows, width > 0)
        distinct = Distinct(first, second)
        del first, second
        out = finish(rows, distinct, value, *flags_of(distinct, replies, buckets, rule))
        del rows, distinct, value
        trim()
        return out

    sent = packs.groupBy("grp").applyInArrow(send, BLOB)
    replies = sent.groupBy("bucket").applyInArrow(_meet(rule, width), REPLY)
    return packs.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(close, schema)
