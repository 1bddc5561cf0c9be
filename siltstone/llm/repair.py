"""Conversation structure repair: the cheapest edits that make turns a proper dialogue.

Every row of a conversation may be kept (only if its role fits, 3 more if its text is cut off), given
the role user or assistant (3, and 3 more if cut off) or deleted (4; the only way for blank and repeated
rows); empty turns of user or assistant may be inserted anywhere (3). The initials of the roles must then
read ``(s?(ua)+)?``. Four states say what the last turn was: none, system, user, assistant.

The rows of a conversation, in order, become one byte each: what their role is and what is wrong
with them. Conversations are cut into pieces of up to PIECE rows, pieces of about the same length
make a time-major NumPy tensor, and one step a row updates the costs of all states of all pieces
backwards. The backward costs are kept, and the edits of all pieces are traced forwards over them, one
step a row again. Where a conversation has several pieces, the costs from each state to each state
of a piece come first; they are combined over the pieces, which gives every piece the costs behind it and
the state before it, so a conversation of millions of turns costs no more a turn than a short one.

Texts take no part in that. They meet their edits in a second sorted stream, row by row. No task holds
more of a conversation than some bytes a row, although the rows of one conversation pass through one
task, as a hash of its repaired text has to be taken in order.

Defined cases: null roles and texts become one space; rows without a turn come first; rows of one
turn are ordered by the SHA-256 of role and text; repeated rows count as repeated; rows with a null
conversation id form one conversation; roles other than those starting with s, u and a, the empty one
included, cannot be kept; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.textbytes import lean, trim
from siltstone.runtime import partitions_for, small_batches, stage_table

#: Rows of a piece of a conversation, and rows that are solved together.
PIECE, TOGETHER = 512, 1 << 16
#: What a turn was, or would be: the next turn's role leads from each state to FOLLOW, by a user or (from user) an assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
FOLLOW = np.array([USER, USER, ASSISTANT, USER])
#: Costs of the edits, and of what cannot be.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
NEVER = 1 << 40
#: A row's byte: its role in the two low bits, then its fault from bit FAULT on; END and PAD are no rows.
LIKE_USER, LIKE_ASSISTANT, LIKE_SYSTEM, OTHER = range(4)
FAULT, BLANK, DUPLICATE, TRUNCATED, END, PAD = 2, 1, 2, 3, 16, 17
#: White space, as in the definition of words.
SPACES = " \t\n\x0b\x0c\r"

REPORT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "conv_id {id}, place long, role string, text string, edit string"
ROLES = {USER: "user", ASSISTANT: "assistant"}


# --- costs and edits of all pieces at once -------------------------------------------------


def _steps(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of keeping (by state), giving a role, and deleting, for every row of ``codes`` (time, piece)."""
    role, fault = codes & 3, (codes >> FAULT) & 3
    row = codes < END
    bad = (fault == BLANK) | (fault == DUPLICATE)
    extra = np.where(fault == TRUNCATED, CUT_OFF, 0)
    keep = np.full((*codes.shape, 4), NEVER, np.int64)
    for state in range(4):
        fits = (role == LIKE_USER) & (FOLLOW[state] == USER) | (role == LIKE_ASSISTANT) & (state == USER) | (role == LIKE_SYSTEM) & (state == NONE)
        keep[..., state] = np.where(row & ~bad & fits, extra, NEVER)
    rerole = np.where(row & ~bad, REROLE + extra, NEVER)
    drop = np.where(row, DELETE, 0)[..., None] + np.zeros(4, np.int64)
    drop[codes == END] = np.array([0, NEVER, NEVER, 0])
    return keep, rerole, drop


def _kept_state(role: np.ndarray) -> np.ndarray:
    """The state after a kept row."""
    return np.array([USER, ASSISTANT, SYSTEM, NONE])[role]


def backward(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs (time + 1, piece, state) from before each row to behind the last, where ``ends`` are due."""
    time, n = codes.shape
    keep, rerole, drop = _steps(codes)
    costs = np.empty((time + 1, n, 4), np.int64)
    costs[time] = ends
    pad = (codes == PAD)[..., None]
    for t in range(time - 1, -1, -1):
        after = costs[t + 1]
        kept = np.take_along_axis(after, _kept_state(codes[t] & 3)[:, None], 1)
        stay = np.minimum(drop[t] + after, np.minimum(keep[t] + kept, rerole[t][:, None] + after[:, FOLLOW]))
        once = np.minimum(stay, INSERT + stay[:, FOLLOW])
        costs[t] = np.minimum(np.where(pad[t], stay, np.minimum(once, INSERT + once[:, FOLLOW])), NEVER)
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edits (piece, time, 3) as ASCII codes, 0 for none, and the state behind each piece.

    Of the edits that lead to the least costs the one with the least initial is taken: D, I, K, R.
    """
    time, n = codes.shape
    keep, rerole, drop = _steps(codes)
    edits = np.zeros((n, time, 3), np.uint8)
    state, lane = state.copy(), np.arange(n)
    for t in range(time):
        after, row, open_ = costs[t + 1], codes[t] < END, codes[t] != PAD
        kept = _kept_state(codes[t] & 3)
        for k in range(3):
            due = costs[t][lane, state]
            follow = FOLLOW[state]
            dropped = open_ & (drop[t][lane, state] + after[lane, state] == due)
            inserted = open_ & ~dropped & (INSERT + costs[t][lane, follow] == due)
            held = open_ & ~dropped & ~inserted & (keep[t][lane, state] + after[lane, kept] == due)
            given = open_ & ~dropped & ~inserted & ~held
            edits[:, t, k] = np.select([dropped & row, inserted, held, given], [ord("D"), ord("I"), ord("K"), ord("R")], 0)
            state = np.select([inserted | given, held], [follow, kept], state)
            open_ = inserted
    return edits, state


def _tensor(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces as columns (time, piece); short ones begin with PAD."""
    out = np.full((int(sizes.max()), len(sizes)), PAD, np.uint8)
    k = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[inside + (len(out) - sizes)[k], k] = codes[np.repeat(starts, sizes) + inside]
    return out


def _buckets(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of about the same length, so that less than half of a tensor is PAD; bounded in rows."""
    order = np.argsort(sizes, kind="stable")
    first = 0
    while first < len(order):
        small = int(sizes[order[first]])
        last = int(np.searchsorted(sizes[order], 2 * small + 2, side="left"))
        last = min(last, first + max(1, TOGETHER // (2 * small + 2)))
        yield order[first:last]
        first = last


def solve(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Least cost and edits of conversations, given by their rows' codes one after the other and their sizes."""
    n = len(sizes)
    whole = np.insert(codes, np.cumsum(sizes), END) if n else codes
    sizes = sizes + 1
    first = np.cumsum(sizes) - sizes
    parts = -(-sizes // PIECE)
    owner = np.repeat(np.arange(n), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[owner] + number * PIECE
    size = np.minimum(PIECE, first[owner] + sizes[owner] - start)
    ends = np.zeros((len(owner), 4), np.int64)
    before = np.zeros(len(owner), np.int64)
    many = np.flatnonzero(parts[owner] > 1)
    if len(many):
        _join_pieces(whole, many, owner, start, size, ends, before)
    cost, edits = np.zeros(n, np.int64), [b""] * len(owner)
    for chosen in _buckets(size):
        tensor = _tensor(whole, start[chosen], size[chosen])
        costs = backward(tensor, ends[chosen])
        got, _ = trace(tensor, costs, before[chosen])
        flat = got.reshape(len(chosen), -1)
        used = flat > 0
        text, cuts = flat[used].tobytes(), np.concatenate([[0], np.cumsum(used.sum(1))])
        for k, piece in enumerate(chosen.tolist()):
            edits[piece] = text[cuts[k] : cuts[k + 1]]
        top = number[chosen] == 0
        cost[owner[chosen[top]]] = costs[0][top, NONE]
    bounds = np.concatenate([[0], np.cumsum(parts)]).tolist()
    return cost, [edits[i] if j == i + 1 else b"".join(edits[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def _join_pieces(whole: np.ndarray, many: np.ndarray, owner: np.ndarray, start: np.ndarray, size: np.ndarray, ends: np.ndarray, before: np.ndarray) -> None:
    """Fill in what is due behind each piece of a cut conversation and the state before it."""
    across = np.empty((len(owner), 4, 4), np.int64)
    goals = np.where(np.eye(4, dtype=bool), 0, NEVER)
    step = max(1, TOGETHER // (4 * PIECE))
    for k in range(0, len(many), step):
        chosen = many[k : k + step]
        tensor = np.repeat(_tensor(whole, start[chosen], size[chosen]), 4, axis=1)
        across[chosen] = backward(tensor, np.tile(goals, (len(chosen), 1)))[0].reshape(-1, 4, 4).transpose(0, 2, 1)
    for k in many[::-1].tolist():
        if k + 1 < len(owner) and owner[k + 1] == owner[k]:
            ends[k] = (across[k + 1] + ends[k + 1]).min(1)
    leads = np.empty((len(owner), 4), np.int64)
    for k in range(0, len(many), step):
        chosen = many[k : k + step]
        tensor = np.repeat(_tensor(whole, start[chosen], size[chosen]), 4, axis=1)
        costs = backward(tensor, np.repeat(ends[chosen], 4, axis=0))
        leads[chosen] = trace(tensor, costs, np.tile(np.arange(4), len(chosen)))[1].reshape(-1, 4)
    for k in many.tolist():
        if k and owner[k - 1] == owner[k]:
            before[k] = leads[k - 1][before[k - 1]]


# --- rows to codes, edits to rows ----------------------------------------------------------


def _prepared(rows: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


def _code() -> Column:
    """The byte of a row, but for repeats."""
    start = F.left("role", F.lit(1))
    role = F.when(start == "u", LIKE_USER).when(start == "a", LIKE_ASSISTANT).when(start == "s", LIKE_SYSTEM).otherwise(OTHER)
    left = F.rtrim("text", F.lit(SPACES))
    fault = F.when(left == "", BLANK).when(~F.right(left, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return role + fault * (1 << FAULT)


def _changes(column: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Whether each value differs from the one before it, nulls being equal; the first is compared with ``last``."""
    shifted = pa.concat_arrays([pa.array([None if last is None else last.as_py()], column.type), column.slice(0, len(column) - 1)])
    differs = pc.fill_null(pc.not_equal(column, shifted), True)
    both = pc.and_(pc.is_null(column), pc.is_null(shifted))
    out = pc.and_not(differs, both).to_numpy(zero_copy_only=False).copy()
    if last is None:
        out[:1] = True
    return out


def _report(ids: list, codes: np.ndarray, turns: np.ndarray, known: np.ndarray, starts: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """What is wrong in each whole conversation, and its edits."""
    sizes = np.diff(np.append(starts, len(codes)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    fault = (codes >> FAULT) & 3
    counts = [np.bincount(owner, fault == k, len(sizes)).astype(np.int64) for k in (BLANK, DUPLICATE, TRUNCATED)]
    same = owner[1:] == owner[:-1]
    pair = (codes[:-1] & 3) * 4 + (codes[1:] & 3)
    illegal = np.bincount(owner[1:], same & ~np.isin(pair, [4 * LIKE_SYSTEM + LIKE_USER, 4 * LIKE_USER + LIKE_ASSISTANT, 4 * LIKE_ASSISTANT + LIKE_USER]), len(sizes)).astype(np.int64)
    # Rows without a turn come first, so the known turns of a conversation are its end, in order.
    at = np.flatnonzero(known)
    first = np.searchsorted(at, starts)
    stop = np.searchsorted(at, np.append(starts[1:], len(codes)))
    new = np.concatenate([[0], np.cumsum(np.append(True, turns[at][1:] != turns[at][:-1])[: len(at)])])
    some = stop > first
    low, high = at[np.minimum(first, len(at) - 1)] if len(at) else starts, at[stop - 1] if len(at) else starts
    distinct = new[stop] - new[np.minimum(first + 1, len(new) - 1)] + 1
    gaps = np.where(some, turns[high] - turns[low] + 1 - distinct, 0)
    cost, edits = solve(codes, sizes)
    columns = [pa.array(ids, schema.field("conv_id").type), *(pa.array(x, pa.int64()) for x in (gaps, *counts, illegal, cost)), pa.array([e.decode() for e in edits], pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _reports(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        last, open_id = None, None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        begun: list[tuple[object, int]] = []
        rows = 0

        def flush(finished: int) -> Iterator[pa.RecordBatch]:
            """Solve the conversations that began before place ``finished``; the rows behind it stay."""
            nonlocal held, begun, rows
            codes, turns, known = (np.concatenate([h[k] for h in held]) for k in range(3))
            done = [b for b in begun if b[1] < finished]
            if done:
                yield _report([b[0] for b in done], codes[:finished], turns[:finished], known[:finished], np.array([b[1] for b in done]), schema)
            held = [(codes[finished:], turns[finished:], known[finished:])]
            begun = [(i, at - finished) for i, at in begun if at >= finished]
            rows -= finished

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("conv_id")
            new = np.flatnonzero(_changes(column, last))
            begun += [(column[k].as_py(), rows + k) for k in new.tolist()]
            turn = batch.column("turn")
            held.append((batch.column("code").to_numpy().astype(np.uint8), turn.fill_null(0).to_numpy(), turn.is_valid().to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            last = column[batch.num_rows - 1]
            if rows >= TOGETHER and begun[-1][1] > 0:
                yield from flush(begun[-1][1])
        if rows:
            yield from flush(rows)
        trim()

    return run


def _arrow(ddl: str, rows: DataFrame) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = ddl.format(id=rows.schema["conv_id"].dataType.simpleString())
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def _dealt(rows: DataFrame, like: DataFrame, *order: str) -> DataFrame:
    return rows.repartition(partitions_for(like), "conv_id").sortWithinPartitions("conv_id", *order)


def report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    ``audit`` has the initials of the cheapest edits in order; of equally cheap ones the least text.
    """
    small_batches(conversations.sparkSession)
    ddl, schema = _arrow(REPORT, conversations)
    small = _prepared(conversations).select("conv_id", "turn", "digest", _code().alias("code")).repartition(partitions_for(conversations), "conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.shiftright("code", FAULT)
    code = F.when(again & (fault != BLANK), F.col("code").bitwiseAND(3) + DUPLICATE * (1 << FAULT)).otherwise(F.col("code"))
    coded = small.withColumn("code", code.cast("int")).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
    return coded.select("conv_id", "turn", "code").mapInArrow(_reports(schema), ddl)


def _edited(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        ids, places, roles, texts, edits = [], [], [], [], []
        audit, at, place, state = "", 0, 0, NONE

        def put(conv, role, text, edit):
            nonlocal place
            place += 1
            for column, value in zip((ids, places, roles, texts, edits), (conv, place, role, text, edit), strict=True):
                column.append(value)

        def inserts(conv):
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = int(FOLLOW[state])
                put(conv, ROLES[state], "", "I")
                at += 1

        conv = None
        for batch in batches:
            for conv_now, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
                if head is not None:
                    inserts(conv)
                    conv, audit, at, place, state = conv_now, head, 0, 0, NONE
                    continue
                inserts(conv)
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                    put(conv, role, text, "K")
                elif edit == "R":
                    state = int(FOLLOW[state])
                    put(conv, ROLES[state], text, "R")
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, places, roles, texts, edits), schema, strict=True)], schema=schema)
            ids, places, roles, texts, edits = [], [], [], [], []
        inserts(conv)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, places, roles, texts, edits), schema, strict=True)], schema=schema)
        trim()

    return run


def repaired(conversations: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of the turns of all repaired conversations, in order within partitions.

    ``reports`` is what ``report`` gives for the same rows; its audits travel ahead of their rows.
    """
    small_batches(conversations.sparkSession)
    ddl, schema = _arrow(TURNS, conversations)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("digest", "binary"), ("role", "string"), ("text", "string"))]
    heads = reports.select("conv_id", F.lit(0).alias("body"), "audit", *none)
    rows = _prepared(conversations).select("conv_id", F.lit(1).alias("body"), F.lit(None).cast("string").alias("audit"), "turn", "digest", "role", "text")
    together = heads.unionByName(rows).repartition(partitions_for(conversations), "conv_id")
    ordered = together.sortWithinPartitions("conv_id", "body", F.col("turn").asc_nulls_first(), "digest")
    return ordered.select("conv_id", "audit", "role", "text").mapInArrow(_edited(schema), ddl)


def _hashed(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, last = None, None
        for batch in batches:
            ids, out = [], []
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 1:
                    if sha is not None:
                        ids.append(last)
                        out.append(sha.hexdigest())
                    sha, last = hashlib.sha256(), conv
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(out, pa.string())], schema=schema)
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], schema.field(0).type), pa.array([sha.hexdigest()], pa.string())], schema=schema)

    return run


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of what ``repaired`` gives; conversations without a turn are missing."""
    ddl, schema = _arrow("conv_id {id}, repaired_sha256 string", turns)
    return turns.mapInArrow(_hashed(schema), ddl)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults of the production query, chosen by the CRC-32 of conversation and turn."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(F.encode(name, "utf-8")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.where(kind != 0).withColumn("copies", F.when(kind == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Damage, report and repair of every conversation of ``conversations``."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = damaged(conversations)
    reports = stage_table(report(rows), "reports")
    hashes = digests(repaired(rows, reports))
    found = reports.alias("r").join(hashes.alias("h"), F.col("r.conv_id").eqNullSafe(F.col("h.conv_id")), "left").select("r.*", "repaired_sha256")
    ids = conversations.select("conv_id").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.alias("i").join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left").select(
        "i.conv_id", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([n], range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) AS b(n)),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: CAST(ord(name[i]) AS BIGINT))),
                            lambda c, x: xor(c >> 8, crc.t[1 + (xor(c, x) & 255)])), 4294967295) % 20 AS kind FROM named, crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i FROM hurt),
judged AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN rtrim(text, E' \t\n\x0b\f\r') = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(rtrim(text, E' \t\n\x0b\f\r'), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
behind(conv_id, i, c0, a0, o0, c1, a1, o1, c2, a2, o2, c3, a3, o3) AS (
  SELECT conv_id, n + 1, 0::BIGINT, '', '', 6::BIGINT, 'II', E'\nuser:\nassistant:', 3::BIGINT, 'I', E'\nassistant:', 0::BIGINT, '', '' FROM counted
  UNION ALL
  SELECT conv_id, i, z0.c, z0.a, z0.o, z1.c, z1.a, z1.o, z2.c, z2.a, z2.o, z3.c, z3.a, z3.o FROM (
    SELECT conv_id, i,
      least(y0, {'c': y2.c + 3, 'a': 'I' || y2.a, 'o': E'\nuser:' || y2.o}, {'c': y3.c + 6, 'a': 'II' || y3.a, 'o': E'\nuser:\nassistant:' || y3.o}) AS z0,
      least(y1, {'c': y2.c + 3, 'a': 'I' || y2.a, 'o': E'\nuser:' || y2.o}, {'c': y3.c + 6, 'a': 'II' || y3.a, 'o': E'\nuser:\nassistant:' || y3.o}) AS z1,
      least(y2, {'c': y3.c + 3, 'a': 'I' || y3.a, 'o': E'\nassistant:' || y3.o}) AS z2,
      least(y3, {'c': y2.c + 3, 'a': 'I' || y2.a, 'o': E'\nuser:' || y2.o}) AS z3
    FROM (
      SELECT conv_id, i,
        least({'c': c0 + 4, 'a': 'D' || a0, 'o': o0}, {'c': c2 + r, 'a': 'R' || a2, 'o': E'\nuser:' || text || o2},
              CASE initial WHEN 'u' THEN {'c': c2 + k, 'a': 'K' || a2, 'o': own || o2} WHEN 's' THEN {'c': c1 + k, 'a': 'K' || a1, 'o': own || o1} END) AS y0,
        least({'c': c1 + 4, 'a': 'D' || a1, 'o': o1}, {'c': c2 + r, 'a': 'R' || a2, 'o': E'\nuser:' || text || o2}, CASE initial WHEN 'u' THEN {'c': c2 + k, 'a': 'K' || a2, 'o': own || o2} END) AS y1,
        least({'c': c2 + 4, 'a': 'D' || a2, 'o': o2}, {'c': c3 + r, 'a': 'R' || a3, 'o': E'\nassistant:' || text || o3}, CASE initial WHEN 'a' THEN {'c': c3 + k, 'a': 'K' || a3, 'o': own || o3} END) AS y2,
        least({'c': c3 + 4, 'a': 'D' || a3, 'o': o3}, {'c': c2 + r, 'a': 'R' || a2, 'o': E'\nuser:' || text || o2}, CASE initial WHEN 'u' THEN {'c': c2 + k, 'a': 'K' || a2, 'o': own || o2} END) AS y3
      FROM (
        SELECT b.*, j.i AS at, j.text, j.initial, E'\n' || j.role || ':' || j.text AS own,
               CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 3 ELSE 1000000000 END AS k, CASE fault WHEN '' THEN 3 WHEN 'truncated' THEN 6 ELSE 1000000000 END AS r
        FROM behind b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i - 1) AS s(conv_id, j, c0, a0, o0, c1, a1, o1, c2, a2, o2, c3, a3, o3, i, text, initial, own, k, r)) AS y) AS z),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(c0, 0)::BIGINT AS cost, coalesce(a0, '') AS audit, sha256(coalesce(substr(o0, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN behind ON behind.conv_id IS NOT DISTINCT FROM ids.conv_id AND behind.i = 1
"""
