import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from siltstone.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
FITS = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        left = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit, turns) by recursion over rows and the role initials so far, without states or tensors."""
    wrong = faults(rows)

    def after(initials):
        return "user" if initials[-1:] in ("", "s", "a") else "assistant"

    memo = {}

    def best(i, last, first, budget):
        """``last`` and ``first``: the last role initial, and whether there is none yet."""
        key = (i, last, budget)
        if key not in memo:
            options = []
            if i == len(rows) and last in ("", "a"):
                options.append((0, "", ()))
            if budget:
                role = after(last)
                c, a, o = best(i, role[0], False, budget - 1)
                options.append((c + 3, "I" + a, ((role, ""), *o)))
            if i < len(rows):
                role, text = rows[i]
                c, a, o = best(i + 1, last, first, 2)
                options.append((c + 4, "D" + a, o))
                if wrong[i] in ("", "truncated"):
                    extra = 3 if wrong[i] else 0
                    for keep, new in ((True, role), (False, after(last))):
                        start = new[:1]
                        if keep and not (start == "s" and last == "" or start == "u" and last in ("", "s", "a") or start == "a" and last == "u"):
                            continue
                        c, a, o = best(i + 1, start, False, 2)
                        options.append((c + extra + (0 if keep else 3), ("K" if keep else "R") + a, ((new, text), *o)))
            memo[key] = min(options, default=(10**9, "", ()))
        return memo[key]

    return best(0, "", True, 2)


def expected(conversations):
    """The contract, row by row."""
    groups = {}
    for conv, turn, role, text in conversations:
        groups.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            row = ((turn is not None, turn or 0), hashlib.sha256(f"{len(role if kind != 4 else 'user')}:{'user' if kind == 4 else role}{text}".encode()).digest(), "user" if kind == 4 else role, text)
            groups[conv] += [row] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows = sorted(rows)
        turns = [r[0][1] for r in rows if r[0][0]]
        said = [r[2:] for r in rows]
        wrong = faults(said)
        cost, audit, turned = cheapest(said)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turned).encode()).hexdigest()
        assert FITS.fullmatch("".join(r[0] for r, _ in turned))
        out[conv] = (gaps, *(wrong.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_conversation_repair(spark, str(tmp_path)).collect()
    out = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got}
    assert len(out) == len(got)
    return out


def random_rows(seed, conversations, longest):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "s", "a"]
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "Done. \n", "x.", "é…", "Also this?"]
    rows = []
    for c in range(conversations):
        for k in range(r.randint(0, longest)):
            rows.append((c if c else None, r.choice([k, k, k, k + r.randint(0, 3), None]), r.choice(roles), r.choice(texts)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece", [512, 3])
def test_against_recursion(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = random_rows(3, 120, 9) + [(999, k, "user", "Hm.") for k in range(40)]
    assert run(spark, rows, tmp_path) == expected(rows)


@pytest.mark.parametrize("seed", range(6))
def test_pieces_do_not_matter(seed, monkeypatch):
    r = np.random.default_rng(seed)
    sizes = r.integers(0, 60, 40)
    codes = r.integers(0, 16, int(sizes.sum())).astype(np.uint8)
    whole = repair.solve(codes, sizes)
    for piece in (1, 2, 7):
        monkeypatch.setattr(repair, "PIECE", piece)
        cost, edits = repair.solve(codes, sizes)
        assert (cost == whole[0]).all() and edits == whole[1]


def test_very_long_conversation():
    codes = np.tile(np.array([0, 0, 1, 12, 4], np.uint8), 200_000)
    cost, edits = repair.solve(codes, np.array([len(codes)]))
    assert edits[0].count(b"D") >= 200_000 and cost[0] > 0
    assert len(edits[0]) - edits[0].count(b"I") == len(codes)


def test_repaired_turns_and_long_texts(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "word " * 200_000 + "end."), (1, 2, "user", "Hello?"), (2, 0, "assistant", "Hi."), (3, 0, "x", "y")]
    table = spark.createDataFrame(rows, SCHEMA)
    found = repair.report(table)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in found.collect()} == {c: cheapest([x[2:] for x in rows if x[0] == c])[:2] for c in (1, 2, 3)}
    turns = repair.repaired(table, found).collect()
    for c in (1, 2, 3):
        assert tuple((r["role"], r["text"]) for r in sorted((t for t in turns if t["conv_id"] == c), key=lambda t: t["place"])) == cheapest([x[2:] for x in rows if x[0] == c])[2]


def test_empty_table_and_other_columns(spark, tmp_path):
    assert run(spark, [], tmp_path) == {}
    odd = spark.createDataFrame([("a", 1, "user", "Hi.", 5, "x"), (None, None, None, None, None, None)], "conv_id string, turn int, role string, text string, cost int, place string")
    got = {r["conv_id"]: (r["blank"], r["cost"], r["audit"]) for r in repair.report(odd).collect()}
    assert got == {"a": (0, 3, "KI"), None: (1, 4, "D")}


def test_many_conversations_of_unlike_lengths(spark, monkeypatch):
    monkeypatch.setattr(repair, "TOGETHER", 50)
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for c in range(60) for k in range(1 + c * c % 37)]
    got = {r["conv_id"]: r for r in repair.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c in range(60):
        n = 1 + c * c % 37
        assert (got[c]["cost"], got[c]["audit"]) == (3 * (n % 2), "K" * n + "I" * (n % 2)) and got[c]["illegal"] == got[c]["gaps"] == 0
