import hashlib
import random

from pyspark.sql import functions as F

from siltstone.llm import fingerprints as f

COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
SPACES = " \t\n\x0b\x0c\r"


def sketch(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in SPACES:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    every = sorted({hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(words) - 4))}) if words else []
    below = [h for h in every if h[0] == "0"]
    if len(below) >= 32:
        return "0" + "f" * 15, below
    return ("f" * 16, every) if len(every) <= 32 else (every[31], every[:32])


def near(a, b):
    limit = min(a[0], b[0])
    x, y = {h for h in a[1] if h <= limit}, {h for h in b[1] if h <= limit}
    return 1.0 if not a[1] and not b[1] else 0.0 if not x or not y else len(x & y) / min(len(x), len(y))


def shown(s):
    return s[0] + ":" + ",".join(s[1])


def expected(rows):
    def order(r):
        return (r[0] is not None, r[0] or 0, hashlib.sha256(f"{'-' if r[0] is None else r[0]}:{r[1] or ''}".encode()).digest())

    rows, out = sorted(rows, key=order, reverse=True), []
    for k, (doc, text, *_) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new = sketch(text), sketch(edited)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(new), near(own, new), near(own, sketch(after))))
    return out


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in row)


def run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r[c] for c in COLUMNS) for r in f.op13_document_fingerprints(spark, str(tmp_path)).collect()]


def test_against_plain_python(spark, tmp_path, odd_docs):
    rows = [tuple(r) for r in odd_docs.collect()]
    assert sorted(run(spark, odd_docs, tmp_path), key=key) == sorted(expected(rows), key=key)


def test_copies_and_short_texts(spark, tmp_path):
    r = random.Random(4)
    texts = ["", " ", "a", "é" * 7, "a b c d e", "A B\tc d  E f", *(" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 900))) for _ in range(30))]
    rows = [(r.randint(0, 12), r.choice(texts)) for _ in range(80)] + [(3, "again and again")] * 40
    got = run(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_one_row_and_none(spark, tmp_path):
    got = run(spark, spark.createDataFrame([(5, "only one here")], "doc_id long, text string"), tmp_path / "a")
    assert got == expected([(5, "only one here")]) and got[0][-1] == 1.0
    assert run(spark, spark.createDataFrame([], "doc_id long, text string"), tmp_path / "b") == []


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(k, f"text {k}") for k in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = f.op13_document_fingerprints(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan and "BroadcastNestedLoop" not in plan


def test_containment_of_unequal_texts(spark):
    r = random.Random(9)
    part = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(3000))
    whole = part + " " + " ".join(f"v{r.randint(0, 10**6)}" for _ in range(60_000))
    rows = f.with_sketch(f.with_sketch(spark.createDataFrame([(part, whole)], "a string, b string"), "a", "sa"), "b", "sb")
    got = rows.select(f.containment(F.col("sa"), F.col("sb")), f.containment(F.col("sb"), F.col("sa")), f.likeness(F.col("sa"), F.col("sb")), F.size("sa.hashes"), F.size("sb.hashes")).first()
    assert got[0] == 1.0 and got[2] == 1.0 and 0.02 < got[1] < 0.08 and 130 < got[3] < 250 and 3500 < got[4] < 4400


def test_merge_and_parse(spark):
    r = random.Random(2)
    a, b = (" ".join(f"{c}{r.randint(0, 10**6)}" for _ in range(n)) for c, n in (("x", 5000), ("y", 700)))
    rows = f.with_sketch(f.with_sketch(spark.createDataFrame([(a, b)], "a string, b string"), "a", "sa"), "b", "sb")
    rows = rows.withColumn("back", f.parsed(f.fingerprint("sa"))).withColumn("both", f.merged(F.col("sa"), F.col("sb")))
    got = rows.first()
    assert got["back"] == got["sa"] and got["both"]["limit"] == f.FRACTION
    assert got["both"]["hashes"] == sorted(sketch(a)[1] + [h for h in sketch(b)[1] if h <= f.FRACTION])


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([("some text", 1, "old", None), (None, 2, None, 7)], "text string, _all int, fingerprint string, limit int")
    got = {r["_all"]: r for r in f.with_fingerprint(docs).collect()}
    assert got[1]["fingerprint"] == shown(sketch("some text")) and got[2]["fingerprint"] == shown(sketch("")) and got[2]["limit"] == 7 and got[1]["text"] == "some text"
