import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.functions import vectors as vx


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_words(spark):
    assert one(spark, tx.words(F.col("t")), t="Create_token, می‌شود x1") == ["create_token", "می", "شود", "x1"]
    assert one(spark, tx.normalise(F.col("t")), t=" ي ك‌  Test ") == "ی ک test"
    assert one(spark, tx.identifier_terms(F.col("t")), t="OpenAICompatibleLLMProvider") == ["openaicompatiblellmprovider", "open", "ai", "compatible", "llm", "provider"]
    assert one(spark, tx.identifier_parts(F.col("t")), t="get_userName id") == ["get", "user", "name"]
    assert one(spark, tx.backtick_identifiers(F.col("t")), t="`foo_bar()` `abc` `self` and `foo_bar`") == ["foo_bar"]


def test_predicates(spark):
    assert one(spark, tx.is_refusal(F.col("t")), t="There is not enough retrieved evidence.")
    assert one(spark, tx.is_hedged(F.col("t")), t="It may work.") and not one(spark, tx.is_hedged(F.col("t")), t="It works.")
    assert one(spark, tx.mentions(F.col("t"), F.col("n")), t="see a.RUN now", n="A.run") and not one(spark, tx.mentions(F.col("t"), F.col("n")), t="xa.run", n="a.run")
    assert not one(spark, tx.mentions(F.col("t"), F.col("n"), True), t="run.it", n="run")
    assert one(spark, tx.in_arabic_script(F.array(F.col("t"))), t="سلام") and not one(spark, tx.in_arabic_script(F.array(F.col("t"))), t="hi")


def test_strings(spark):
    assert one(spark, tx.short_symbol(F.col("t")), t="a.b.c") == "c" and one(spark, tx.class_root(F.col("t")), t="a.b.c") == "a"
    assert one(spark, tx.strip_citations(F.col("t")), t="It is (src/a.py:1-2) so b.py:3.") == "It is so."
    assert one(spark, tx.clean_answer(F.col("t")), t="```py\nAnswer: One. Two! [S1] Three.\n```").startswith("Answer") is False
    assert one(spark, tx.fenced_json(F.col("t")), t='```json\n{"a":1}\n```') == '{"a":1}' and one(spark, tx.fenced_json(F.col("t")), t="```a``` ```b```") is None
    assert one(spark, tx.normal_path(F.col("t")), t="/a\\b") == "a/b" and one(spark, tx.is_absolute(F.col("t")), t="C:\\x")
    assert one(spark, tx.signature(F.col("t"), F.array(F.lit("a"), F.lit("*b")), F.lit("int"), F.lit(True)), t="f") == "async def f(a, *b) -> int"
    assert one(spark, tx.error_category(F.col("t")), t="Request timed out") == "timeout"
    short = one(spark, tx.sub_queries(F.col("t")), t="what and why")
    assert short == ["what and why"]
    long = "how does the scanner find the files in a repository and where are the parsed symbols stored while the indexing job is still running here"
    assert one(spark, tx.sub_queries(F.col("t")), t=long)[0].startswith("how does") and len(one(spark, tx.sub_queries(F.col("t")), t=long)) == 3


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, vx.cosine(a, b), t=1) == pytest.approx(0.96) and one(spark, vx.norm(a), t=1) == 5 and one(spark, vx.normalised(a), t=1) == [0.6, 0.8]
    assert one(spark, vx.is_valid(F.array(F.lit(float("nan")))), t=1) is False and one(spark, vx.is_valid(a, 2), t=1) is True
    assert one(spark, vx.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), t=1) is None


def test_whole_texts(spark, tmp_path):
    from siltstone.plans import registry

    name = "package.module_with_a_long_name.Class.method_behind_the_twelfth_character"
    spark.createDataFrame([(1, name), (2, "plain"), (3, None), (4, "ends.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "<html><body><p>a<b>b</b></p><div id=x></div>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["doc_id"]: (r["short"], r["root"]) for r in registry.queries()["short_symbol_and_root"](spark, str(tmp_path)).collect()}
    assert got == {1: ("method_behind_the_twelfth_character", "package"), 2: ("plain", "plain"), 3: (None, None), 4: ("", "ends")}
    assert registry.queries()["markup_tokens_full"](spark, str(tmp_path)).first()["tags"] == ["html", "body", "p", "b", "div"]


def test_mentions_beside_other_scripts(spark):
    rows = [("تابعfoo چیست", "foo", False), ("تابع foo چیست", "foo", True), ("foo؟", "foo", True), ("x.foo", "foo", False), ("FOO bar", "foo", True), ("کلاسÉa", "éa", False), ("Éa", "éa", True), ("a.b(c)", "a.b", True)]
    got = spark.createDataFrame(rows, "q string, n string, want boolean").select("want", tx.mentions(F.col("q"), F.col("n")).alias("is")).collect()
    assert all(r["is"] == r["want"] for r in got)
    assert spark.createDataFrame([("see foo. now", "foo"), ("see foo now", "foo"), ("Foo", "foo")], "q string, n string").select(tx.mentions(F.col("q"), F.col("n"), True).alias("x")).collect() == [(False,), (True,), (False,)]


def test_identifier_terms_split_only_ascii(spark):
    rows = [("getHTTPResponse user_id", ["gethttpresponse", "get", "http", "response", "user_id", "user", "id"]), ("éÉtat straßeName", ["éétat", "strassename", "strasse", "name"]), ("كتاب‌ها éa", ["کتاب", "ها", "éa"]), ("", []), (None, None)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(tx.identifier_terms(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [w for _, w in rows]


def test_chunk_texts_agree_with_the_python_path(spark):
    from siltstone.functions import code

    source = "async def go(a, b=1):\n    return a\n"
    chunk = code.chunks_of("p.py", source)[0][0]
    row = spark.createDataFrame([(chunk["relative_path"], chunk["chunk_type"], chunk["qualified_name"], chunk["start_line"], chunk["end_line"], chunk["content_hash"], None)], "path string, kind string, name string, start int, stop int, hash string, none string")
    parts = [F.col(c) for c in ("path", "kind", "name", "start", "stop", "hash")]
    assert row.select(tx.chunk_identity(*parts).alias("x")).first()["x"] == chunk["chunk_id"]
    import hashlib

    want = hashlib.sha256("\0".join(("p.py", "", chunk["qualified_name"], "1:2", "h")).encode()).hexdigest()
    assert row.select(tx.chunk_identity(F.col("path"), F.col("none"), F.col("name"), F.lit(1), F.lit(2), F.lit("h")).alias("x")).first()["x"] == want
    assert "\nis_async: True\n" in row.select(tx.embedding_text(is_async=F.lit(True), source=F.lit("s")).alias("x")).first()["x"]


def test_judge_scores_and_case_concepts(spark):
    good = '{"a": 3, "b": 20}'
    rows = [good, f"```json\n{good}\n```", f"  {good}\n", '{"a": 0, "b": 2}', '{"a": 21, "b": 2}', '{"a": "3", "b": 2}', '{"a": 3}', '{"a": 3.5, "b": 2}', '{"a": true, "b": 2}', "no json", None]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(tx.judge_scores(F.col("t"), ("a", "b")).alias("x")).collect()
    assert [None if r["x"] is None else tuple(r["x"]) for r in got] == [(3, 20)] * 3 + [None] * 8
    ids = spark.createDataFrame([("auth-flow-en",), ("single",)], "i string").select(tx.case_concept(F.col("i")).alias("x")).collect()
    assert [r["x"] for r in ids] == ["auth-flow", "single"]


def test_stable_sums(spark):
    import math
    import random

    r = random.Random(4)
    a, b = [r.uniform(-1, 1) * 10 ** r.randint(-8, 8) for _ in range(200)], [r.uniform(-1, 1) for _ in range(200)]
    got = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(vx.stable_sum(F.col("a")).alias("s"), vx.stable_cosine(F.col("a"), F.col("b")).alias("c")).first()
    dot, x, y = (math.fsum(p * q for p, q in zip(u, v, strict=True)) for u, v in ((a, b), (a, a), (b, b)))
    assert got["s"] == math.fsum(a) and abs(got["c"] - dot / math.sqrt(x) / math.sqrt(y)) < 1e-15


def test_vector_digests(spark):
    import hashlib
    import struct

    rows = [([1.5, -2.0, 0.1],), ([],), (None,)]
    got = [r["d"] for r in spark.createDataFrame(rows, "v array<float>").select(vx.vector_digest(F.col("v")).alias("d")).collect()]
    assert got == [hashlib.sha256(struct.pack("<3f", 1.5, -2.0, 0.1)).hexdigest(), hashlib.sha256(b"").hexdigest(), None]
