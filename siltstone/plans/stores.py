"""Index maintenance and validation over documents: even ids are stored, ids not divisible by five are current."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone import schemas
from siltstone.functions import vectors as vx
from siltstone.operators import merkle, store
from siltstone.plans.standins import table
from siltstone.runtime import stage_table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STORED = "old AS (SELECT 'f' || doc_id AS relative_path, sha256(text) AS sha256 FROM documents WHERE doc_id % 3 <> 0), cur AS (SELECT 'f' || doc_id AS relative_path, sha256(CASE WHEN n_chars % 2 = 0 THEN text ELSE text || 'x' END) AS sha256 FROM documents WHERE doc_id % 5 <> 0)"
DELTA = "d AS (SELECT coalesce(old.relative_path, cur.relative_path) AS relative_path, CASE WHEN old.sha256 IS NULL THEN 'added' WHEN cur.sha256 IS NULL THEN 'deleted' WHEN old.sha256 = cur.sha256 THEN 'unchanged' ELSE 'modified' END AS change FROM old FULL JOIN cur USING (relative_path))"


def stored(spark, sf):
    """The stored state: what an earlier scan saw."""
    return table(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("relative_path"), F.sha2("text", 256).alias("sha256"))


def current(spark, sf):
    """The current state: some files are gone, new or changed."""
    text = F.when(F.col("n_chars") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x")))
    return table(spark, sf, "documents").where("doc_id % 5 <> 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("relative_path"), F.sha2(text, 256).alias("sha256"))


@query(f"WITH {STORED}, {DELTA} SELECT relative_path, change FROM d")
def file_change_plan(spark, sf):
    return store.file_delta(stored(spark, sf), current(spark, sf))


@query(f"WITH {STORED}, {DELTA} SELECT relative_path FROM old WHERE relative_path NOT IN (SELECT relative_path FROM d WHERE change IN ('modified', 'deleted'))")
def retained_chunks(spark, sf):
    s = stored(spark, sf)
    return store.retained(s, store.file_delta(s, current(spark, sf))).select("relative_path")


@query(f"WITH {STORED}, {DELTA} SELECT relative_path, sha256, 'kept' AS origin FROM old WHERE relative_path NOT IN (SELECT relative_path FROM d WHERE change IN ('modified', 'deleted')) UNION ALL SELECT cur.relative_path, cur.sha256, 'new' FROM cur JOIN d USING (relative_path) WHERE change IN ('added', 'modified')")
def incremental_apply(spark, sf):
    """Rows after an incremental update: retained ones and those of changed files."""
    s, c = stored(spark, sf), current(spark, sf)
    delta = store.file_delta(s, c)
    fresh = c.join(delta.where("change IN ('added', 'modified')").select("relative_path"), "relative_path", "left_semi")
    return store.apply_delta(s.withColumn("origin", F.lit("kept")), fresh.withColumn("origin", F.lit("new")), delta)


@query(f"WITH {STORED} SELECT relative_path FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM cur) UNION ALL SELECT relative_path FROM (SELECT * FROM cur EXCEPT ALL SELECT * FROM old)")
def symmetric_difference(spark, sf):
    return store.symmetric_difference(stored(spark, sf), current(spark, sf)).select("relative_path")


@query("SELECT coalesce(a.source, b.source) AS source, coalesce(b.n, a.n) AS n, a.first AS first FROM (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents WHERE lang = 'en' GROUP BY ALL) a FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY ALL) b ON a.source = b.source")
def project_upsert(spark, sf):
    """New values win, missing ones stay."""
    d = table(spark, sf, "documents")
    old = d.where("lang = 'en'").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return store.upsert(old, d.where("lang = 'fr'").groupBy("source").agg(F.count("*").alias("n")), "source")


@query("SELECT n_nationkey AS id FROM nation WHERE n_regionkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def conditional_delete(spark, sf):
    """Projects without schema, generation and files."""
    projects = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") % 2 == 1, 3).alias("index_schema_version"), F.lit(None).cast("string").alias("vector_generation"))
    files = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("project_id"))
    return store.deletable(projects, files).select("id")


@query("WITH u AS (SELECT vec_id % 100 AS chunk_id, label, vec_id AS seq FROM embeddings) SELECT chunk_id, label FROM u QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC) = 1")
def vector_upsert(spark, sf):
    """The latest vector of each id wins."""
    u = table(spark, sf, "embeddings").select((F.col("vec_id") % 100).alias("chunk_id"), "label", F.col("vec_id").alias("seq"))
    return u.groupBy("chunk_id").agg(F.max_by("label", "seq").alias("label"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def vector_delete(spark, sf):
    gone = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf, "embeddings").select("vec_id").join(gone, "vec_id", "left_anti")


@query("SELECT DISTINCT vec_id FROM embeddings JOIN labels ON vec_id = doc_id")
def vector_point_get(spark, sf):
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf, "embeddings").select("vec_id").join(wanted, "vec_id", "left_semi")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, true AS valid FROM embeddings")
def vector_validation(spark, sf):
    v = vx.doubles(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(vx.norm(v), 6).alias("norm"), vx.is_valid(v, 64).alias("valid"))


@query("WITH n AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS u FROM embeddings) SELECT vec_id, round(u[1], 9) AS first, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS length FROM n")
def l2_normalize(spark, sf):
    u = vx.normalised(vx.doubles(F.col("embedding")))
    n = table(spark, sf, "embeddings").select("vec_id", u.alias("u"))
    return n.select("vec_id", F.round(F.col("u")[0], 9).alias("first"), F.round(vx.dot(F.col("u"), F.col("u")), 6).alias("length"))


@query("SELECT a.vec_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS cosine_distance, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine_score, round(-list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS l2_score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def distance_scores(spark, sf):
    """Distances of neighbouring ids as scores."""
    v = table(spark, sf, "embeddings").select("vec_id", vx.doubles(F.col("embedding")).alias("a"))
    j = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    d = 1 - vx.cosine(F.col("a"), F.col("b"))
    return j.select("vec_id", (F.round(d, 6) + 0.0).alias("cosine_distance"), F.round(vx.distance_score("cosine", d), 6).alias("cosine_score"), F.round(vx.distance_score("l2", vx.l2_distance(F.col("a"), F.col("b"))), 6).alias("l2_score"))


@query("SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_acctbal > 0")
def chunk_hydrate(spark, sf):
    """Inner and left outer equi joins of a fact with two dimensions."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    supplier = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(part, "l_partkey").join(supplier, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def in_list_semi_join(spark, sf):
    ids = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unknown, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS uncovered, (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)) AS repeated")
def coverage_check(spark, sf):
    """Annotations of unknown documents, documents without one, and repeated ones."""
    labels, docs = table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").select("doc_id")
    one = labels.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("unknown"))
    two = docs.join(labels, "doc_id", "left_anti").agg(F.count("*").alias("uncovered"))
    return one.crossJoin(two).crossJoin(schemas.violations(labels, ["doc_id"]).agg(F.count("*").alias("repeated")))


@query("SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT lang) = 1 AS holds FROM documents GROUP BY source")
def functional_dependency(spark, sf):
    """Whether each source has exactly one language."""
    return table(spark, sf, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs")).withColumn("holds", F.col("langs") == 1)


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING count(*) <> max(turn) - min(turn) + 1 OR count(DISTINCT turn) <> count(*)")
def population_check(spark, sf):
    """Conversations whose turns are not each there once."""
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("turn").alias("d"), (F.max("turn") - F.min("turn") + 1).alias("span"))
    return g.where("turns <> span OR d <> turns").select("conv_id", "turns")


@query("WITH w AS (SELECT user_id % 3 AS cell, count(DISTINCT user_id) AS want FROM events GROUP BY ALL), q AS (SELECT event_type, user_id % 3 AS cell, count(DISTINCT user_id) AS questions FROM events GROUP BY ALL) SELECT event_type, cell, questions, questions = want AS complete FROM q JOIN w USING (cell)")
def arm_completeness(spark, sf):
    """Whether each arm ran all questions of each cell."""
    e = table(spark, sf, "events").withColumn("cell", F.col("user_id") % 3)
    want = e.groupBy("cell").agg(F.countDistinct("user_id").alias("want"))
    return e.groupBy("event_type", "cell").agg(F.countDistinct("user_id").alias("questions")).join(want, "cell").select("event_type", "cell", "questions", (F.col("questions") == F.col("want")).alias("complete"))


@query("SELECT conv_id, count(DISTINCT md5(role)) AS prompts, count(DISTINCT md5(role)) = 1 AS same FROM conversations GROUP BY conv_id")
def prompt_identity(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.countDistinct(F.md5("role")).alias("prompts"))
    return g.withColumn("same", F.col("prompts") == 1)


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality NOT BETWEEN 0 AND 1 OR toxic NOT BETWEEN 0 AND 1 OR (quality = 1 AND toxic = 1)")
def score_validation(spark, sf):
    """Rows that break the rules of their scores."""
    return table(spark, sf, "labels").where(~F.col("quality").between(0, 1) | ~F.col("toxic").between(0, 1) | ((F.col("quality") == 1) & (F.col("toxic") == 1))).select("doc_id", "quality", "toxic")


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE length(text) > 2400) AS long, count(DISTINCT source) AS sources, count(*) FILTER (WHERE text IS NULL) AS failed, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def indexing_stats(spark, sf):
    """Conditional counters in one pass."""
    return table(spark, sf, "documents").agg(F.count("*").alias("documents"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.length("text") > 2400).alias("long"), F.countDistinct("source").alias("sources"), F.count_if(F.col("text").isNull()).alias("failed"), F.sum(F.length("text")).alias("chars"))


@query("SELECT lang, source, count(*) AS n, CAST(floor(avg(n_chars)) AS BIGINT) AS mean_chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def human_metric_groups(spark, sf):
    return table(spark, sf, "documents").groupingSets([["lang"], ["source"], ["lang", "source"]], "lang", "source").agg(F.count("*").alias("n"), F.floor(F.avg("n_chars")).cast("bigint").alias("mean_chars"))


@query("SELECT a.doc_id, b.doc_id AS first FROM documents a JOIN (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text) b ON a.text = b.text WHERE a.doc_id <> b.doc_id")
def embedding_cache_hits(spark, sf):
    """Documents whose text an earlier one has: only the first is embedded."""
    h = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = h.groupBy("h").agg(F.min("doc_id").alias("first"))
    return h.join(first, "h").where("doc_id <> first").select("doc_id", "first")


@query("SELECT event_id, 'low' AS stage FROM events WHERE value < 1 UNION ALL SELECT event_id, 'high' FROM events WHERE value > 300 UNION ALL SELECT event_id, 'kind' FROM events WHERE event_type = 'error'")
def error_streams(spark, sf):
    """Union of the errors of three stages."""
    e = table(spark, sf, "events")
    parts = [e.where(c).select("event_id", F.lit(s).alias("stage")) for s, c in (("low", "value < 1"), ("high", "value > 300"), ("kind", "event_type = 'error'"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS INT) AS place FROM documents")
def stored_listing(spark, sf):
    """Places in stored order."""
    return table(spark, sf, "documents").select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("source", "doc_id")).alias("place"))


@query("SELECT count(*) AS overlap FROM (SELECT DISTINCT text FROM benchmark) b JOIN (SELECT DISTINCT text FROM documents) d USING (text)")
def question_overlap(spark, sf):
    """New questions that already exist."""
    a = table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("h")).distinct()
    return a.join(table(spark, sf, "documents").select(F.sha2("text", 256).alias("h")).distinct(), "h", "left_semi").agg(F.count("*").alias("overlap"))


@query("SELECT doc_id, n_matches FROM (SELECT a.doc_id, count(*) AS n_matches FROM documents a JOIN documents b ON a.text = b.text GROUP BY ALL) WHERE n_matches = 1")
def answer_text_arm(spark, sf):
    """Texts that identify exactly one document."""
    h = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    one = h.groupBy("h").agg(F.count("*").alias("n_matches")).where("n_matches = 1")
    return h.join(one, "h").select("doc_id", "n_matches")


FILES = "f AS (SELECT coalesce(source, 'none') || '/' || doc_id AS path, sha256(coalesce(text, '')) AS sha256, doc_id FROM documents WHERE doc_id IS NOT NULL)"


def _files(spark, sf):
    return table(spark, sf, "documents").where("doc_id IS NOT NULL").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "doc_id")


@query(f"""WITH {FILES}, b AS (SELECT left(sha256(path), 2) AS prefix, sha256(string_agg(path || ' ' || sha256, chr(10) ORDER BY path)) AS digest, count(*) AS n FROM f GROUP BY 1),
a AS (SELECT left(prefix, 1) AS prefix, sha256(string_agg(digest, '' ORDER BY prefix)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1), r AS (SELECT '' AS prefix, sha256(coalesce(string_agg(digest, '' ORDER BY prefix), '')) AS digest, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM a)
SELECT 2 AS level, * FROM b UNION ALL SELECT 1, * FROM a UNION ALL SELECT 0, * FROM r""")
def snapshot_tree(spark, sf):
    """All nodes of the digest tree of the documents as files, two digits deep."""
    return merkle.tree(_files(spark, sf).select("path", "sha256"), 2)


@query(f"WITH {FILES} SELECT path, CASE WHEN doc_id % 97 = 5 THEN 'deleted' ELSE 'modified' END AS change FROM f WHERE doc_id % 97 = 5 OR doc_id % 89 = 7 UNION ALL SELECT 'new/' || doc_id, 'added' FROM f WHERE doc_id % 101 = 3")
def snapshot_changes(spark, sf):
    """What differs between two snapshots, found from the roots of their trees down."""
    f = _files(spark, sf)
    before = stage_table(f.select("path", "sha256"), "before")
    now = f.where("doc_id % 97 <> 5").select("path", F.when(F.col("doc_id") % 89 == 7, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256")).alias("sha256"))
    now = stage_table(now.unionByName(f.where("doc_id % 101 = 3").select(F.concat(F.lit("new/"), F.col("doc_id").cast("string")).alias("path"), "sha256")), "now")
    depth = merkle.depth_for(before.count())
    trees = tuple(stage_table(merkle.tree(x, depth), "tree") for x in (before, now))
    return merkle.changes(before, now, trees, depth)
