"""Study-level queries: judges and blinding, symbol resolution, projections of nested artifacts, and whole-run gates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.functions import text as tx
from siltstone.operators import metrics as m
from siltstone.operators import stats
from siltstone.plans.standins import OUTCOMES, RANKINGS, judged, outcomes, rankings, table
from siltstone.plans.texts import ANSWERS, CITES, answers, citations
from siltstone.runtime import numbered

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH k AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS updates FROM events) SELECT user_id AS job_id, event_type AS state, updates, event_type NOT IN ('purchase', 'error') AS active FROM k WHERE k = 1")
def job_log_latest(spark, sf):
    """State of every job out of an append-only log."""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("updates"))
    return last.select(F.col("user_id").alias("job_id"), "state", "updates", (~F.col("state").isin("purchase", "error")).alias("active"))


@query("SELECT event_type AS k, arg_max(props, event_id) AS v FROM events GROUP BY ALL")
def collection_metadata(spark, sf):
    """Merged key-values, later ones winning."""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("k")).agg(F.max_by("props", "event_id").alias("v"))


@query("SELECT (SELECT count(*) FROM labels JOIN embeddings ON vec_id = doc_id) AS served, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS unknown")
def frozen_vectors(spark, sf):
    """Requests that stored vectors can serve, and unknown ones."""
    asked, known = table(spark, sf, "labels").select("doc_id"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return asked.join(known, "doc_id").agg(F.count("*").alias("served")).crossJoin(asked.join(known, "doc_id", "left_anti").agg(F.count("*").alias("unknown")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sha256(props) AS digest FROM events")
def artifact_projection(spark, sf):
    """Allowed keys of a JSON artifact, and its digest."""
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.sha2("props", 256).alias("digest"))


@query("SELECT 'en' AS language, item_id AS case_id, length(text) AS chars FROM benchmark UNION ALL SELECT 'fa', item_id, length(text || '؟') FROM benchmark")
def question_projection(spark, sf):
    """A row for each language of each case."""
    both = F.create_map(F.lit("en"), F.col("text"), F.lit("fa"), F.concat("text", F.lit("؟")))
    return table(spark, sf, "benchmark").select("item_id", F.explode(both)).select(F.col("key").alias("language"), F.col("item_id").alias("case_id"), F.length("value").cast("long").alias("chars"))


@query("SELECT repo, number, CAST(row_number() OVER (ORDER BY repo, number) AS INT) AS place FROM (SELECT source AS repo, doc_id AS number FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source, doc_id FROM documents WHERE doc_id % 2 = 1)")
def multi_file_arm(spark, sf):
    """An original and a supplement in one order."""
    d = table(spark, sf, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("number"))
    both = d.where("number % 2 = 0").unionByName(d.where("number % 2 = 1"))
    return numbered(both, ["repo", "number"], "place")


@query("WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS body FROM documents WHERE length(text) > 6000) SELECT doc_id, CAST(line AS INT) AS line, length(body) AS chars, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY contains(body, 'the') DESC, line) AS INT) AS place FROM l")
def large_class_expansion(spark, sf):
    """Chunks over 6000 characters as pieces, those that hold a query term first."""
    d = table(spark, sf, "documents").where(F.length("text") > 6000)
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "body")).withColumn("line", F.col("pos") + 1)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.contains("body", F.lit("the"))), F.asc("line")))
    return lines.select("doc_id", "line", F.length("body").cast("long").alias("chars"), place.alias("place"))


@query("WITH k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations WHERE turn > 0) SELECT conv_id, turn, 'method' AS kind FROM k WHERE k <= 2 UNION ALL SELECT conv_id, turn, 'header' FROM conversations WHERE turn = 0")
def method_selection(spark, sf):
    """The header and the two best methods of each class."""
    c = table(spark, sf, "conversations")
    best = c.where("turn > 0").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), F.asc("turn")))).where("k <= 2")
    return best.select("conv_id", "turn", F.lit("method").alias("kind")).unionAll(c.where("turn = 0").select("conv_id", "turn", F.lit("header").alias("kind")))


@query(f"WITH {ANSWERS}, {CITES}, k AS (SELECT conv_id, path, min(turn) AS idx, bool_or(path LIKE 'src/%') AS mentioned FROM p GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY mentioned DESC, idx, path) AS place FROM k) SELECT conv_id, path, CAST(place AS INT) AS place FROM o WHERE place <= 3")
def citation_display_order(spark, sf):
    """Distinct citations, mentioned ones first, in first-seen order, three at most."""
    k = citations(spark, sf).groupBy("conv_id", "path").agg(F.min("turn").alias("idx"), F.bool_or(F.col("path").startswith("src/")).alias("mentioned"))
    return k.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("mentioned"), F.asc("idx"), F.asc("path")))).where("place <= 3").select("conv_id", "path", "place")


@query("SELECT conv_id, count(*) AS expected FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING count(*) > 1")
def multi_symbol_filter(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("expected")).where("expected > 1")


@query("WITH b AS (SELECT sha256('blind|' || doc_id) AS blind_id, quality FROM labels), k AS (SELECT sha256('blind|' || doc_id) AS blind_id, doc_id, source FROM documents) SELECT k.doc_id, k.source, b.quality FROM b JOIN k USING (blind_id)")
def unblinding_join(spark, sf):
    """Scores under blind ids joined to their documents."""
    def blind(rows):
        return rows.withColumn("blind_id", F.sha2(F.concat_ws("|", F.lit("blind"), F.col("doc_id").cast("string")), 256))

    scores = blind(table(spark, sf, "labels").select("doc_id", "quality")).drop("doc_id")
    return scores.join(blind(table(spark, sf, "documents").select("doc_id", "source")), "blind_id").select("doc_id", "source", "quality")


@query("WITH p AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS treated, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS control FROM orders GROUP BY ALL) SELECT o_custkey, round(treated - control, 2) AS difference FROM p WHERE treated IS NOT NULL AND control IS NOT NULL")
def treatment_pairs(spark, sf):
    """Pairs that have both levels."""
    p = table(spark, sf, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "P"]).agg(F.max("o_totalprice"))
    return p.where("F IS NOT NULL AND P IS NOT NULL").select("o_custkey", F.round(F.col("F") - F.col("P"), 2).alias("difference"))


@query("""WITH r AS (SELECT n_nationkey AS request, n_name AS name FROM nation), c AS (SELECT request, s_suppkey, CASE WHEN s_suppkey = request THEN 1 WHEN s_nationkey = request AND s_acctbal > 5000 THEN 2 WHEN s_nationkey = request THEN 3 END AS tier FROM r CROSS JOIN supplier WHERE s_suppkey = request OR s_nationkey = request),
b AS (SELECT *, min(tier) OVER (PARTITION BY request) AS best FROM c), n AS (SELECT request, count(*) AS matches FROM b WHERE tier = best GROUP BY ALL) SELECT r.request, coalesce(matches, 0) AS matches, CASE WHEN matches IS NULL THEN 'not_found' WHEN matches = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM r LEFT JOIN n USING (request)""")
def symbol_match_cascade(spark, sf):
    """By id, else by name under a condition, else by name: none, one or several."""
    r = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("request"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    by_id = s.select(F.col("s_suppkey").alias("request"), "s_suppkey", F.lit(1).alias("tier"))
    by_name = s.select(F.col("s_nationkey").cast("long").alias("request"), "s_suppkey", F.when(F.col("s_acctbal") > 5000, 2).otherwise(3).alias("tier"))
    best = r.join(by_id.unionAll(by_name), "request").groupBy("request", "s_suppkey").agg(F.min("tier").alias("tier"))
    least = best.withColumn("m", F.min("tier").over(Window.partitionBy("request"))).where("tier = m").groupBy("request").agg(F.count("*").alias("matches"))
    status = F.when(F.col("matches").isNull(), "not_found").when(F.col("matches") == 1, "resolved").otherwise("ambiguous")
    return r.join(least, "request", "left").select("request", F.coalesce("matches", F.lit(0)).alias("matches"), status.alias("status"))


@query("SELECT count(*) AS invalid FROM (SELECT doc_id, quality, toxic FROM labels EXCEPT ALL SELECT doc_id, 1, 0 FROM documents)")
def gold_validation(spark, sf):
    """Expected rows that the stored ones do not have."""
    stored = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return table(spark, sf, "labels").select("doc_id", "quality", "toxic").exceptAll(stored).agg(F.count("*").alias("invalid"))


@query("WITH l AS (SELECT user_id, event_type, ts, event_id, value, event_id % 2 AS pass FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, pass ORDER BY ts DESC, event_id DESC) AS k FROM l), u AS (SELECT user_id, event_type, avg(value) AS score, count(*) AS passes FROM k WHERE k = 1 GROUP BY ALL) SELECT user_id, event_type, round(score, 6) AS score, passes FROM u")
def judge_unit_scores(spark, sf):
    """The latest record of each pass, then the mean over passes."""
    last = table(spark, sf, "events").withColumn("pass", F.col("event_id") % 2).groupBy("user_id", "event_type", "pass").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("score"), F.count("*").alias("passes"))


@query("SELECT event_type AS arm, count(*) AS judged, round(avg(value), 6) AS mean, round(avg(CASE WHEN user_id % 3 = 0 THEN value END), 6) AS r0, round(avg(CASE WHEN user_id % 3 = 1 THEN value END), 6) AS r1, round(avg(CASE WHEN user_id % 3 = 2 THEN value END), 6) AS r2 FROM events GROUP BY ALL")
def quality_by_arm(spark, sf):
    e = table(spark, sf, "events").withColumn("repo", F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")))
    per = e.groupBy("event_type").pivot("repo", ["r0", "r1", "r2"]).agg(F.round(F.avg("value"), 6))
    every = e.groupBy("event_type").agg(F.count("*").alias("judged"), F.round(F.avg("value"), 6).alias("mean"))
    return every.join(per, "event_type").withColumnRenamed("event_type", "arm")


@query("WITH f AS (SELECT conv_id, turn, list_filter(['the', 'de', 'und', 'que'], lambda w: contains(text, w)) AS hits, contains(text, 'idiot') AS forbidden FROM conversations) SELECT round(avg(10.0 * len(hits) / 4), 6) AS mean_recall, round(avg(CASE WHEN forbidden THEN 1.0 ELSE 0 END), 6) AS forbidden_rate, count(*) FILTER (WHERE len(hits) = 4) AS complete FROM f")
def fact_recall(spark, sf):
    """Ten times the share of expected facts found, and the rate of forbidden ones."""
    facts = F.array(*[F.lit(w) for w in ("the", "de", "und", "que")])
    hits = F.size(F.filter(facts, lambda w: F.contains("text", w)))
    return table(spark, sf, "conversations").agg(F.round(F.avg(10.0 * hits / 4), 6).alias("mean_recall"), F.round(F.avg(F.contains("text", F.lit("idiot")).cast("double")), 6).alias("forbidden_rate"), F.count_if(hits == 4).alias("complete"))


@query(f"WITH {OUTCOMES}, c AS (SELECT method, question_id, count(DISTINCT CASE WHEN hit THEN chunk_id END) / 5.0 AS a, count(DISTINCT chunk_label) / 10.0 AS b FROM j WHERE rank <= 10 GROUP BY ALL), g AS (SELECT method, avg(a) AS a, avg(b) AS b FROM c GROUP BY ALL) SELECT t.method, round(t.a, 6) AS gold_coverage, round(t.b, 6) AS file_coverage, round(t.a, 9) > round(k.a, 9) AND round(t.b, 9) > round(k.b, 9) AS passes FROM g t, g k WHERE k.method = 'cosine'")
def gate_coverage(spark, sf):
    """A variant passes if both coverages improve on the control."""
    c = judged(spark, sf).where("rank <= 10").groupBy("method", "question_id").agg((F.countDistinct(F.when(F.col("hit"), F.col("chunk_id"))) / 5.0).alias("a"), (F.countDistinct("chunk_label") / 10.0).alias("b"))
    g = c.groupBy("method").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    control = g.where("method = 'cosine'").select(F.col("a").alias("ka"), F.col("b").alias("kb"))
    better = (F.round("a", 9) > F.round("ka", 9)) & (F.round("b", 9) > F.round("kb", 9))
    return g.crossJoin(F.broadcast(control)).select("method", F.round("a", 6).alias("gold_coverage"), F.round("b", 6).alias("file_coverage"), better.alias("passes"))


@query(f"WITH {ANSWERS}, {CITES}, s AS (SELECT conv_id, turn, string_agg(DISTINCT path, '|' ORDER BY path) AS cited FROM p GROUP BY ALL), n AS (SELECT cited, count(*) AS answers FROM s GROUP BY ALL) SELECT cited, answers, answers = 1 AS resolved FROM n")
def label_resolution(spark, sf):
    """A set of cited files names an answer if only one has it."""
    s = citations(spark, sf).groupBy("conv_id", "turn").agg(F.array_join(F.sort_array(F.collect_set("path")), "|").alias("cited"))
    return s.groupBy("cited").agg(F.count("*").alias("answers")).withColumn("resolved", F.col("answers") == 1)


@query(f"WITH {RANKINGS} SELECT a.question_id, a.chunk_id, CAST(a.rank AS INT) AS exact_rank, CAST(b.rank AS INT) AS other_rank, a.rank IS DISTINCT FROM b.rank AS moved FROM (SELECT * FROM r WHERE method = 'cosine') a LEFT JOIN (SELECT * FROM r WHERE method = 'fused' AND rank <= 10) b USING (question_id, chunk_id)")
def rank_boundary_diagnosis(spark, sf):
    """Ranks of one ranking beside another's, and what moved."""
    r = rankings(spark, sf)
    a = r.where("method = 'cosine'").select("question_id", "chunk_id", F.col("rank").alias("exact_rank"))
    b = r.where("method = 'fused' AND rank <= 10").select("question_id", "chunk_id", F.col("rank").alias("other_rank"))
    return a.join(b, ["question_id", "chunk_id"], "left").withColumn("moved", ~F.col("exact_rank").eqNullSafe(F.col("other_rank")))


@query("SELECT role, count(*) AS total, count(*) FILTER (WHERE length(text) >= 100) AS complete, count(*) FILTER (WHERE length(text) < 100) AS failed, count(DISTINCT md5(text)) AS prompts FROM conversations GROUP BY role")
def documentation_counts(spark, sf):
    n = F.length("text")
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("total"), F.count_if(n >= 100).alias("complete"), F.count_if(n < 100).alias("failed"), F.countDistinct(F.md5("text")).alias("prompts"))


@query(f"WITH {RANKINGS}, l AS (SELECT question_id, method, string_agg(chunk_id, ',' ORDER BY rank) AS ids FROM r WHERE rank <= 5 GROUP BY ALL) SELECT question_id, count(DISTINCT ids) AS lists, count(DISTINCT ids) = 1 AS invariant FROM l GROUP BY ALL")
def cross_arm_invariant(spark, sf):
    """Whether all arms have one ordered list."""
    lists = rankings(spark, sf).where("rank <= 5").groupBy("question_id", "method").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    return lists.groupBy("question_id").agg(F.countDistinct("ids").alias("lists")).withColumn("invariant", F.col("lists") == 1)


@query(f"""WITH {ANSWERS}, {CITES}, z AS (SELECT a.conv_id, a.turn, count(p.path) AS cited, count(*) FILTER (WHERE p.e > 40) AS wrong FROM a LEFT JOIN p USING (conv_id, turn) GROUP BY ALL)
SELECT count(*) AS answers, CAST(sum(cited) AS BIGINT) AS citations, round(sum(wrong) / sum(cited), 6) AS error_rate, round(avg(CASE WHEN cited = 0 THEN 1.0 ELSE 0 END), 6) AS omission_rate, round(avg(cited), 6) AS mean_cited FROM z""")
def citation_metrics(spark, sf):
    found = citations(spark, sf).groupBy("conv_id", "turn").agg(F.count("*").alias("cited"), F.count_if(F.col("e") > 40).alias("wrong"))
    c = answers(spark, sf).select("conv_id", "turn").join(found, ["conv_id", "turn"], "left").fillna(0, ["cited", "wrong"])
    return c.agg(F.count("*").alias("answers"), F.sum("cited").alias("citations"), F.round(F.sum("wrong") / F.sum("cited"), 6).alias("error_rate"), F.round(F.avg((F.col("cited") == 0).cast("double")), 6).alias("omission_rate"), F.round(F.avg("cited"), 6).alias("mean_cited"))


@query("WITH s AS (SELECT d.doc_id, length(d.text) AS n, l.quality FROM documents d JOIN labels l USING (doc_id)), x AS (SELECT *, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rn, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS rq FROM s) SELECT count(*) AS n, round(corr(rn, rq), 6) AS spearman FROM x")
def length_association(spark, sf):
    """Rank correlation of length and score."""
    s = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n_chars")).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").withColumn("g", F.lit(0))
    return stats.spearman(s, "n_chars", "quality", ["g"]).select("n", "spearman")


@query("WITH c AS (SELECT role, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE length(text) < 100) AS h FROM conversations GROUP BY role) SELECT role, h AS hits, round(h / n, 6) AS rate, round((h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low FROM c")
def behaviour_rates(spark, sf):
    """Short answers with the lower Wilson bound."""
    c = table(spark, sf, "conversations").groupBy("role").agg(F.count("*").cast("double").alias("n"), F.count_if(F.length("text") < 100).alias("hits"))
    low, _ = stats.wilson(F.col("hits"), F.col("n"))
    return c.select("role", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"))


@query("SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings)) AS missing, (SELECT count(*) FROM (SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM documents)) AS stray")
def vector_completeness(spark, sf):
    """Whether the id sets of chunks and vectors are equal."""
    d, v = table(spark, sf, "documents").select(F.col("doc_id").alias("id")), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    side = d.select("id", F.lit(1).alias("d"), F.lit(0).alias("v")).unionAll(v.select("id", F.lit(0).alias("d"), F.lit(1).alias("v"))).groupBy("id").agg(F.sum("d").alias("d"), F.sum("v").alias("v"))
    return side.agg(F.sum("d").alias("chunks"), F.sum("v").alias("vectors"), F.count_if((F.col("d") > 0) & (F.col("v") == 0)).alias("missing"), F.count_if((F.col("v") > 0) & (F.col("d") == 0)).alias("stray"))


@query(f"""WITH {OUTCOMES}, p AS (SELECT b.method AS configuration, a.first_rank AS x, b.first_rank AS y FROM o a JOIN o b USING (question_id) WHERE a.method = 'cosine' AND b.method <> 'cosine'), t AS (SELECT configuration, coalesce(x <= 3, false) AS a, coalesce(y <= 3, false) AS b FROM p)
SELECT configuration, CASE WHEN NOT a AND b THEN 'repair' WHEN a AND NOT b THEN 'regression' WHEN a AND b THEN 'both_success' ELSE 'both_fail' END AS outcome, count(*) AS n FROM t GROUP BY ALL""")
def experiment_transitions(spark, sf):
    """Transitions at 3 of every configuration against the control."""
    o = outcomes(spark, sf)
    a = o.where("method = 'cosine'").select("question_id", F.col("first_rank").alias("x"))
    p = o.where("method <> 'cosine'").select("question_id", F.col("method").alias("configuration"), F.col("first_rank").alias("y")).join(a, "question_id")
    return p.groupBy("configuration", m.transition(F.col("x"), F.col("y"), F.lit(3)).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {OUTCOMES}, l AS (SELECT method, unnest(list_filter([CASE WHEN first_rank IS NULL THEN 'not_retrieved' END, CASE WHEN first_rank BETWEEN 2 AND 3 THEN 'near_miss' END, CASE WHEN first_rank > 3 THEN 'late' END, CASE WHEN language = 'fa' THEN 'fa' END], lambda x: x IS NOT NULL)) AS label FROM o) SELECT method, label, count(*) AS n FROM l GROUP BY ALL")
def diagnostic_labels(spark, sf):
    """Set-valued labels, counted by method."""
    r = F.col("first_rank")
    labels = F.array_compact(F.array(F.when(r.isNull(), "not_retrieved"), F.when(r.between(2, 3), "near_miss"), F.when(r > 3, "late"), F.when(F.col("language") == "fa", "fa")))
    return outcomes(spark, sf).select("method", F.explode(labels).alias("label")).groupBy("method", "label").agg(F.count("*").alias("n"))


@query(f"WITH {OUTCOMES}, x AS (SELECT question_id, list_sort(list_distinct(list(chunk_label) FILTER (WHERE rank <= 5))) AS files, any_value(label) AS gold FROM j WHERE method = 'fused' GROUP BY ALL) SELECT question_id, list_contains(files, gold) AS gold_covered, CAST(len(files) AS INT) AS n_files FROM x")
def gold_subset_test(spark, sf):
    """Whether the gold files are a subset of the delivered ones."""
    x = judged(spark, sf).where("method = 'fused' AND rank <= 5").groupBy("question_id").agg(F.collect_set("chunk_label").alias("files"), F.first("label").alias("gold"))
    return x.select("question_id", (F.size(F.array_except(F.array("gold"), "files")) == 0).alias("gold_covered"), F.size("files").alias("n_files"))


@query(r"SELECT conv_id, turn, md5(array_to_string(list_slice(string_split(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```[a-z]*', '', 'g'), '\[S\d+\]', '', 'g'), '^\s*[aA][nN][sS][wW][eE][rR]:\s*', ''), '\s+', ' ', 'g'), ' '), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), 1, 2), ' ')) AS h FROM conversations")
def answer_cleanup(spark, sf):
    """Answers without fences and labels, cut to two sentences."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(tx.clean_answer(F.col("text"))).alias("h"))
