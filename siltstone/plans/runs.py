"""Latency, cost and schedule queries: event types are methods, users questions, values milliseconds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.operators import runs as r
from siltstone.operators import spans
from siltstone.plans.standins import RANKINGS, rankings, table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LATENCY = "count(*) AS n, round(min(value), 3) AS min_ms, round(avg(value), 6) AS mean_ms, round(median(value), 3) AS median_ms, round(quantile_disc(value, 0.95), 3) AS p95_ms, round(max(value), 3) AS max_ms"


@query(f"SELECT event_type, {LATENCY} FROM events GROUP BY event_type")
def latency_summary(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(*r.latency_summary())


@query(f"""WITH e AS (SELECT *, 'r' || (user_id % 3) AS repository, CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'fa' END AS language FROM events)
SELECT event_type, repository, language, {LATENCY}, round(stddev_pop(value), 6) AS sd_ms, round(1000.0 / avg(value), 6) AS per_second, count(DISTINCT user_id) AS questions, round(avg(CASE WHEN value < 5 THEN 1.0 ELSE 0 END), 6) AS error_rate
FROM e GROUP BY GROUPING SETS ((), (event_type), (event_type, repository), (event_type, language), (event_type, repository, language))""")
def performance_slices(spark, sf):
    """Grouping sets with deviation, throughput, distinct questions and error rate."""
    e = table(spark, sf, "events").withColumn("repository", F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string"))).withColumn("language", F.when(F.col("user_id") % 2 == 0, "en").otherwise("fa"))
    sets = [[], ["event_type"], ["event_type", "repository"], ["event_type", "language"], ["event_type", "repository", "language"]]
    more = [F.countDistinct("user_id").alias("questions"), F.round(F.avg((F.col("value") < 5).cast("double")), 6).alias("error_rate")]
    return e.groupingSets(sets, "event_type", "repository", "language").agg(*r.latency_summary(), *r.throughput(), *more)


@query(f"""WITH {RANKINGS}, l AS (SELECT question_id, method, k, list(chunk_id ORDER BY rank) AS ids FROM two CROSS JOIN (VALUES (0), (1), (2)) x(k) GROUP BY ALL) SELECT question_id, method, count(*) = 3 AS complete, count(DISTINCT ids) = 1 AS identical FROM l GROUP BY ALL""")
def ranking_consistency(spark, sf):
    """Three repetitions of every ranking give one list."""
    reps = rankings(spark, sf).where("method <> 'fused'").withColumn("repetition", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return r.consistency(reps, 3, ["question_id", "method"])


@query("""WITH k AS (SELECT DISTINCT user_id, event_type FROM events), d AS (SELECT *, sha256('seed|' || user_id || '|' || event_type) AS digest FROM k) SELECT user_id, event_type, CAST(row_number() OVER (ORDER BY digest, user_id, event_type) AS INT) AS place FROM d""")
def hash_schedule(spark, sf):
    runs = table(spark, sf, "events").select("user_id", "event_type").distinct()
    return r.hash_schedule(runs, "seed", ["user_id", "event_type"]).select("user_id", "event_type", "place")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY sha256('7|' || event_id), event_id) AS k, count(*) OVER (PARTITION BY event_type, user_id % 3) AS n FROM events) SELECT event_id FROM c WHERE k <= greatest(1, round(n * 0.25))""")
def stratified_sample(spark, sf):
    """A quarter of each cell of arm and repository, at least one row, in hash order."""
    w = Window.partitionBy("event_type", F.col("user_id") % 3)
    ordered = w.orderBy(F.sha2(F.concat_ws("|", F.lit("7"), F.col("event_id").cast("string")), 256), "event_id")
    return table(spark, sf, "events").withColumn("k", F.row_number().over(ordered)).withColumn("n", F.count("*").over(w)).where("k <= greatest(1, round(n * 0.25))").select("event_id")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id, event_id, CAST(k AS INT) AS k FROM k WHERE k <= 10""")
def first_n_per_group(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("k", F.row_number().over(w)).where("k <= 10").select("user_id", "event_id", "k")


@query("""WITH m AS (SELECT event_type, user_id, median(value) AS m FROM events GROUP BY ALL) SELECT event_type, round(median(m), 6) AS median, round(quantile_cont(m, 0.95), 6) AS p95, round(avg(m), 6) AS mean_of_medians FROM m GROUP BY ALL""")
def efficiency_medians(spark, sf):
    return r.median_of_medians(table(spark, sf, "events"), F.col("value"), ["event_type"], "user_id")


@query("""WITH m AS (SELECT user_id, median(CASE WHEN event_type = 'view' THEN value END) AS a, median(CASE WHEN event_type = 'click' THEN value END) AS b FROM events GROUP BY ALL), q AS (SELECT a / b AS ratio FROM m WHERE a IS NOT NULL AND b > 0)
SELECT count(*) AS n, round(median(ratio), 6) AS median_ratio, CASE WHEN median(ratio) < 1 THEN 'faster' ELSE 'not_faster' END AS claim FROM q""")
def ratio_contrasts(spark, sf):
    """Median of the questions' ratios of medians."""
    m = table(spark, sf, "events").groupBy("user_id").agg(F.median(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"), F.median(F.when(F.col("event_type") == "click", F.col("value"))).alias("b"))
    q = m.where("a IS NOT NULL AND b > 0").select((F.col("a") / F.col("b")).alias("ratio"))
    return q.agg(F.count("*").alias("n"), F.round(F.median("ratio"), 6).alias("median_ratio"), F.when(F.median("ratio") < 1, "faster").otherwise("not_faster").alias("claim"))


@query("""WITH s AS (SELECT event_type, user_id, greatest(value - CAST(json_extract(props, '$.k') AS INT), 0) AS local_part, CAST(json_extract(props, '$.k') AS INT) AS embedding FROM events WHERE event_id % 10 <> 0),
m AS (SELECT event_type, user_id, median(local_part) AS l, median(embedding) AS e FROM s GROUP BY ALL) SELECT event_type, round(median(l), 6) AS local_ms, round(median(e), 6) AS embedding_ms FROM m GROUP BY ALL""")
def latency_split(spark, sf):
    """Embedding and local share; every tenth run is a warm-up and is left out, as the operator asks."""
    k = F.get_json_object("props", "$.k").cast("int")
    s = table(spark, sf, "events").where("event_id % 10 <> 0").select("event_type", "user_id", F.greatest(F.col("value") - k, F.lit(0.0)).alias("l"), k.alias("e"))
    m = s.groupBy("event_type", "user_id").agg(F.median("l").alias("l"), F.median("e").alias("e"))
    return m.groupBy("event_type").agg(F.round(F.median("l"), 6).alias("local_ms"), F.round(F.median("e"), 6).alias("embedding_ms"))


USAGE = "u AS (SELECT event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events)"


@query(f"WITH {USAGE} SELECT event_type, count(k) AS calls, CAST(sum(k) AS BIGINT) AS tokens, round(sum(k * 0.2 + value * 0.1) / 1000, 6) AS cost FROM u GROUP BY ALL")
def json_usage_sum(spark, sf):
    """Usage counters out of JSON, summed by arm."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").withColumn("k", k).groupBy("event_type").agg(F.count("k").alias("calls"), F.sum("k").alias("tokens"), F.round(F.sum(F.col("k") * 0.2 + F.col("value") * 0.1) / 1000, 6).alias("cost"))


@query(f"WITH {USAGE} SELECT user_id, CASE WHEN bool_and(k > 2) THEN CAST(sum(k) AS BIGINT) END AS tokens FROM u GROUP BY ALL")
def poisoned_sum(spark, sf):
    """A user with one call without usage has no figure at all."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").withColumn("k", k).groupBy("user_id").agg(r.poisoned_sum(F.col("k"), F.col("k") > 2).alias("tokens"))


@query(f"WITH {USAGE} SELECT event_type, round(sum(CASE WHEN k > 2 THEN (k - k // 2) * 3.0 + (k // 2) * 0.3 + value * 15.0 END) / 1e6, 9) AS cost, round(sum(CASE WHEN k > 2 THEN k * 3.0 + value * 15.0 END) / 1e6, 9) AS uncached_cost FROM u GROUP BY ALL")
def token_cost_projection(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    cached = F.floor(F.col("k") / 2)
    cost = r.list_cost(F.col("k"), cached, F.col("value"), F.col("k") > 2, (3.0, 0.3, 15.0))
    plain = r.list_cost(F.col("k"), F.lit(0), F.col("value"), F.col("k") > 2, (3.0, 0.3, 15.0))
    return table(spark, sf, "events").withColumn("k", k).groupBy("event_type").agg(F.round(F.sum(cost), 9).alias("cost"), F.round(F.sum(plain), 9).alias("uncached_cost"))


@query(f"WITH {USAGE}, a AS (SELECT event_type, sum(k) AS cost, avg(value) AS score, count(*) FILTER (WHERE value > 100) AS good FROM u GROUP BY ALL) SELECT event_type, round(cost / score, 6) AS cost_per_score, CASE WHEN good > 0 THEN round(cost / good, 6) END AS cost_per_good FROM a")
def quality_adjusted_cost(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    a = table(spark, sf, "events").withColumn("k", k).groupBy("event_type").agg(F.sum("k").alias("cost"), F.avg("value").alias("score"), F.count_if(F.col("value") > 100).alias("good"))
    return a.select("event_type", F.round(F.try_divide("cost", "score"), 6).alias("cost_per_score"), F.round(F.try_divide("cost", "good"), 6).alias("cost_per_good"))


@query("SELECT source, CAST(sum(ceil(length(text) / 4.0) + 300) AS BIGINT) AS low_tokens, round(sum((ceil(length(text) / 4.0) + 300) * 2.0 / 1e6), 6) AS low_cost, round(sum((ceil(length(text) / 3.0) + 500) * 3.0 / 1e6), 6) AS high_cost FROM documents GROUP BY ALL")
def cost_envelope(spark, sf):
    low, high = r.cost_envelope(F.length("text"), 2.0, 3.0)
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(F.ceil(F.length("text") / 4.0) + 300).cast("bigint").alias("low_tokens"), F.round(F.sum(low), 6).alias("low_cost"), F.round(F.sum(high), 6).alias("high_cost"))


@query(f"WITH {USAGE}, m AS (SELECT event_type, user_id, count(*) FILTER (WHERE value < 5) AS failed, count(*) FILTER (WHERE value >= 5) AS done, sum(k) AS tokens, avg(value) AS mean FROM u GROUP BY ALL) SELECT event_type, CAST(sum(done) AS BIGINT) AS completed, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(tokens) AS BIGINT) AS tokens, round(median(mean), 6) AS median_latency, round(quantile_disc(mean, 0.95), 6) AS p95_latency FROM m GROUP BY ALL")
def ablation_arm_summary(spark, sf):
    """Counts by status, usage sums and latencies of each arm."""
    k = F.from_json("props", "k bigint")["k"]
    m = table(spark, sf, "events").withColumn("k", k).groupBy("event_type", "user_id").agg(F.count_if(F.col("value") < 5).alias("failed"), F.count_if(F.col("value") >= 5).alias("done"), F.sum("k").alias("tokens"), F.avg("value").alias("mean"))
    return m.groupBy("event_type").agg(F.sum("done").alias("completed"), F.sum("failed").alias("failed"), F.sum("tokens").alias("tokens"), F.round(F.median("mean"), 6).alias("median_latency"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY mean)"), 6).alias("p95_latency"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_record(spark, sf):
    """The later row of a key supersedes the others."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("last")
    return table(spark, sf, "events").groupBy("user_id").agg(last).select("user_id", "last.event_id", "last.value")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS turn FROM events), r AS (SELECT user_id, event_type, max(CASE WHEN turn = 1 THEN value END) AS original, max(CASE WHEN turn = 2 AND value >= 20 THEN value END) AS retry FROM f GROUP BY ALL)
SELECT user_id, event_type, coalesce(retry, original) AS value, retry IS NOT NULL AS superseded FROM r""")
def supersede_retry(spark, sf):
    """A usable retry replaces the original record."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    f = table(spark, sf, "events").withColumn("turn", F.row_number().over(w))
    g = f.groupBy("user_id", "event_type").agg(F.max(F.when(F.col("turn") == 1, F.col("value"))).alias("original"), F.max(F.when((F.col("turn") == 2) & (F.col("value") >= 20), F.col("value"))).alias("retry"))
    return g.select("user_id", "event_type", F.coalesce("retry", "original").alias("value"), F.col("retry").isNotNull().alias("superseded"))


@query("""WITH d AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 300), a AS (SELECT user_id FROM d GROUP BY ALL HAVING count(*) = 1), n AS (SELECT user_id FROM events GROUP BY ALL HAVING count(DISTINCT event_type) = 5) SELECT user_id FROM n WHERE user_id NOT IN (SELECT user_id FROM d)""")
def nobody_refused(spark, sf):
    """Questions that all arms ran and none refused (a value over 300)."""
    e = table(spark, sf, "events")
    every = e.groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).where("n = 5").select("user_id")
    return every.join(e.where("value > 300").select("user_id").distinct(), "user_id", "left_anti")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS INT) AS occurrence FROM events")
def occurrence_index(spark, sf):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", (F.row_number().over(w) - 1).alias("occurrence"))


@query("SELECT a.user_id, a.mean AS view_mean, b.mean AS click_mean FROM (SELECT user_id, round(avg(value), 6) AS mean FROM events WHERE event_type = 'view' GROUP BY ALL) a JOIN (SELECT user_id, round(avg(value), 6) AS mean FROM events WHERE event_type = 'click' GROUP BY ALL) b USING (user_id)")
def paired_arm_join(spark, sf):
    """Questions that both arms ran."""
    e = table(spark, sf, "events").where("event_type IN ('view', 'click')")
    wide = e.groupBy("user_id").pivot("event_type", ["view", "click"]).agg(F.round(F.avg("value"), 6))
    return wide.where("view IS NOT NULL AND click IS NOT NULL").select("user_id", F.col("view").alias("view_mean"), F.col("click").alias("click_mean"))


@query("SELECT event_type, CASE WHEN value < 5 THEN 'error' WHEN value < 20 THEN 'fast' WHEN value < 100 THEN 'normal' ELSE 'slow' END AS status, count(*) AS n FROM events GROUP BY ALL")
def status_taxonomy(spark, sf):
    v = F.col("value")
    status = F.when(v < 5, "error").when(v < 20, "fast").when(v < 100, "normal").otherwise("slow")
    return table(spark, sf, "events").groupBy("event_type", status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND a.ts <= b.ts + INTERVAL 2 HOUR AND b.ts <= a.ts + INTERVAL 2 HOUR")
def interval_overlap(spark, sf):
    """Two-hour spans of one user that overlap; spans of any length meet by dyadic nodes."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("s")).withColumn("e", F.col("s") + F.lit(7_200_000_000))
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("a"), "user_id", F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("b"), "user_id", F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    return spans.overlaps(a, b, ["user_id"], ("a_s", "a_e"), ("b_s", "b_e")).select("a", "b")


@query("""WITH c AS (SELECT doc_id, source, n_chars, doc_id * 7 % 20000 AS first_line, doc_id * 7 % 20000 + CASE WHEN doc_id % 7000 = 0 THEN 20000 ELSE n_chars % (1 + doc_id % 300) END AS last_line FROM documents)
SELECT a.doc_id AS cited, b.doc_id AS chunk_id, least(a.last_line, b.last_line) - greatest(a.first_line, b.first_line) + 1 AS lines FROM c a JOIN c b ON a.source = b.source AND a.doc_id % 20 = 0 AND a.first_line <= b.last_line AND b.first_line <= a.last_line""")
def line_overlap(spark, sf):
    """Cited line spans against chunks of the same file, from one line to the whole file."""
    first = F.col("doc_id") * 7 % 20000
    c = table(spark, sf, "documents").select("doc_id", "source", first.alias("s"), (first + F.when(F.col("doc_id") % 7000 == 0, 20000).otherwise(F.col("n_chars") % (1 + F.col("doc_id") % 300))).alias("e"))
    a = c.where("doc_id % 20 = 0").select("source", F.col("doc_id").alias("cited"), F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    b = c.select("source", F.col("doc_id").alias("chunk_id"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    met = spans.overlaps(a, b, ["source"], ("a_s", "a_e"), ("b_s", "b_e"))
    return met.select("cited", "chunk_id", (F.least("a_e", "b_e") - F.greatest("a_s", "b_s") + 1).alias("lines"))


@query("SELECT l_orderkey, l_linenumber, o_orderdate <= l_shipdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY AS inside, l_shipdate = o_orderdate AS exact FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def interval_containment(spark, sf):
    """Whether a line's date lies in its order's span, and equals its start."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    joined = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders, "l_orderkey", "left")
    inside = (F.col("o_orderdate") <= F.col("l_shipdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    return joined.select("l_orderkey", "l_linenumber", inside.alias("inside"), (F.col("l_shipdate") == F.col("o_orderdate")).alias("exact"))
