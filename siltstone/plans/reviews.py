"""Judged and checked runs: paired statistics with tests, scores by criterion, behaviour and citation rates, and validations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import context as cx
from siltstone.operators import endings, rank, stats
from siltstone.plans.contexts import FOLD, blocks
from siltstone.plans.standins import table, vectors
from siltstone.plans.statistics import BOOT, PAIRS
from siltstone.plans.statistics import pairs as paired
from siltstone.plans.texts import WORDS
from siltstone.runtime import session_partitions, stage_table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tail_sql(a: str, b: str) -> str:
    """Two-sided exact binomial tail of two counts."""
    n, low = f"({a} + {b})", f"least({a}, {b})"
    return f"CASE WHEN {n} > 0 THEN least(1.0, 2 * list_sum(list_transform(range(0, {low} + 1), lambda k: exp(lgamma({n} + 1.0) - lgamma(k + 1.0) - lgamma({n} - k + 1.0) - {n} * ln(2.0))))) END"


def wilson_sql(h: str, n: str, sign: str) -> str:
    return f"round((({h}) / ({n}) + 1.96 * 1.96 / (2 * ({n})) {sign} 1.96 * sqrt(({h}) / ({n}) * (1 - ({h}) / ({n})) / ({n}) + 1.96 * 1.96 / (4 * ({n}) * ({n})))) / (1 + 1.96 * 1.96 / ({n})), 6)"


def bounds(hits: Column, n: Column, name: str) -> list[Column]:
    low, high = stats.wilson(hits, n.cast("double"))
    return [F.round(low, 6).alias(f"{name}_low"), F.round(high, 6).alias(f"{name}_high")]


# Statistics of pairs

ALL = "q AS (SELECT stratum, round(a - b, 9) AS d FROM p UNION ALL SELECT -1, round(a - b, 9) FROM p)"


@query(f"""WITH {PAIRS}, {ALL}, x AS (SELECT *, round(abs(d), 9) AS m FROM q WHERE d <> 0), r AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY m) + (count(*) OVER (PARTITION BY stratum, m) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY stratum, m) AS t FROM x),
g AS (SELECT stratum, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum((t * t - 1) / 48.0) AS ties FROM r GROUP BY ALL),
z AS (SELECT stratum, n, CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties AS variance, w_plus - CAST(n AS DOUBLE) * (n + 1) / 4 AS gap FROM g),
s AS (SELECT stratum, count(*) AS pairs, round(avg(d), 6) AS mean_difference, round(avg(d) / stddev_samp(d), 6) AS dz, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d = 0) AS ties, count(*) FILTER (WHERE d < 0) AS losses FROM q GROUP BY ALL)
SELECT s.*, CASE WHEN z.n >= 10 THEN round((gap - sign(gap) * 0.5) / sqrt(variance), 6) END AS wilcoxon_z, round({tail_sql("wins", "losses")}, 9) AS sign_p FROM s LEFT JOIN z USING (stratum)""")
def paired_summary_full(spark, sf):
    """Mean, effect size, wins, sign test and signed-rank z (from ten pairs on) of each stratum and of all (-1)."""
    p = paired(spark, sf).withColumn("d", F.round(F.col("a") - F.col("b"), 9)).withColumn("stratum", F.explode(F.array(F.col("stratum"), F.lit(-1).cast("long"))))
    d = F.col("d")
    s = p.groupBy("stratum").agg(F.count("*").alias("pairs"), F.round(F.avg("d"), 6).alias("mean_difference"), F.round(F.avg("d") / F.stddev_samp("d"), 6).alias("dz"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"))
    z = stats.wilcoxon(p, "d", ["stratum"], least=10).select("stratum", F.col("z").alias("wilcoxon_z"))
    return s.join(z, "stratum", "left").withColumn("sign_p", F.round(stats.two_sided_binomial("wins", "losses"), 9))


@query(f"WITH {PAIRS}, c AS (SELECT stratum, count(*) FILTER (WHERE a > 50 AND NOT b > 50) AS only_a, count(*) FILTER (WHERE b > 50 AND NOT a > 50) AS only_b FROM p GROUP BY ALL) SELECT *, round({tail_sql('only_a', 'only_b')}, 9) AS p FROM c")
def mcnemar_exact(spark, sf):
    """Discordant pairs of each stratum and the exact test of them."""
    a, b = F.col("a") > 50, F.col("b") > 50
    c = paired(spark, sf).groupBy("stratum").agg(F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))
    return c.withColumn("p", F.round(stats.two_sided_binomial("only_a", "only_b"), 9))


MEDIANS = BOOT.replace("avg(rows_.v) AS mean", "median(rows_.v) AS mean")


@query(f"WITH {PAIRS}" + MEDIANS.format(keys="stratum", part="stratum", value="a - b", source="p", seed=20260930, name="stratum", b=20000, out="") + " SELECT round(max(CASE WHEN k = 500 THEN mean END), 6) AS ci_low, round(max(CASE WHEN k = 19499 THEN mean END), 6) AS ci_high FROM o")
def bootstrap_median(spark, sf):
    """Interval of the median difference, resampled within strata 20,000 times."""
    d = paired(spark, sf).withColumn("d", F.col("a") - F.col("b"))
    return stats.interval(stats.bootstrap(d, "d", ["user_id"], ["stratum"], 20000, 20260930, statistic=F.median), [], 20000)


RATIO = "p AS (SELECT user_id, user_id % 4 AS stratum, median(CASE WHEN event_type = 'view' THEN value END) / median(CASE WHEN event_type = 'click' THEN value END) AS v FROM events GROUP BY ALL HAVING median(CASE WHEN event_type = 'view' THEN value END) IS NOT NULL AND median(CASE WHEN event_type = 'click' THEN value END) > 0)"


@query(f"WITH {RATIO}" + MEDIANS.format(keys="stratum", part="stratum", value="v", source="p", seed=20260930, name="stratum", b=20000, out="") + """, i AS (SELECT round(max(CASE WHEN k = 500 THEN mean END), 6) AS ci_low, round(max(CASE WHEN k = 19499 THEN mean END), 6) AS ci_high FROM o)
SELECT (SELECT count(*) FROM p) AS pairs, (SELECT round(median(v), 6) FROM p) AS median_ratio, ci_low, ci_high, CASE WHEN ci_high < 1 THEN 'lower' WHEN ci_low > 1 THEN 'higher' ELSE 'no detectable difference' END AS claim FROM i""")
def ratio_contrasts_full(spark, sf):
    """Median of the questions' ratios with its bootstrap interval and what it lets one claim."""
    side = [F.median(F.when(F.col("event_type") == arm, F.col("value"))).alias(n) for arm, n in (("view", "a"), ("click", "b"))]
    q = table(spark, sf, "events").groupBy("user_id").agg(*side).where("a IS NOT NULL AND b > 0").select("user_id", (F.col("user_id") % 4).alias("stratum"), (F.col("a") / F.col("b")).alias("v"))
    found = stats.interval(stats.bootstrap(q, "v", ["user_id"], ["stratum"], 20000, 20260930, statistic=F.median), [], 20000)
    claim = F.when(F.col("ci_high") < 1, "lower").when(F.col("ci_low") > 1, "higher").otherwise("no detectable difference")
    return q.agg(F.count("*").alias("pairs"), F.round(F.median("v"), 6).alias("median_ratio")).crossJoin(found).withColumn("claim", claim)  # single rows


# Judged units: five criteria out of each event's value; every 13th record is unusable

CRITERIA = ("correctness", "completeness", "grounding", "clarity", "usefulness")
SCORES = "e AS (SELECT event_id, user_id, event_type, ts, event_id % 2 AS pass, event_id % 13 = 0 AS broken, " + ", ".join(f"1 + CAST(floor(value * {k}) AS BIGINT) % 20 AS {c}" for k, c in enumerate(CRITERIA, 1)) + " FROM events)"
UNITS = SCORES + ", k AS (SELECT * FROM e WHERE NOT broken QUALIFY row_number() OVER (PARTITION BY user_id, event_type, pass ORDER BY ts DESC, event_id DESC) = 1), u AS (SELECT user_id, event_type, count(*) AS passes, avg((" + " + ".join(CRITERIA) + ") / 5.0) AS mean, " + ", ".join(f"avg({c}) AS {c}" for c in CRITERIA) + " FROM k GROUP BY ALL)"


def judged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = {c: 1 + F.floor(F.col("value") * k).cast("long") % 20 for k, c in enumerate(CRITERIA, 1)}
    return table(spark, sf_dir, "events").withColumns(score).withColumns({"pass": F.col("event_id") % 2, "broken": F.col("event_id") % 13 == 0})


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest usable record of each pass, then means over passes, of all criteria and each."""
    last = judged_events(spark, sf_dir).where("NOT broken").groupBy("user_id", "event_type", "pass").agg(F.max_by(F.struct(*CRITERIA), F.struct("ts", "event_id")).alias("s")).select("user_id", "event_type", "s.*")
    whole = reduce(lambda a, b: a + b, [F.col(c) for c in CRITERIA]) / 5.0
    return last.groupBy("user_id", "event_type").agg(F.count("*").alias("passes"), F.avg(whole).alias("mean"), *[F.avg(c).alias(c) for c in CRITERIA])


@query(f"WITH {UNITS} SELECT user_id, event_type, passes, round(mean, 6) AS mean, {', '.join(f'round({c}, 6) AS {c}' for c in CRITERIA)} FROM u")
def judge_unit_scores_full(spark, sf):
    """Mean and the five criteria of every unit, over its judging passes."""
    return units(spark, sf).select("user_id", "event_type", "passes", *[F.round(c, 6).alias(c) for c in ("mean", *CRITERIA)])


@query(f"""WITH {UNITS}, g AS (SELECT event_type AS arm, count(*) AS judged, round(avg(mean), 6) AS mean, {", ".join(f"round(avg({c}), 6) AS {c}" for c in CRITERIA)}, {", ".join(f"round(avg(CASE WHEN user_id % 3 = {k} THEN mean END), 6) AS r{k}" for k in range(3))} FROM u GROUP BY ALL),
s AS (SELECT event_type AS arm, count(*) FILTER (WHERE NOT broken) AS usable, count(*) FILTER (WHERE broken) AS failed FROM e GROUP BY ALL) SELECT * FROM g JOIN s USING (arm)""")
def quality_by_arm_full(spark, sf):
    """Judged units, mean, criteria, repositories and record states of each arm."""
    by_repository = [F.round(F.avg(F.when(F.col("user_id") % 3 == k, F.col("mean"))), 6).alias(f"r{k}") for k in range(3)]
    g = units(spark, sf).groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("judged"), F.round(F.avg("mean"), 6).alias("mean"), *[F.round(F.avg(c), 6).alias(c) for c in CRITERIA], *by_repository)
    s = judged_events(spark, sf).groupBy(F.col("event_type").alias("arm")).agg(F.count_if(~F.col("broken")).alias("usable"), F.count_if("broken").alias("failed"))
    return g.join(s, "arm")


# Answers: every fifth conversation refuses, every fifth hedges; each turn cites lines

REPLIES = "a AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 THEN 'Not enough retrieved evidence to tell.' WHEN conv_id % 5 = 1 THEN 'It may be so. ' || text ELSE text END AS answer FROM conversations)"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("conv_id") % 5 == 0, "Not enough retrieved evidence to tell.").when(F.col("conv_id") % 5 == 1, F.concat(F.lit("It may be so. "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("answer"))


HEDGED = r"(?i)\b(?:not (?:fully |explicitly |directly )?(?:shown|included|visible|provided|specified)|cannot be determined|may|might|likely|appears to)\b"
KINDS = ("refusal", "hedged", "good")


@query(f"""WITH {REPLIES}, f AS (SELECT role, length(answer) AS chars, regexp_matches(answer, '(?i)^[^A-Za-z0-9_]*(there is )?not enough retrieved evidence') AS refusal, regexp_matches(answer, '{HEDGED}') AS h FROM a),
c AS (SELECT role, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE refusal) AS refusal, count(*) FILTER (WHERE NOT refusal AND h) AS hedged, count(*) FILTER (WHERE NOT refusal AND NOT h AND chars >= 40) AS good, round(median(chars), 6) AS median_chars FROM f GROUP BY role)
SELECT role, CAST(n AS BIGINT) AS answers, median_chars, {", ".join(f"{k} AS {k}_count, round({k} / n, 6) AS {k}_rate, {wilson_sql(k, 'n', '-')} AS {k}_low, {wilson_sql(k, 'n', '+')} AS {k}_high" for k in KINDS)} FROM c""")
def behaviour_rates_full(spark, sf):
    """Refused, hedged and good answers: count, rate and Wilson interval; median length."""
    a = replies(spark, sf)
    refusal, hedged, n = tx.is_refusal(F.col("answer")), tx.is_hedged(F.col("answer")), F.length("answer")
    c = a.groupBy("role").agg(F.count("*").alias("answers"), F.count_if(refusal).alias("refusal"), F.count_if(hedged).alias("hedged"), F.count_if(~refusal & ~hedged & (n >= 40)).alias("good"), F.round(F.median(n), 6).alias("median_chars"))
    columns = [x for k in KINDS for x in (F.col(k).alias(f"{k}_count"), F.round(F.col(k) / F.col("answers"), 6).alias(f"{k}_rate"), *bounds(F.col(k), F.col("answers"), k))]
    return c.select("role", "answers", "median_chars", *columns)


#: Citations of a turn: (path, s, e); the context blocks of a conversation are lines 1-3, 4-6, ... of its roles' files.
CITED = "p AS (SELECT conv_id, turn, role, 'src/' || role || '.py' AS path, turn + 1 AS s, turn + 1 + conv_id % 4 AS e FROM conversations WHERE (conv_id + turn) % 6 <> 0)"
BLOCKS = "b AS (SELECT DISTINCT conv_id, 'src/' || role || '.py' AS path, turn // 3 * 3 + 1 AS s, turn // 3 * 3 + 3 AS e FROM conversations WHERE conv_id % 7 <> 0)"


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("(conv_id + turn) % 6 <> 0")
    return c.select("conv_id", "turn", "role", F.concat(F.lit("src/"), "role", F.lit(".py")).alias("path"), (F.col("turn") + 1).alias("s"), (F.col("turn") + 1 + F.col("conv_id") % 4).alias("e"))


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("conv_id % 7 <> 0")
    first = F.floor(F.col("turn") / 3) * 3
    return c.select("conv_id", F.concat(F.lit("src/"), "role", F.lit(".py")).alias("path"), (first + 1).alias("s"), (first + 3).alias("e")).distinct()


@query(f"""WITH {REPLIES}, {CITED}, {BLOCKS}, k AS (SELECT p.*, EXISTS (SELECT 1 FROM b WHERE b.conv_id = p.conv_id AND b.path = p.path AND b.s <= p.e AND p.s <= b.e) AS valid, EXISTS (SELECT 1 FROM b WHERE b.conv_id = p.conv_id AND b.path = p.path AND b.s = p.s AND b.e = p.e) AS same FROM p),
g AS (SELECT a.role, count(*) AS answers, count(k.path) AS citations, count(*) FILTER (WHERE NOT k.valid) AS errors, count(*) FILTER (WHERE k.path IS NULL) AS without_citation, count(*) FILTER (WHERE k.same) AS identical_to_block,
 count(*) FILTER (WHERE regexp_matches(a.answer, '(?i)^[^A-Za-z0-9_]*(there is )?not enough retrieved evidence')) AS refusal_like FROM a LEFT JOIN k USING (conv_id, turn) GROUP BY a.role),
t AS (SELECT split_part(split_part(path, '/', 2), '.', 1) AS role, count(*) AS context_blocks, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM p WHERE p.conv_id = b.conv_id AND p.path = b.path AND b.s <= p.e AND p.s <= b.e)) AS blocks_cited FROM b GROUP BY ALL)
SELECT g.*, round(errors / CAST(citations AS DOUBLE), 6) AS error_rate, {wilson_sql("errors", "CAST(citations AS DOUBLE)", "-")} AS error_low, {wilson_sql("errors", "CAST(citations AS DOUBLE)", "+")} AS error_high, round(without_citation / CAST(answers AS DOUBLE), 6) AS omission_rate, context_blocks, blocks_cited FROM g JOIN t USING (role)""")
def citation_metrics_full(spark, sf):
    """Error rate with its interval, omissions, refusals, citations that are a context block, and blocks cited."""
    p, b = cited(spark, sf), context_blocks(spark, sf)
    met = p.join(b.select("conv_id", "path", F.col("s").alias("bs"), F.col("e").alias("be")), ["conv_id", "path"], "left")
    overlap = F.coalesce((F.col("bs") <= F.col("e")) & (F.col("s") <= F.col("be")), F.lit(False))
    k = met.groupBy("conv_id", "turn").agg(F.bool_or(overlap).alias("valid"), F.bool_or(F.coalesce((F.col("bs") == F.col("s")) & (F.col("be") == F.col("e")), F.lit(False))).alias("same"))
    g = replies(spark, sf).join(k, ["conv_id", "turn"], "left").groupBy("role").agg(
        F.count("*").alias("answers"), F.count("valid").alias("citations"), F.count_if(~F.col("valid")).alias("errors"), F.count_if(F.col("valid").isNull()).alias("without_citation"),
        F.count_if("same").alias("identical_to_block"), F.count_if(tx.is_refusal(F.col("answer"))).alias("refusal_like"),
    )
    used = met.where(overlap).select("conv_id", "path", F.col("bs").alias("s"), F.col("be").alias("e"), F.lit(True).alias("used")).distinct()
    t = b.join(used, ["conv_id", "path", "s", "e"], "left").groupBy(F.regexp_extract("path", "/([^.]*)", 1).alias("role")).agg(F.count("*").alias("context_blocks"), F.count("used").alias("blocks_cited"))
    rate = [F.round(F.col("errors") / F.col("citations"), 6).alias("error_rate"), *bounds(F.col("errors"), F.col("citations"), "error"), F.round(F.col("without_citation") / F.col("answers"), 6).alias("omission_rate")]
    return g.select("*", *rate).join(t, "role")


KEY = ("path", "name", "s", "e")


@query("""WITH x AS (SELECT conv_id, turn, 'src/' || role || '.py' AS path, CASE WHEN turn % 2 = 0 THEN role END AS name, turn + 1 AS s, turn + 1 + conv_id % 4 AS e FROM conversations),
g AS (SELECT conv_id, turn, 'src/' || role || '.py' AS path, CASE WHEN turn % 4 = 0 THEN role END AS name, turn + 1 AS s, turn + 1 + conv_id % 3 AS e FROM conversations)
SELECT x.conv_id, x.turn, x.path, x.name, x.s, x.e FROM x JOIN g ON x.conv_id = g.conv_id AND x.path = g.path AND x.name IS NOT DISTINCT FROM g.name AND x.s = g.s AND x.e = g.e""")
def gold_citation_match(spark, sf):
    """Predicted citations that are expected ones: path, name and lines are equal, and no name equals no name."""
    c = table(spark, sf, "conversations")
    place = [F.concat(F.lit("src/"), "role", F.lit(".py")).alias("path"), (F.col("turn") + 1).alias("s")]
    x = c.select("conv_id", "turn", *place, F.when(F.col("turn") % 2 == 0, F.col("role")).alias("name"), (F.col("turn") + 1 + F.col("conv_id") % 4).alias("e"))
    g = c.select("conv_id", *place, F.when(F.col("turn") % 4 == 0, F.col("role")).alias("name"), (F.col("turn") + 1 + F.col("conv_id") % 3).alias("e"))
    equal = reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"g.{k}")) for k in KEY], F.col("x.conv_id") == F.col("g.conv_id"))
    return x.alias("x").join(g.alias("g"), equal).select("x.conv_id", "x.turn", *[f"x.{k}" for k in KEY])


SYMBOLS = "s AS (SELECT doc_id, 's' || doc_id AS symbol_id, 'c' || doc_id AS chunk_id, source || '.' || lang || '.f' || (doc_id % 50) AS qualified, 'f' || (doc_id % 50) AS short FROM documents)"


def symbol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, number = F.col("doc_id").cast("string"), (F.col("doc_id") % 50).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), key).alias("symbol_id"), F.concat(F.lit("c"), key).alias("chunk_id"), F.concat("source", F.lit("."), "lang", F.lit(".f"), number).alias("qualified"), F.concat(F.lit("f"), number).alias("short"))


@query(f"""WITH {SYMBOLS}, r AS (SELECT doc_id AS request, CASE doc_id // 20 % 5 WHEN 0 THEN symbol_id WHEN 1 THEN chunk_id WHEN 2 THEN qualified WHEN 3 THEN short ELSE 'nothing' END AS name FROM s WHERE doc_id % 20 = 0),
t AS (SELECT request, 1 AS tier FROM r JOIN s ON name = symbol_id UNION ALL SELECT request, 2 FROM r JOIN s ON name = chunk_id UNION ALL SELECT request, 3 FROM r JOIN s ON name = qualified UNION ALL SELECT request, 4 FROM r JOIN s ON name = short),
c AS (SELECT request, tier, count(*) AS matches FROM t GROUP BY request, tier), n AS (SELECT * FROM c QUALIFY tier = min(tier) OVER (PARTITION BY request))
SELECT r.request, n.tier, coalesce(matches, 0) AS matches, CASE WHEN matches IS NULL THEN 'not_found' WHEN matches = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM r LEFT JOIN n USING (request)""")
def symbol_match_cascade_full(spark, sf):
    """By symbol id, else chunk id, else qualified name, else short name: none, one or several."""
    s = symbol_rows(spark, sf)
    kind = F.floor(F.col("doc_id") / 20) % 5
    name = F.when(kind == 0, F.col("symbol_id")).when(kind == 1, F.col("chunk_id")).when(kind == 2, F.col("qualified")).when(kind == 3, F.col("short")).otherwise("nothing")
    r = s.where("doc_id % 20 = 0").select(F.col("doc_id").alias("request"), name.alias("name"))
    tiers = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.col(c).alias("name")) for k, c in enumerate(("symbol_id", "chunk_id", "qualified", "short"), 1)])).alias("t")).select("t.*")
    n = r.join(tiers, "name").groupBy("request", "tier").agg(F.count("*").alias("matches")).groupBy("request").agg(F.min_by(F.struct("tier", "matches"), "tier").alias("m")).select("request", "m.*")
    status = F.when(F.col("matches").isNull(), "not_found").when(F.col("matches") == 1, "resolved").otherwise("ambiguous")
    return r.join(n, "request", "left").select("request", "tier", F.coalesce("matches", F.lit(0)).alias("matches"), status.alias("status"))


@query("""SELECT doc_id, path, name, last FROM (SELECT doc_id, source AS path, lang AS name, CASE WHEN doc_id % 30 = 0 THEN n_chars + 1 ELSE n_chars END AS last FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT -1, 'gone.py', 'en', 1) EXCEPT ALL SELECT doc_id, source, lang, n_chars FROM documents""")
def gold_validation_full(spark, sf):
    """Expected chunks whose path, name or lines are not what is stored; must be empty for a usable gold set."""
    d = table(spark, sf, "documents")
    last = F.when(F.col("doc_id") % 30 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    gold = d.where("doc_id % 3 = 0").select("doc_id", F.col("source").alias("path"), F.col("lang").alias("name"), last.alias("last"))
    extra = d.sparkSession.createDataFrame([(-1, "gone.py", "en", 1)], "doc_id long, path string, name string, last long")
    return gold.unionAll(extra).exceptAll(d.select("doc_id", "source", "lang", "n_chars"))


# Retrieval

PLACED = "score DESC, source_file NULLS FIRST, start_line NULLS FIRST, chunk_id"


@query(f"""WITH d AS (SELECT doc_id, text, source AS source_file, n_chars // 1000 AS start_line, e.embedding AS e FROM documents JOIN embeddings e ON vec_id = doc_id), q AS (SELECT * FROM d WHERE doc_id % 20 = 0),
qt AS (SELECT doc_id AS question_id, unnest(list_distinct({WORDS.format('text')})) AS term FROM q), dt AS (SELECT doc_id AS chunk_id, source_file, start_line, unnest(list_distinct({WORDS.format('text')})) AS term FROM d),
lt AS (SELECT question_id, chunk_id, source_file, start_line, count(*) AS score FROM qt JOIN dt USING (term) GROUP BY ALL), lx AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {PLACED}) AS rank FROM lt),
st AS (SELECT q.doc_id AS question_id, d.doc_id AS chunk_id, d.source_file, d.start_line, round(list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])), 9) AS score FROM q CROSS JOIN d), sm AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {PLACED}) AS rank FROM st),
f AS (SELECT question_id, chunk_id, source_file, start_line, round(coalesce(max(a), 0) + coalesce(max(b), 0), 12) AS score FROM (SELECT question_id, chunk_id, source_file, start_line, 1.0 / (60 + rank) AS a, NULL AS b FROM sm WHERE rank <= 10 UNION ALL SELECT question_id, chunk_id, source_file, start_line, NULL, 1.0 / (60 + rank) FROM lx WHERE rank <= 10) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY {PLACED}) AS INT) AS rank FROM f) SELECT question_id, rank, chunk_id, source_file, start_line, score FROM k WHERE rank <= 10""")
def hybrid_lexical_semantic(spark, sf):
    """Reciprocal rank fusion of the lists by vectors and by shared words, as deep as the result; equal sums by file, line and id."""
    place = (F.col("source").alias("source_file"), F.floor(F.col("n_chars") / 1000).alias("start_line"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", *place).join(vectors(spark, sf).select("chunk_id", "vector"), "chunk_id")
    asked = d.where("chunk_id % 20 = 0")
    semantic = rank.semantic(asked.select("chunk_id", "vector"), d.select("chunk_id", "source_file", "start_line", "vector"), 10, exclude_self=False)
    lexical = rank.lexical(asked.select(F.col("chunk_id").alias("question_id"), "text"), d.select("chunk_id", "source_file", "start_line", F.col("text").alias("code")), 10, {"code": 1})
    return rank.fuse(semantic, lexical, 10).select("question_id", "rank", "chunk_id", "source_file", "start_line", "score")


ARMS, REPEATS, SEED, WARM = ("a0", "a1", "a2"), 3, 42, 2


@query(f"""WITH a AS (SELECT unnest({list(ARMS)}) AS arm), q AS (SELECT item_id AS question_id FROM benchmark),
t AS (SELECT false AS warmup, repeat, question_id, arm, sha256('{SEED}|order|' || repeat || '|' || question_id) AS qk, sha256('{SEED}|' || question_id || '|' || repeat || '|' || arm) AS ak FROM q CROSS JOIN a CROSS JOIN range(1, {REPEATS + 1}) r(repeat)
UNION ALL SELECT true, 0, question_id, arm, lpad(CAST(question_id AS VARCHAR), 20, '0'), '' FROM (SELECT * FROM q ORDER BY question_id LIMIT {WARM}) CROSS JOIN a)
SELECT warmup, repeat, question_id, arm, CAST(row_number() OVER (PARTITION BY repeat ORDER BY CASE WHEN warmup THEN arm ELSE '' END, qk, question_id, ak, arm) AS INT) AS place FROM t""")
def timing_plan(spark, sf):
    """Warm-up calls (the first questions of every arm), then repeats with questions and, in each question, arms in a seeded order of their own."""
    arm = F.explode(F.array(*map(F.lit, ARMS))).alias("arm")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"))
    timed = q.select("question_id", arm).select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("repeat"))

    def shuffled(*parts: Column | str) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(str(SEED)), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)

    timed = timed.select(F.lit(False).alias("warmup"), "repeat", "question_id", "arm", shuffled("order", F.col("repeat"), F.col("question_id")).alias("qk"), shuffled(F.col("question_id"), F.col("repeat"), F.col("arm")).alias("ak"))
    warm = q.orderBy("question_id").limit(WARM).select(F.lit(True).alias("warmup"), F.lit(0).alias("repeat"), "question_id", arm).select("*", F.lpad(F.col("question_id").cast("string"), 20, "0").alias("qk"), F.lit("").alias("ak"))
    order = Window.partitionBy("repeat").orderBy(F.when(F.col("warmup"), F.col("arm")).otherwise(""), "qk", "question_id", "ak", "arm")
    return timed.unionByName(warm).withColumn("place", F.row_number().over(order)).select("warmup", "repeat", "question_id", "arm", "place")


# Index statistics

@query("""SELECT d.*, c.* FROM (SELECT count(*) AS files_discovered, count(*) FILTER (WHERE text IS NOT NULL) AS files_parsed, count(*) FILTER (WHERE source IS NULL) AS scan_errors, count(*) FILTER (WHERE text IS NOT NULL AND contains(text, '{')) AS parse_errors, count(*) FILTER (WHERE n_chars > 6000) AS chunk_errors FROM documents) d,
(SELECT count(*) AS symbols_extracted, count(*) FILTER (WHERE text IS NOT NULL) AS chunks_generated, count(*) FILTER (WHERE role = 'user') AS classes_extracted, count(*) FILTER (WHERE role = 'assistant') AS functions_extracted, count(*) FILTER (WHERE role = 'system') AS methods_extracted,
count(*) FILTER (WHERE role = 'user' AND text IS NOT NULL) AS class_chunks, count(*) FILTER (WHERE role = 'assistant' AND text IS NOT NULL) AS function_chunks, count(*) FILTER (WHERE role = 'system' AND text IS NOT NULL) AS method_chunks FROM conversations) c""")
def indexing_stats_full(spark, sf):
    """All thirteen counters of an indexing run: files and errors, symbols and chunks by kind."""
    has = F.col("text").isNotNull()
    d = table(spark, sf, "documents").agg(F.count("*").alias("files_discovered"), F.count_if(has).alias("files_parsed"), F.count_if(F.col("source").isNull()).alias("scan_errors"), F.count_if(has & F.contains("text", F.lit("{"))).alias("parse_errors"), F.count_if(F.col("n_chars") > 6000).alias("chunk_errors"))
    role = {plural: F.col("role") == r for r, plural in (("user", "class"), ("assistant", "function"), ("system", "method"))}
    extracted = [F.count_if(c).alias(f"{k}es_extracted" if k == "class" else f"{k}s_extracted") for k, c in role.items()]
    c = table(spark, sf, "conversations").agg(F.count("*").alias("symbols_extracted"), F.count_if(has).alias("chunks_generated"), *extracted, *[F.count_if(c & has).alias(f"{k}_chunks") for k, c in role.items()])
    return d.crossJoin(c)  # single rows


@query("""WITH b AS (SELECT doc_id // 32 AS batch, doc_id, doc_id // 32 % 10 = 3 AS failed, n_chars > 4000 AS cut FROM documents), v AS (SELECT count(*) AS vectors_stored, count(*) FILTER (WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS stray FROM embeddings)
SELECT count(*) AS chunks_expected, count(*) FILTER (WHERE NOT failed) AS embeddings_generated, any_value(vectors_stored) AS vectors_stored, count(*) FILTER (WHERE NOT failed AND cut) AS truncated_embeddings, count(*) FILTER (WHERE failed) AS embedding_failures,
count(*) FILTER (WHERE failed) = 0 AND any_value(vectors_stored) = count(*) AND any_value(stray) = 0 AS complete FROM b, v""")
def vector_index_stats(spark, sf):
    """A failed batch counts with all its chunks; complete only if nothing failed and the id sets are equal."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars").withColumn("failed", F.floor(F.col("doc_id") / 32) % 10 == 3)
    one = d.agg(F.count("*").alias("chunks_expected"), F.count_if(~F.col("failed")).alias("embeddings_generated"), F.count_if(~F.col("failed") & (F.col("n_chars") > 4000)).alias("truncated_embeddings"), F.count_if("failed").alias("embedding_failures"))
    known = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")).join(d.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    two = known.agg(F.count("*").alias("vectors_stored"), F.count_if(F.col("known").isNull()).alias("stray"))
    complete = (F.col("embedding_failures") == 0) & (F.col("vectors_stored") == F.col("chunks_expected")) & (F.col("stray") == 0)
    return one.crossJoin(two).withColumn("complete", complete).drop("stray")  # single rows


@query("SELECT doc_id, sha256('{\"doc_id\":' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ',\"lang\":' || coalesce(CAST(to_json(lang) AS VARCHAR), 'null') || ',\"source\":' || coalesce(CAST(to_json(source) AS VARCHAR), 'null') || '}') AS digest FROM documents")
def artifact_digests(spark, sf):
    """SHA-256 of each row as canonical JSON: sorted keys, compact separators, nulls written."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "source"), {"ignoreNullFields": "false"}), 256).alias("digest"))


@query("WITH k AS (SELECT label, sha256(string_agg(vec_id, chr(10) ORDER BY vec_id)) AS digest, count(*) AS n FROM embeddings WHERE vec_id % 20 = 0 GROUP BY label) SELECT * FROM k")
def order_digests(spark, sf):
    """SHA-256 of the newline-joined ids of each ranked list (a list holds the questions of a label)."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")), "\n")
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").groupBy("label").agg(F.sha2(ids, 256).alias("digest"), F.count("*").alias("n"))


RANGE = 4096


@query(f"""WITH r AS (SELECT source, doc_id // {RANGE} AS part, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT source, sha256(string_agg(digest, chr(10) ORDER BY part)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY source""")
def corpus_digest_tree(spark, sf):
    """Digest of each source over the digests of fixed ranges of ids, so no task holds all hashes of a source."""

    def digest(order: str, value: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), value.alias("h")))), lambda x: x["h"]), "\n"), 256).alias("digest")

    d = table(spark, sf, "documents").where("text IS NOT NULL").withColumn("part", F.floor(F.col("doc_id") / RANGE))
    r = d.groupBy("source", "part").agg(digest("doc_id", F.sha2("text", 256)), F.count("*").alias("n"))
    return r.groupBy("source").agg(digest("part", F.col("digest")), F.sum("n").alias("n"))


@query(f"""WITH t AS (SELECT doc_id, list_distinct({WORDS.format("coalesce(text, '')")}) AS a, list_distinct({WORDS.format("concat_ws(chr(32), source, lang)")}) AS b FROM documents), c AS (SELECT len(b) AS n, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS added FROM t)
SELECT count(*) AS chunks, round(avg(CASE WHEN added > 0 THEN 1.0 ELSE 0 END), 6) AS gaining_share, round(avg(added), 6) AS mean_added, round(100.0 * (1 - sum(added) / sum(n)), 6) AS overlap_percent FROM c""")
def identifier_information_gain_full(spark, sf):
    """Share of chunks that gain terms, mean number gained, and how many of the terms the text has already."""
    d = table(spark, sf, "documents")
    terms = tx.word_set(F.concat_ws(" ", "source", "lang"))
    c = d.select(F.size(terms).alias("n"), F.size(F.array_except(terms, tx.word_set(F.coalesce("text", F.lit(""))))).alias("added"))
    return c.agg(F.count("*").alias("chunks"), F.round(F.avg((F.col("added") > 0).cast("double")), 6).alias("gaining_share"), F.round(F.avg("added"), 6).alias("mean_added"), F.round(100.0 * (1 - F.sum("added") / F.sum("n")), 6).alias("overlap_percent"))


# Reviews and validations

@query("""WITH r AS (SELECT event_type AS arm, user_id % 3 AS repository, CASE WHEN event_id % 4 <> 0 THEN value END AS score, CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'minor' ELSE 'major' END AS label FROM events),
b AS (SELECT arm, coalesce(repository, -1) AS repository, score, label FROM r UNION ALL SELECT arm, -9, score, label FROM r),
l AS (SELECT arm, repository, label, count(*) AS n FROM b GROUP BY arm, repository, label), h AS (SELECT arm, repository, string_agg(label || '=' || CAST(n AS VARCHAR), ',' ORDER BY label) AS labels FROM l GROUP BY arm, repository),
s AS (SELECT arm, repository, count(*) AS records, count(score) AS scored, round(avg(score), 6) AS mean FROM b GROUP BY arm, repository) SELECT s.arm, nullif(s.repository, -9) AS repository, records, scored, mean, labels FROM s JOIN h ON s.arm = h.arm AND s.repository = h.repository""")
def human_metric_groups_full(spark, sf):
    """Means over the given scores and a histogram of labels, by one and by two keys."""
    e = table(spark, sf, "events")
    label = F.when(F.col("event_id") % 3 == 0, "none").when(F.col("event_id") % 3 == 1, "minor").otherwise("major")
    r = e.select(F.col("event_type").alias("arm"), (F.col("user_id") % 3).alias("repository"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("score"), label.alias("label"))
    counted = [F.count_if(F.col("label") == k).alias(k) for k in ("major", "minor", "none")]
    g = r.groupingSets([["arm"], ["arm", "repository"]], "arm", "repository").agg(F.count("*").alias("records"), F.count("score").alias("scored"), F.round(F.avg("score"), 6).alias("mean"), *counted)
    shown = F.concat_ws(",", *[F.when(F.col(k) > 0, F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in ("major", "minor", "none")])
    return g.select("arm", "repository", "records", "scored", "mean", shown.alias("labels"))


@query("""WITH l AS (SELECT event_type AS arm, user_id AS claim, CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'partly' ELSE 'no' END AS verdict, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
p AS (SELECT arm, round(count(*) FILTER (WHERE verdict = 'yes') / CAST(count(*) AS DOUBLE), 6) AS strict_precision, round(count(*) FILTER (WHERE verdict <> 'no') / CAST(count(*) AS DOUBLE), 6) AS lenient_precision FROM l GROUP BY arm),
c AS (SELECT arm, count(*) AS claims, round(avg(CASE WHEN verdict = 'yes' THEN 1.0 ELSE 0 END), 6) AS claim_coverage FROM l WHERE k = 1 GROUP BY arm) SELECT * FROM p JOIN c USING (arm)""")
def claim_coverage(spark, sf):
    """Strict and lenient precision of all verdicts, and the share of claims whose last verdict is yes."""
    verdict = F.when(F.col("event_id") % 3 == 0, "yes").when(F.col("event_id") % 3 == 1, "partly").otherwise("no")
    l = table(spark, sf, "events").select(F.col("event_type").alias("arm"), F.col("user_id").alias("claim"), verdict.alias("verdict"), "ts", "event_id")
    p = l.groupBy("arm").agg(F.round(F.avg((F.col("verdict") == "yes").cast("double")), 6).alias("strict_precision"), F.round(F.avg((F.col("verdict") != "no").cast("double")), 6).alias("lenient_precision"))
    last = l.groupBy("arm", "claim").agg(F.max_by("verdict", F.struct("ts", "event_id")).alias("verdict"))
    return p.join(last.groupBy("arm").agg(F.count("*").alias("claims"), F.round(F.avg((F.col("verdict") == "yes").cast("double")), 6).alias("claim_coverage")), "arm")


SCOPES, STATES = ("view", "click", "purchase", "error"), 60


@query(f"""WITH a AS (SELECT event_id AS annotation_id, user_id AS question, event_type AS scope, CAST(json_extract(props, '$.k') AS INT) AS status, CASE WHEN event_id % 50 = 0 THEN ' ' ELSE 'seen' END AS note, user_id % 9 AS review_case FROM events UNION ALL SELECT event_id, user_id, event_type, 1, 'again', 0 FROM events WHERE event_id % 100 = 7),
k AS (SELECT o_custkey AS question FROM orders), m AS (SELECT range AS review_case FROM range(0, 12)),
v AS (SELECT 'duplicate id' AS violation FROM (SELECT annotation_id FROM a GROUP BY annotation_id HAVING count(*) > 1) UNION ALL SELECT 'unknown question' FROM a WHERE question NOT IN (SELECT question FROM k) UNION ALL SELECT 'invalid scope' FROM a WHERE scope NOT IN {SCOPES}
UNION ALL SELECT 'invalid status' FROM a WHERE status >= {STATES} UNION ALL SELECT 'no note' FROM a WHERE trim(note) = '' UNION ALL SELECT 'uncovered case' FROM m WHERE review_case NOT IN (SELECT review_case FROM a))
SELECT violation, count(*) AS n FROM v GROUP BY ALL""")
def coverage_check_full(spark, sf):
    """Annotations that break a rule of their form, and mandatory review cases without one; empty if all is well."""
    e = table(spark, sf, "events")
    a = e.select(F.col("event_id").alias("annotation_id"), F.col("user_id").alias("question"), F.col("event_type").alias("scope"), F.get_json_object("props", "$.k").cast("int").alias("status"), F.when(F.col("event_id") % 50 == 0, " ").otherwise("seen").alias("note"), (F.col("user_id") % 9).alias("review_case"))
    a = a.unionAll(e.where("event_id % 100 = 7").select("event_id", "user_id", "event_type", F.lit(1), F.lit("again"), F.lit(0).cast("long")))
    known = table(spark, sf, "orders").select(F.col("o_custkey").alias("question")).distinct()
    broken = {
        "duplicate id": a.groupBy("annotation_id").count().where("count > 1"), "unknown question": a.join(known, "question", "left_anti"), "invalid scope": a.where(~F.col("scope").isin(*SCOPES)),
        "invalid status": a.where(F.col("status") >= STATES), "no note": a.where(F.trim("note") == ""), "uncovered case": spark.range(12).toDF("review_case").join(a.select("review_case").distinct(), "review_case", "left_anti"),
    }
    return reduce(DataFrame.unionAll, [rows.agg(F.count("*").alias("n")).select(F.lit(k).alias("violation"), "n") for k, rows in broken.items()]).where("n > 0")


@query("""WITH r AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'fa' END AS language, event_type = 'error' AS failed, CASE WHEN event_id % 11 <> 0 THEN value / 30 END AS correctness, CASE WHEN event_id % 3 = 0 THEN 5.0 END AS readability, CASE WHEN event_id % 17 <> 0 THEN 'none' END AS hallucination FROM events)
SELECT event_id, 'failed record was scored' AS reason FROM r WHERE failed AND (correctness IS NOT NULL OR readability IS NOT NULL OR hallucination IS NOT NULL)
UNION ALL SELECT event_id, 'invalid correctness' FROM r WHERE NOT failed AND (correctness IS NULL OR correctness NOT BETWEEN 0 AND 10) UNION ALL SELECT event_id, 'readability is required' FROM r WHERE NOT failed AND language = 'fa' AND readability IS NULL
UNION ALL SELECT event_id, 'readability must be null' FROM r WHERE NOT failed AND language = 'en' AND readability IS NOT NULL UNION ALL SELECT event_id, 'no hallucination rating' FROM r WHERE NOT failed AND hallucination IS NULL""")
def score_validation_full(spark, sf):
    """Scores that break a rule: the range, what a language requires, and failed records, which must have none."""
    r = table(spark, sf, "events").select(
        "event_id", F.when(F.col("user_id") % 2 == 0, "en").otherwise("fa").alias("language"), (F.col("event_type") == "error").alias("failed"), F.when(F.col("event_id") % 11 != 0, F.col("value") / 30).alias("correctness"),
        F.when(F.col("event_id") % 3 == 0, F.lit(5.0)).alias("readability"), F.when(F.col("event_id") % 17 != 0, "none").alias("hallucination"),
    )
    given = [F.col(c).isNotNull() for c in ("correctness", "readability", "hallucination")]
    done = ~F.col("failed")
    reasons = F.array_compact(F.array(
        F.when(F.col("failed") & (given[0] | given[1] | given[2]), "failed record was scored"), F.when(done & ~F.coalesce(F.col("correctness").between(0, 10), F.lit(False)), "invalid correctness"),
        F.when(done & (F.col("language") == "fa") & ~given[1], "readability is required"), F.when(done & (F.col("language") == "en") & given[1], "readability must be null"), F.when(done & ~given[2], "no hallucination rating"),
    ))
    return r.select("event_id", F.explode(reasons).alias("reason"))


@query("""WITH r AS (SELECT event_type AS arm, user_id AS question, user_id % 3 AS repository, CASE WHEN event_id % 97 = 0 THEN 'odd' WHEN event_id % 2 = 0 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN event_id % 89 = 0 THEN 'other text' ELSE 'q' || user_id END AS text FROM events),
w AS (SELECT repository, count(DISTINCT question) AS want FROM r GROUP BY ALL), t AS (SELECT question, count(DISTINCT text) AS texts FROM r GROUP BY ALL)
SELECT arm, repository, count(DISTINCT question) AS questions, count(*) FILTER (WHERE status NOT IN ('ok', 'failed')) AS invalid_status, count(DISTINCT CASE WHEN texts > 1 THEN question END) AS changed_texts,
count(DISTINCT question) = max(want) AND count(*) FILTER (WHERE status NOT IN ('ok', 'failed')) = 0 AND count(*) FILTER (WHERE texts > 1) = 0 AS complete FROM r JOIN w USING (repository) JOIN t USING (question) GROUP BY ALL""")
def arm_completeness_full(spark, sf):
    """Whether each arm ran all questions of each repository, with known states and the same question text as the others."""
    e = table(spark, sf, "events")
    status = F.when(F.col("event_id") % 97 == 0, "odd").when(F.col("event_id") % 2 == 0, "ok").otherwise("failed")
    text = F.when(F.col("event_id") % 89 == 0, "other text").otherwise(F.concat(F.lit("q"), F.col("user_id").cast("string")))
    r = e.select(F.col("event_type").alias("arm"), F.col("user_id").alias("question"), (F.col("user_id") % 3).alias("repository"), status.alias("status"), text.alias("text"))
    want, texts = r.groupBy("repository").agg(F.countDistinct("question").alias("want")), r.groupBy("question").agg(F.countDistinct("text").alias("texts"))
    odd = ~F.col("status").isin("ok", "failed")
    g = r.join(texts, "question").groupBy("arm", "repository").agg(F.countDistinct("question").alias("questions"), F.count_if(odd).alias("invalid_status"), F.countDistinct(F.when(F.col("texts") > 1, F.col("question"))).alias("changed_texts"))
    whole = (F.col("questions") == F.col("want")) & (F.col("invalid_status") == 0) & (F.col("changed_texts") == 0)
    return g.join(want, "repository").withColumn("complete", whole).drop("want")


# Contexts

BUDGETS = (6000, 8000, 10000)


@query(" UNION ALL ".join(f"""SELECT {b} AS budget, count(*) AS questions, CAST(sum(found) AS BIGINT) AS gold_found, CAST(sum(gold) AS BIGINT) AS gold_total, count(*) FILTER (WHERE found = gold) AS full_gold, round(avg(used), 6) AS mean_chars, round(avg(n), 6) AS mean_blocks, round(avg(omitted), 6) AS mean_omitted
FROM (SELECT p.used AS used, p.omitted AS omitted, len(p.ids) AS n, len(list_filter(p.ids, lambda x: x % 7 = 0)) AS found, gold FROM (SELECT source, {FOLD.format(budget=b)} AS p, count(*) FILTER (WHERE doc_id % 7 = 0) AS gold FROM documents GROUP BY source))""" for b in BUDGETS))
def budget_sweep_full(spark, sf):
    """Packing at three budgets: gold found and wholly found, mean length, blocks and omissions."""
    b = blocks(spark, sf)
    gold = b.groupBy("source").agg(F.count_if(F.col("chunk_id") % 7 == 0).alias("gold"))

    def at(budget: int) -> DataFrame:
        found = F.size(F.filter("chunk_ids", lambda x: x % 7 == 0))
        p = cx.pack(b, "source", budget).select("source", "total_chars", "omitted", F.size("chunk_ids").alias("n"), found.alias("found")).join(gold, "source")
        return p.agg(F.count("*").alias("questions"), F.sum("found").alias("gold_found"), F.sum("gold").alias("gold_total"), F.count_if(F.col("found") == F.col("gold")).alias("full_gold"), *[F.round(F.avg(c), 6).alias(f"mean_{k}") for c, k in (("total_chars", "chars"), ("n", "blocks"), ("omitted", "omitted"))]).select(F.lit(budget).alias("budget"), "*")

    return reduce(DataFrame.unionAll, map(at, BUDGETS))


@query("""WITH c AS (SELECT source, doc_id, text, least(length(text), 1400) AS capped FROM documents WHERE text IS NOT NULL), s AS (SELECT *, 6000 - coalesce(sum(capped) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM c),
t AS (SELECT source, doc_id, text, CAST(greatest(least(capped, rest), 0) AS BIGINT) AS taken FROM s WHERE least(capped, rest) > 0)
SELECT source, doc_id AS chunk_id, taken, 1 + length(substr(text, 1, taken)) - length(replace(substr(text, 1, taken), chr(10), '')) AS end_line FROM t""")
def quota_pack_lines(spark, sf):
    """Blocks cut to their cap and to what is left of the budget, and the line that each now ends in."""
    texts = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), "text")
    taken = cx.quota_pack(blocks(spark, sf).where("chars IS NOT NULL"), "source", 1400)
    part = F.substring(F.col("text"), F.lit(1), F.col("taken").cast("int"))
    ends = 1 + F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))
    return taken.join(texts, "chunk_id").select("source", "chunk_id", "taken", ends.alias("end_line"))


@query(f"""WITH q AS (SELECT conv_id, list_distinct({WORDS.format('text')}) AS asked FROM conversations WHERE turn = 0), h AS (SELECT c.conv_id, c.turn, len(list_intersect(list_distinct({WORDS.format('c.text')}), q.asked)) AS hits FROM conversations c JOIN q USING (conv_id) WHERE c.turn > 0)
SELECT conv_id, turn, CAST(hits AS INT) AS hits, 'method' AS kind FROM h QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, turn) <= 2 UNION ALL SELECT conv_id, turn, 0, 'header' FROM conversations WHERE turn = 0""")
def method_selection_full(spark, sf):
    """The header of each class and the two methods that share most words with the question (the first turn)."""
    c = table(spark, sf, "conversations")
    asked = c.where("turn = 0").select("conv_id", tx.word_set(F.col("text")).alias("asked"))
    h = c.where("turn > 0").join(asked, "conv_id").select("conv_id", "turn", F.size(F.array_intersect(tx.word_set(F.col("text")), "asked")).alias("hits"))
    best = rank.top_k(h, ["conv_id"], [F.desc("hits"), F.asc("turn")], 2).select("conv_id", "turn", "hits", F.lit("method").alias("kind"))
    return best.unionAll(c.where("turn = 0").select("conv_id", "turn", F.lit(0), F.lit("header")))


@query(f"""WITH q AS (SELECT list_distinct({WORDS.format('text')}) AS asked FROM benchmark WHERE item_id = 0), m AS (SELECT doc_id, CAST(i AS INT) AS line, string_split(text, '. ')[i] AS body FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, '. ')) + 1)) AS i FROM documents WHERE length(text) > 6000)),
h AS (SELECT doc_id, line, length(body) AS chars, CAST(len(list_intersect(list_distinct({WORDS.format('body')}), asked)) AS INT) AS hits FROM m, q)
SELECT doc_id, '#' || line AS piece, chars, hits, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, line) AS INT) AS place FROM h WHERE line > 1 UNION ALL SELECT doc_id, '#header', chars, hits, 0 FROM h WHERE line = 1""")
def large_class_expansion_full(spark, sf):
    """Chunks over 6000 characters as a header and one piece a method (sentence), pieces with more of the question's words first."""
    asked = table(spark, sf, "benchmark").where("item_id = 0").select(tx.word_set(F.col("text")).alias("asked"))  # one row
    d = table(spark, sf, "documents").where(F.length("text") > 6000)
    h = d.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "body")).crossJoin(F.broadcast(asked)).select("doc_id", (F.col("pos") + 1).alias("line"), F.length("body").cast("long").alias("chars"), F.size(F.array_intersect(tx.word_set(F.col("body")), "asked")).alias("hits"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("hits"), F.asc("line")))
    pieces = h.where("line > 1").select("doc_id", F.concat(F.lit("#"), F.col("line").cast("string")).alias("piece"), "chars", "hits", place.alias("place"))
    return pieces.unionAll(h.where("line = 1").select("doc_id", F.lit("#header"), "chars", "hits", F.lit(0)))


@query("""WITH s AS (SELECT doc_id, source || '.' || lang || '.f' || (doc_id % 50) AS name, source AS root, 'f' || (doc_id % 50) AS short FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
q AS (SELECT doc_id AS question_id, CASE doc_id // 20 % 4 WHEN 0 THEN 'how does ' || upper(name) || ' work' WHEN 1 THEN 'what is ' || root || ' for' WHEN 2 THEN 'where is ' || short || ' called' ELSE 'tell me more' END AS text, doc_id % 200 AS g FROM s WHERE doc_id % 20 = 0),
h AS (SELECT question_id, s.doc_id AS chunk_id, CASE WHEN regexp_matches(q.text, '(?i)(^|[^A-Za-z0-9_.])' || replace(name, '.', '\\.') || '($|[^A-Za-z0-9_])') THEN 3 WHEN regexp_matches(q.text, '(^|[^A-Za-z0-9_.])' || root || '($|[^A-Za-z0-9_.])') THEN 2 WHEN regexp_matches(q.text, '(^|[^A-Za-z0-9_.])' || short || '($|[^A-Za-z0-9_.])') THEN 1 ELSE 0 END AS tier FROM q JOIN s ON s.doc_id % 200 = q.g)
SELECT question_id, chunk_id, tier FROM h QUALIFY tier = max(tier) OVER (PARTITION BY question_id)""")
def named_symbol_focus_full(spark, sf):
    """Hits whose dotted name the question mentions, else those whose class it mentions, else whose bare name, else all."""
    s = symbol_rows(spark, sf).where("qualified IS NOT NULL").select("doc_id", F.col("qualified").alias("name"), tx.class_root(F.col("qualified")).alias("root"), tx.short_symbol(F.col("qualified")).alias("short"))
    kind = F.floor(F.col("doc_id") / 20) % 4
    text = F.when(kind == 0, F.concat(F.lit("how does "), F.upper("name"), F.lit(" work"))).when(kind == 1, F.concat(F.lit("what is "), "root", F.lit(" for"))).when(kind == 2, F.concat(F.lit("where is "), "short", F.lit(" called"))).otherwise("tell me more")
    q = s.where("doc_id % 20 = 0").select(F.col("doc_id").alias("question_id"), text.alias("text"), (F.col("doc_id") % 200).alias("g"))
    return focus(q, s.withColumn("g", F.col("doc_id") % 200))


def focus(q: DataFrame, s: DataFrame) -> DataFrame:
    """(question_id, chunk_id, tier): the chunks (g, doc_id, name, root, short) of the greatest tier for each question (g, question_id, text).

    A tier depends on the texts alone, so each distinct question is matched with each distinct name of its g once, and
    the chunks are joined to the names that are left.
    """
    asked, name = F.col("text"), ["g", "name", "root", "short"]
    tier = F.when(tx.mentions(asked, F.col("name")), 3).when(tx.mentions(asked, F.col("root"), True), 2).when(~F.col("short").startswith("__") & tx.mentions(asked, F.col("short"), True), 1).otherwise(0)
    pairs = q.select("g", "text").distinct().join(s.select(*name).distinct(), "g").repartition(session_partitions(q.sparkSession), "text", "name")
    best = stage_table(cx.best_tier(pairs, ["g", "text"], tier), "tiers")
    return q.join(best, ["g", "text"]).join(s, name).select("question_id", F.col("doc_id").alias("chunk_id"), "tier")


@query("""WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"a": ' || (event_id % 25) || ', "b": 7}' WHEN 1 THEN '```json' || chr(10) || '{"a": 3, "b": ' || (1 + event_id % 20) || '}' || chr(10) || '```' WHEN 2 THEN '{"a": 4}' WHEN 3 THEN 'no json' ELSE '{"a": 2.5, "b": 1}' END AS reply FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 25 BETWEEN 1 AND 20 THEN CAST(event_id % 25 AS INT) END WHEN 1 THEN 3 END AS a, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 25 BETWEEN 1 AND 20 THEN 7 END WHEN 1 THEN CAST(1 + event_id % 20 AS INT) END AS b FROM r""")
def judge_replies(spark, sf):
    """Scores out of the judge's JSON replies, fenced or not; null where one is missing, no whole number or out of range."""
    n = F.col("event_id")
    reply = (
        F.when(n % 5 == 0, F.concat(F.lit('{"a": '), (n % 25).cast("string"), F.lit(', "b": 7}'))).when(n % 5 == 1, F.concat(F.lit('```json\n{"a": 3, "b": '), (1 + n % 20).cast("string"), F.lit("}\n```")))
        .when(n % 5 == 2, '{"a": 4}').when(n % 5 == 3, "no json").otherwise('{"a": 2.5, "b": 1}')
    )
    return table(spark, sf, "events").select("event_id", tx.judge_scores(reply, ("a", "b")).alias("s")).select("event_id", "s.a", "s.b")


@query("WITH c AS (SELECT conv_id || '-' || role || '-' || (turn % 2) AS case_id, length(text) AS n FROM conversations) SELECT regexp_replace(case_id, '-[^-]*$', '') AS concept, count(*) AS cases, round(avg(n), 6) AS mean FROM c GROUP BY ALL")
def case_concepts(spark, sf):
    """Cases grouped by the concept that their id begins with."""
    case = F.concat_ws("-", F.col("conv_id").cast("string"), "role", (F.col("turn") % 2).cast("string"))
    return table(spark, sf, "conversations").groupBy(tx.case_concept(case).alias("concept")).agg(F.count("*").alias("cases"), F.round(F.avg(F.length("text")), 6).alias("mean"))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def stable_cosine(spark, sf):
    """Cosine of neighbours by compensated sums."""
    from siltstone.functions import vectors as vx

    v = table(spark, sf, "embeddings").select("vec_id", vx.doubles(F.col("embedding")).alias("a"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").select("vec_id", F.round(vx.stable_cosine(F.col("a"), F.col("b")), 9).alias("cosine"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at FROM events")
def utc_timestamps(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.utc_text(F.col("ts")).alias("at"))


@query(f"""WITH p AS (SELECT source, {FOLD.format(budget=6000)} AS p FROM documents WHERE text IS NOT NULL GROUP BY source), t AS (SELECT source, unnest(p.ids) AS doc_id FROM p),
g AS (SELECT source, count(*) AS gold, count(DISTINCT lang) AS langs FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL GROUP BY source),
f AS (SELECT d.source, count(*) FILTER (WHERE t.doc_id IS NOT NULL) AS found FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id WHERE d.doc_id % 50 = 0 AND d.text IS NOT NULL GROUP BY d.source),
l AS (SELECT x.source, count(DISTINCT x.lang) AS named FROM documents x WHERE x.doc_id % 50 = 0 AND x.text IS NOT NULL AND EXISTS (SELECT 1 FROM t JOIN documents y ON y.doc_id = t.doc_id WHERE t.source = x.source AND y.lang = x.lang) GROUP BY x.source)
SELECT count(*) AS questions, count(gold) AS scored, round(avg(found / CAST(gold AS DOUBLE)), 6) AS gold_file_coverage, round(avg(CASE WHEN langs > 0 THEN coalesce(named, 0) / CAST(langs AS DOUBLE) END), 6) AS identifier_coverage,
round(avg(len(p.ids)), 6) AS mean_blocks, round(avg(p.used), 6) AS mean_chars, round(avg(p.omitted), 6) AS mean_omitted FROM p LEFT JOIN g USING (source) LEFT JOIN f USING (source) LEFT JOIN l USING (source)""")
def delivered_evidence_full(spark, sf):
    """Gold files and identifiers that the packed blocks cover (null without gold), blocks, characters and omissions."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    p = cx.pack(blocks(spark, sf).where("chars IS NOT NULL"), "source")
    taken = p.select(F.explode("chunk_ids").alias("doc_id")).join(d.select("doc_id", "source", "lang"), "doc_id")
    gold = d.where("doc_id % 50 = 0").select("doc_id", "source", "lang")
    held = gold.join(taken.select("doc_id", F.lit(True).alias("held")), "doc_id", "left").groupBy("source").agg(F.count("*").alias("gold"), F.count("held").alias("found"), F.countDistinct("lang").alias("langs"))
    named = gold.select("source", "lang").distinct().join(taken.select("source", "lang").distinct(), ["source", "lang"], "left_semi").groupBy("source").agg(F.count("lang").alias("named"))
    all_ = p.join(held, "source", "left").join(named, "source", "left")
    return all_.agg(
        F.count("*").alias("questions"), F.count("gold").alias("scored"), F.round(F.avg(F.col("found") / F.col("gold")), 6).alias("gold_file_coverage"),
        F.round(F.avg(F.when(F.col("langs") > 0, F.coalesce("named", F.lit(0)) / F.col("langs"))), 6).alias("identifier_coverage"), F.round(F.avg(F.size("chunk_ids")), 6).alias("mean_blocks"),
        F.round(F.avg("total_chars"), 6).alias("mean_chars"), F.round(F.avg("omitted"), 6).alias("mean_omitted"),
    )


BY_STRATUM = BOOT.replace("OVER (ORDER BY mean, resample)", "OVER (PARTITION BY stratum ORDER BY mean, resample)")


@query(f"WITH {PAIRS}" + BY_STRATUM.format(keys="stratum", part="stratum", value="a - b", source="p", seed=11, name="stratum", b=20000, out="stratum,") + f""", i AS (SELECT stratum, round(max(CASE WHEN k = 500 THEN mean END), 6) AS ci_low, round(max(CASE WHEN k = 250 THEN mean END), 6) AS ci_low_975 FROM o GROUP BY stratum),
c AS (SELECT stratum, count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a < b) AS losses FROM p GROUP BY stratum), t AS (SELECT stratum, round({tail_sql("wins", "losses")}, 9) AS p FROM c),
s AS (SELECT stratum, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, stratum) + 1) * p) AS s FROM t WHERE p IS NOT NULL), a AS (SELECT stratum, max(s) OVER (ORDER BY p, stratum ROWS UNBOUNDED PRECEDING) AS adjusted FROM s)
SELECT stratum, ci_low, ci_low_975, p, round(adjusted, 6) AS adjusted, coalesce(adjusted < 0.05 AND ci_low > 0, false) AS superior, ci_low_975 > -20 AS non_inferior FROM i JOIN t USING (stratum) LEFT JOIN a USING (stratum)""")
def superiority_decision_adjusted(spark, sf):
    """Superior if the Holm-adjusted p is under 0.05 and the interval above zero; not inferior by the lower bound at 97.5 %."""
    p = paired(spark, sf).withColumn("d", F.col("a") - F.col("b"))
    means = stage_table(stats.bootstrap(p, "d", ["user_id"], [], 20000, 11, by=["stratum"]), "means")
    low, deep = stats.interval(means, ["stratum"], 20000).select("stratum", "ci_low"), stats.interval(means, ["stratum"], 20000, 0.975).select("stratum", F.col("ci_low").alias("ci_low_975"))
    tests = p.groupBy("stratum").agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses")).select("stratum", F.round(stats.two_sided_binomial("wins", "losses"), 9).alias("p"))
    held = stats.holm(tests, "p", [], "stratum").select("stratum", "p", "adjusted")
    superior = F.coalesce((F.col("adjusted") < 0.05) & (F.col("ci_low") > 0), F.lit(False))
    return low.join(deep, "stratum").join(held, "stratum").select("stratum", "ci_low", "ci_low_975", "p", F.round("adjusted", 6).alias("adjusted"), superior.alias("superior"), (F.col("ci_low_975") > -20).alias("non_inferior"))


@query(None)
def vector_digests(spark, sf):
    """SHA-256 of every vector as packed 32-bit floats, which SQL cannot pack."""
    from siltstone.functions import vectors as vx

    return table(spark, sf, "embeddings").select("vec_id", vx.vector_digest(F.col("embedding")).alias("digest"))


FORBIDDEN = ("idiot", "moron")


@query(f"""WITH q AS (SELECT conv_id, list_slice(list_sort(list_filter(list_distinct({WORDS.format('text')}), lambda w: length(w) >= 6)), 1, 4) AS facts FROM conversations WHERE turn = 0),
f AS (SELECT c.conv_id, c.turn, CASE WHEN len(facts) > 0 THEN 10.0 * len(list_filter(facts, lambda w: contains(lower(c.text), w))) / len(facts) END AS recall, contains(lower(c.text), '{FORBIDDEN[0]}') OR contains(lower(c.text), '{FORBIDDEN[1]}') AS forbidden FROM conversations c JOIN q USING (conv_id) WHERE c.turn > 0),
g AS (SELECT conv_id, avg(recall) AS recall, bool_or(forbidden) AS forbidden FROM f GROUP BY conv_id)
SELECT count(*) AS questions, count(recall) AS scored, round(avg(recall), 6) AS mean_recall, round(avg(CASE WHEN forbidden THEN 1.0 ELSE 0 END), 6) AS forbidden_rate, count(*) FILTER (WHERE recall >= 10) AS complete FROM g""")
def fact_recall_full(spark, sf):
    """Ten times the share of each question's own facts that answers hold (null without facts), and how often any holds a forbidden one."""
    c = table(spark, sf, "conversations")
    words = F.filter(tx.word_set(F.col("text")), lambda w: F.length(w) >= 6)
    q = c.where("turn = 0").select("conv_id", F.slice(F.sort_array(words), 1, 4).alias("facts"))
    low = F.lower("text")
    a = c.where("turn > 0").join(q, "conv_id")
    recall = F.when(F.size("facts") > 0, 10.0 * F.size(F.filter("facts", lambda w: F.contains(low, w))) / F.size("facts"))
    forbidden = reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in FORBIDDEN])
    g = a.groupBy("conv_id").agg(F.avg(recall).alias("recall"), F.bool_or(forbidden).alias("forbidden"))
    return g.agg(F.count("*").alias("questions"), F.count("recall").alias("scored"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg(F.col("forbidden").cast("double")), 6).alias("forbidden_rate"), F.count_if(F.col("recall") >= 10).alias("complete"))


@query("""WITH f AS (SELECT DISTINCT 'p' || CASE WHEN role = 'system' THEN 0 ELSE conv_id % 3 END || '/src/' || role || '.py' AS file FROM conversations UNION SELECT DISTINCT 'lib/x' || (conv_id % 5) || '.py' FROM conversations UNION SELECT DISTINCT 'src/' || role || conv_id % 2 || '.py' FROM conversations),
d AS (SELECT DISTINCT 'src/' || role || '.py' AS path FROM conversations UNION SELECT DISTINCT 'lib/x' || (conv_id % 7) || '.py' FROM conversations UNION SELECT DISTINCT role || conv_id % 3 || '.py' FROM conversations),
m AS (SELECT path, file, 1 AS tier FROM d JOIN f ON path = file UNION ALL SELECT path, file, 2 FROM d JOIN f ON 'src/' || path = file UNION ALL SELECT path, file, 3 FROM d JOIN f ON ends_with(file, '/' || path)),
b AS (SELECT *, min(tier) OVER (PARTITION BY path) AS best FROM m) SELECT path, min(file) AS file, min(tier) AS tier FROM b WHERE tier = best GROUP BY path HAVING count(*) = 1""")
def suffix_join_full(spark, sf):
    """Cited paths against the files of a table: equal, else below src/, else by an ending that one file alone has; endings are ranges of reversed names."""
    c = table(spark, sf, "conversations")
    role, conv = F.col("role"), F.col("conv_id")

    def named(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    f = c.select(F.explode(F.array(named("p", F.when(role == "system", 0).otherwise(conv % 3), "/src/", role, ".py"), named("lib/x", conv % 5, ".py"), named("src/", role, conv % 2, ".py"))).alias("file")).distinct()
    d = c.select(F.explode(F.array(named("src/", role, ".py"), named("lib/x", conv % 7, ".py"), named(role, conv % 3, ".py"))).alias("path")).distinct()
    return endings.resolve(d, f)
