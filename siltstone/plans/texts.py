"""Lexical retrieval and text functions over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import postings, rank
from siltstone.plans.standins import table
from siltstone.runtime import shared_dir

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


@query(f"""WITH q AS (SELECT item_id, unnest(list_distinct({WORDS.format('text')})) AS term FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct({WORDS.format('text')})) AS term FROM documents), s AS (SELECT item_id AS question_id, doc_id AS chunk_id, CAST(count(*) AS DOUBLE) AS score FROM d JOIN q USING (term) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s) SELECT question_id, rank, chunk_id, score FROM k WHERE rank <= 10""")
def lexical_topk(spark, sf):
    """Distinct shared words of every benchmark text with every document, top 10."""
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("code"))
    return rank.lexical(questions, chunks, 10).select("question_id", "rank", "chunk_id", "score")


LEXICAL = SQL["lexical_topk"]


@query(LEXICAL)
def lexical_indexed(spark, sf):
    """The same list from a stored term index, of which only the buckets of the questions' terms are read."""
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("code"))
    index = postings.TermIndex.build(chunks, shared_dir(spark, "terms"), {"code": 1})
    return index.search(questions, 10).select("question_id", "rank", "chunk_id", "score")


@query(f"""WITH q AS (SELECT item_id, unnest(list_distinct({WORDS.format('text')})) AS term FROM benchmark),
f AS (SELECT doc_id, source, lang || ' ' || source AS qualified_name, text FROM documents),
d AS (SELECT doc_id, source, unnest(list_distinct({WORDS.format('qualified_name')})) AS term, 3 AS w FROM f UNION ALL SELECT doc_id, source, unnest(list_distinct({WORDS.format('source')})), 2 FROM f UNION ALL SELECT doc_id, source, unnest(list_distinct({WORDS.format('text')})), 1 FROM f),
s AS (SELECT item_id AS question_id, doc_id AS chunk_id, source, CAST(sum(w) AS DOUBLE) AS score FROM d JOIN q USING (term) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source, chunk_id) AS INT) AS rank FROM s) SELECT question_id, rank, chunk_id, score FROM k WHERE rank <= 10""")
def lexical_weighted_fields(spark, sf):
    """Weights 3, 2 and 1 for name, file and code."""
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    docs = table(spark, sf, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_file"), F.concat_ws(" ", "lang", "source").alias("qualified_name"), F.col("text").alias("code"))
    return rank.lexical(questions, chunks, 10).select("question_id", "rank", "chunk_id", "score")


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND source = 'src3'")
def slice_filter(spark, sf):
    """Equality filters joined by AND, pushed to the scan."""
    return table(spark, sf, "documents").where("lang = 'en' AND source = 'src3'").select("doc_id", "source")


@query(f"SELECT doc_id, CAST(len({WORDS.format('text')}) AS INT) AS n_words, CAST(len(list_distinct({WORDS.format('text')})) AS INT) AS n_distinct FROM documents")
def tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tx.words(F.col("text"))).alias("n_words"), F.size(tx.word_set(F.col("text"))).alias("n_distinct"))


@query("SELECT conv_id, turn, sha256(text) AS content_hash, sha256(conv_id || chr(0) || role || chr(0) || turn || chr(0) || '1:2' || chr(0) || sha256(text)) AS chunk_id FROM conversations")
def chunk_identity(spark, sf):
    c = table(spark, sf, "conversations")
    content = F.sha2("text", 256)
    return c.select("conv_id", "turn", content.alias("content_hash"), tx.chunk_identity(F.col("conv_id").cast("string"), F.col("role"), F.col("turn").cast("string"), F.lit(1), F.lit(2), content).alias("chunk_id"))


@query("SELECT source, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS digest, count(*) AS n FROM documents GROUP BY source")
def corpus_digest(spark, sf):
    """SHA-256 over the ordered content hashes of each source."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))), lambda x: x["h"])
    return table(spark, sf, "documents").groupBy("source").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"), F.count("*").alias("n"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS h FROM documents")
def newline_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.newline_hash(F.col("text")).alias("h"))


@query("SELECT conv_id, turn, sha256('path: ' || conv_id || chr(10) || 'chunk_type: ' || role || chr(10) || 'symbol_kind: ' || chr(10) || 'qualified_name: ' || chr(10) || 'parent: ' || chr(10) || 'is_async: False' || chr(10) || 'parameters: ' || chr(10) || 'returns: ' || chr(10) || 'decorators: ' || chr(10) || 'bases: ' || chr(10) || 'docstring: ' || chr(10) || 'source:' || chr(10) || text) AS h FROM conversations")
def embedding_text(spark, sf):
    body = tx.embedding_text(path=F.col("conv_id"), chunk_type=F.col("role"), is_async=F.lit("False"), source=F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(body, 256).alias("h"))


@query("SELECT conv_id, turn, sha256('head' || chr(10) || 'identifier_terms: ' || role || chr(10) || 'source:' || chr(10) || text) AS h FROM conversations")
def representation_v2(spark, sf):
    """The embedding text with a line of identifier terms before its source."""
    body = tx.with_identifier_terms(F.concat(F.lit("head\nsource:\n"), F.col("text")), F.array("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(body, 256).alias("h"))


@query(r"SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '(?i)^[^A-Za-z0-9_]*(there is )?not enough retrieved evidence')) AS refused, round(median(length(text)), 6) AS median_chars FROM conversations GROUP BY role")
def refusal_rates(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(tx.is_refusal(F.col("text"))).alias("refused"), F.round(F.median(F.length("text")), 6).alias("median_chars"))


@query(r"SELECT page_id, regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1) AS tags FROM pages")
def markup_tokens_full(spark, sf):
    """All tags of each page."""
    return table(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", F.lit("<([a-z0-9]+)[ >]"), F.lit(1)).alias("tags"))


ANSWERS = "a AS (SELECT conv_id, turn, 'see src/' || role || '.py:' || (turn + 1) || '-' || (turn + 5) || ' and lib/x' || (conv_id % 7) || '.py:' || (conv_id + 1) || ' `' || role || '_name` `abc`. ' || text AS answer FROM conversations)"


def answers(spark, sf):
    """Answers with citations and names in back-ticks, made from the conversations."""
    parts = F.concat(F.lit("see src/"), F.col("role"), F.lit(".py:"), (F.col("turn") + 1).cast("string"), F.lit("-"), (F.col("turn") + 5).cast("string"), F.lit(" and lib/x"), (F.col("conv_id") % 7).cast("string"), F.lit(".py:"), (F.col("conv_id") + 1).cast("string"), F.lit(" `"), F.col("role"), F.lit("_name` `abc`. "), F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", parts.alias("answer"))


CITES = r"c AS (SELECT conv_id, turn, unnest(regexp_extract_all(answer, '[A-Za-z0-9_./-]+\.py:\d+(-\d+)?')) AS c FROM a), p AS (SELECT conv_id, turn, regexp_extract(c, '^(.*\.py):', 1) AS path, CAST(regexp_extract(c, '\.py:(\d+)', 1) AS BIGINT) AS s, CAST(coalesce(nullif(regexp_extract(c, '-(\d+)$', 1), ''), regexp_extract(c, '\.py:(\d+)', 1)) AS BIGINT) AS e FROM c)"


def citations(spark, sf):
    return cite(answers(spark, sf), ["conv_id", "turn"])


def cite(rows, keys):
    """A row (path, s, e) for each citation of an answer; a single line is its own end."""
    found = [F.regexp_extract_all("answer", F.lit(tx.CITATION), F.lit(g)) for g in (1, 2, 3)]
    one = F.explode(F.arrays_zip(*[x.alias(n) for x, n in zip(found, "pse", strict=True)]))
    c = rows.select(*keys, one.alias("c"))
    start = F.col("c.s").cast("bigint")
    return c.select(*keys, F.col("c.p").alias("path"), start.alias("s"), F.coalesce(F.nullif(F.col("c.e"), F.lit("")).cast("bigint"), start).alias("e"))


@query(f"WITH {ANSWERS}, {CITES} SELECT conv_id, turn, path, s, e FROM p")
def citation_extract(spark, sf):
    return citations(spark, sf)


@query(f"""WITH {ANSWERS}, {CITES}, v AS (SELECT conv_id, turn, path IN ('src/user.py', 'src/assistant.py') OR path LIKE 'lib/%' AS known, s >= 1 AND e >= s AS ordered, e <= 40 AS inside FROM p)
SELECT count(*) AS citations, count(*) FILTER (WHERE known) AS known_files, count(*) FILTER (WHERE ordered) AS ordered_ranges, count(*) FILTER (WHERE inside) AS inside_files, (SELECT count(*) FROM (SELECT conv_id, turn FROM v GROUP BY ALL HAVING bool_and(known AND ordered AND inside))) AS answers_all_valid FROM v""")
def citation_structural_totals(spark, sf):
    """Checks of every citation, and answers whose citations all hold."""
    known = F.col("path").isin("src/user.py", "src/assistant.py") | F.col("path").startswith("lib/")
    v = citations(spark, sf).select("conv_id", "turn", known.alias("known"), ((F.col("s") >= 1) & (F.col("e") >= F.col("s"))).alias("ordered"), (F.col("e") <= 40).alias("inside"))
    per = v.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("known", "ordered", "inside")], F.bool_and(F.col("known") & F.col("ordered") & F.col("inside")).alias("whole"))
    return per.agg(F.sum("n").alias("citations"), F.sum("known").alias("known_files"), F.sum("ordered").alias("ordered_ranges"), F.sum("inside").alias("inside_files"), F.count_if("whole").alias("answers_all_valid"))


@query(f"""WITH {ANSWERS}, {CITES}, v AS (SELECT conv_id, turn, CAST(path LIKE 'src/%' AS INT) AS strict, CAST(e <= 40 AS INT) AS lenient FROM p), q AS (SELECT conv_id, turn, avg(strict) AS s, avg(lenient) AS l FROM v GROUP BY ALL)
SELECT round((SELECT avg(strict) FROM v), 6) AS pooled_strict, round((SELECT avg(lenient) FROM v), 6) AS pooled_lenient, round(avg(s), 6) AS mean_strict, round(avg(l), 6) AS mean_lenient FROM q""")
def citation_precision(spark, sf):
    """Pooled ratio and mean of the answers' ratios."""
    v = citations(spark, sf).select("conv_id", "turn", F.col("path").startswith("src/").cast("double").alias("strict"), (F.col("e") <= 40).cast("double").alias("lenient"))
    q = v.groupBy("conv_id", "turn").agg(F.sum("strict").alias("ss"), F.sum("lenient").alias("ls"), F.count("*").alias("n"))
    return q.agg(F.round(F.sum("ss") / F.sum("n"), 6).alias("pooled_strict"), F.round(F.sum("ls") / F.sum("n"), 6).alias("pooled_lenient"), F.round(F.avg(F.col("ss") / F.col("n")), 6).alias("mean_strict"), F.round(F.avg(F.col("ls") / F.col("n")), 6).alias("mean_lenient"))


@query(f"""WITH {ANSWERS}, i AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(answer, '`([^`' || chr(10) || ']+)`', 1), lambda q: regexp_extract_all(q, '[A-Za-z_][A-Za-z0-9_]*'))), lambda n: length(n) >= 4 AND n NOT IN ('None', 'True', 'False', 'self', 'return', 'class')))) AS name FROM a) SELECT conv_id, turn, name FROM i""")
def backtick_identifiers(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", F.explode(tx.backtick_identifiers(F.col("answer"))).alias("name"))


@query(f"""WITH {ANSWERS}, i AS (SELECT a.conv_id, a.turn, unnest(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(answer, '`([^`' || chr(10) || ']+)`', 1), lambda q: regexp_extract_all(q, '[A-Za-z_][A-Za-z0-9_]*'))), lambda n: length(n) >= 4))) AS name FROM a)
SELECT count(*) AS names, count(*) FILTER (WHERE NOT contains(c.text, i.name)) AS unsupported, round(count(*) FILTER (WHERE NOT contains(c.text, i.name)) / count(*), 6) AS share FROM i JOIN conversations c USING (conv_id, turn)""")
def unsupported_share(spark, sf):
    """Names of an answer that its context does not hold."""
    names = answers(spark, sf).select("conv_id", "turn", F.explode(tx.backtick_identifiers(F.col("answer"))).alias("name"))
    joined = names.join(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    missing = F.count_if(~F.contains("text", "name"))
    return joined.agg(F.count("*").alias("names"), missing.alias("unsupported"), F.round(missing / F.count("*"), 6).alias("share"))


@query(f"WITH {ANSWERS} SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(answer, '\\s*[\\[(]?[A-Za-z0-9_./-]+\\.py:\\d+(-\\d+)?[\\])]?', '', 'g'), ' {{2,}}', ' ', 'g'), ' ')) AS h FROM a")
def citation_strip(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", F.md5(tx.strip_citations(F.col("answer"))).alias("h"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+:/', ''), '\\\\', '/', 'g'), '^/+', '') AS path, regexp_matches(regexp_replace(url, '^[a-z]+:/', ''), '^(/|\\\\|[A-Za-z]:)') AS is_absolute FROM pages")
def path_normalise(spark, sf):
    bare = F.regexp_replace("url", "^[a-z]+:/", "")
    return table(spark, sf, "pages").select("page_id", tx.normal_path(bare).alias("path"), tx.is_absolute(bare).alias("is_absolute"))


@query("""WITH s AS (SELECT page_id, unnest(string_split(regexp_extract(url, '://([^?#]*)', 1), '/')) AS part, generate_subscripts(string_split(regexp_extract(url, '://([^?#]*)', 1), '/'), 1) AS depth FROM pages), d AS (SELECT page_id, depth, (SELECT string_agg(part, '/' ORDER BY depth) FROM s b WHERE b.page_id = a.page_id AND b.depth <= a.depth) AS prefix FROM s a)
SELECT CAST(depth AS INT) AS depth, prefix, count(DISTINCT page_id) AS pages FROM d GROUP BY ALL""")
def file_tree(spark, sf):
    """Every folder prefix of the paths with what lies below it."""
    parts = F.split(F.regexp_extract("url", "://([^?#]*)", 1), "/")
    p = table(spark, sf, "pages").select("page_id", parts.alias("parts"))
    d = p.select("page_id", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts").select("page_id", "depth", F.array_join(F.expr("slice(parts, 1, depth)"), "/").alias("prefix"))
    return d.groupBy("depth", "prefix").agg(F.countDistinct("page_id").alias("pages"))


@query("SELECT page_id FROM pages WHERE contains(lower(url), 'blog')")
def explorer_filter(spark, sf):
    return table(spark, sf, "pages").where(F.lower("url").contains("blog")).select("page_id")


@query("""SELECT item_id, unnest(CASE WHEN length(text) >= 120 AND len(p) > 1 THEN list_transform(p, lambda x: CASE WHEN regexp_matches(x, '(?i)^(what|how|why|where|when|which|who|does|is|are)\\b') THEN x ELSE 'What ' || x END) ELSE [text] END) AS part
FROM (SELECT item_id, text, list_filter(list_transform(regexp_split_to_array(text, '(?i)\\s+(and|while)\\s+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM benchmark)""")
def sub_queries(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.explode(tx.sub_queries(F.col("text"))).alias("part"))


#: Case folding is lower case but for the sharp s, among the letters of the tables.
COMPOSED = "translate(nfc_normalize({}), 'يىك\u200c', 'ییک ')"
FOLDED = "replace(lower({}), 'ß', 'ss')"
CAMEL = r"list_filter(string_split_regex(regexp_replace(regexp_replace(t, '({low})({up})', '\1_\2', 'g'), '({up})({up}{small})', '\1_\2', 'g'), '_+'), lambda p: p <> '')"


@query(f"""WITH a AS (SELECT doc_id, regexp_extract_all({COMPOSED.format('text')}, '[\\p{{L}}\\p{{N}}_]+') AS w, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS x FROM documents)
SELECT doc_id, CAST(len(list_distinct(list_transform(flatten(list_transform(w, lambda t: list_concat([t], {CAMEL.format(low='[a-z0-9]', up='[A-Z]', small='[a-z]')}))), lambda p: {FOLDED.format('p')}))) AS INT) AS n_terms,
CAST(len(list_distinct(list_filter(list_transform(flatten(list_transform(x, lambda t: {CAMEL.format(low='[' + chr(92) + 'p{Ll}' + chr(92) + 'p{N}]', up=chr(92) + 'p{Lu}', small=chr(92) + 'p{Ll}')})), lambda p: lower(p)), lambda p: length(p) >= 3))) AS INT) AS n_parts FROM a""")
def identifier_terms(spark, sf):
    """Words with their snake and camel parts."""
    return table(spark, sf, "documents").select("doc_id", F.size(tx.identifier_terms(F.col("text"))).alias("n_terms"), F.size(tx.identifier_parts(F.col("text"))).alias("n_parts"))


@query(rf"""SELECT doc_id, sha256({FOLDED.format("trim(regexp_replace(" + COMPOSED.format('text') + r", '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ')")}) AS h FROM documents""")
def normalised_text(spark, sf):
    """NFC, case-folded text with plain spaces."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.normalise(F.col("text")), 256).alias("h"))


@query("SELECT doc_id, split_part(text, '.', -1) AS short, split_part(text, '.', 1) AS root FROM documents")
def short_symbol_and_root(spark, sf):
    """Last and first part of a dotted name."""
    return table(spark, sf, "documents").select("doc_id", tx.short_symbol(F.col("text")).alias("short"), tx.class_root(F.col("text")).alias("root"))


@query("SELECT role, CASE WHEN text = '' THEN 'none' WHEN contains(lower(text), 'timeout') OR contains(lower(text), 'timed out') THEN 'timeout' WHEN contains(lower(text), 'rate') THEN 'rate_limit' WHEN contains(lower(text), 'connect') THEN 'connection' WHEN contains(lower(text), 'json') OR contains(lower(text), 'parse') THEN 'invalid_response' ELSE 'other' END AS category, count(*) AS n FROM conversations GROUP BY ALL")
def failure_taxonomy(spark, sf):
    return table(spark, sf, "conversations").groupBy("role", tx.error_category(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT doc_id, list_distinct({WORDS.format('text')}) AS a, list_distinct({WORDS.format('source || chr(32) || lang')}) AS b FROM documents) SELECT count(*) AS chunks, count(*) FILTER (WHERE len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0) AS gaining, round(avg(len(list_filter(b, lambda x: NOT list_contains(a, x)))), 6) AS mean_added FROM t")
def identifier_information_gain(spark, sf):
    """Chunks that gain terms by a second field, and how many."""
    added = F.size(F.array_except(tx.word_set(F.concat_ws(" ", "source", "lang")), tx.word_set(F.col("text"))))
    return table(spark, sf, "documents").agg(F.count("*").alias("chunks"), F.count_if(added > 0).alias("gaining"), F.round(F.avg(added), 6).alias("mean_added"))
