"""Text functions as Column expressions; Arrow functions only where Spark has no equivalent."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the retrieval text rules.
WORD = r"[\p{L}\p{N}_]+"
REFUSAL = r"(?i)^\W*(?:there is )?not enough retrieved evidence"
HEDGE = r"(?i)\b(?:not (?:fully |explicitly |directly )?(?:shown|included|visible|provided|specified)|cannot be determined|may|might|likely|appears to)\b"
CITATION = r"([A-Za-z0-9_./-]+\.py):(\d+)(?:-(\d+))?"
STOP_IDENTIFIERS = ("None", "True", "False", "self", "return", "class")


def words(text: Column) -> Column:
    """Lower-cased Unicode words, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def composed(text: Column) -> Column:
    """NFC, Arabic yeh and kaf as Persian, zero-width non-joiner as a space."""
    return F.translate(_nfc(text), "يىك\u200c", "ییک ")


def normalise(text: Column) -> Column:
    """``composed``, white-space runs as one space, trimmed, case-folded."""
    return _casefold(F.trim(F.regexp_replace(composed(text), r"(?U)[\s\x1c-\x1f]+", " ")))


def camel_parts(token: Column) -> Column:
    """Parts of an identifier at underscores and case changes."""
    cut = F.regexp_replace(token, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_")
    return F.filter(F.split(cut, "_+"), lambda p: p != "")


def identifier_terms(text: Column) -> Column:
    """Every word of the ``composed`` text and its parts at underscores and ASCII case changes, case-folded, distinct in order."""

    def parts(token: Column) -> Column:
        cut = F.regexp_replace(token, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
        return F.filter(F.split(cut, "_+"), lambda p: p != "")

    tokens = F.regexp_extract_all(composed(text), F.lit(f"({WORD})"), F.lit(1))
    every = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), parts(t))))
    # Terms hold no space, so one folding of all of them is a folding of each.
    return F.array_distinct(F.filter(F.split(_casefold(F.array_join(every, " ")), " "), lambda t: t != ""))


def identifier_parts(text: Column, least: int = 3) -> Column:
    """Lower-cased snake and camel case parts of at least ``least`` characters."""
    tokens = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(tokens, camel_parts)), lambda t: F.lower(t)), lambda t: F.length(t) >= least))


def backtick_identifiers(text: Column, least: int = 4) -> Column:
    """Names of at least ``least`` characters inside back-ticks, without the stop list, distinct in order."""
    quoted = F.regexp_extract_all(text, F.lit("`([^`\n]+)`"), F.lit(1))
    names = F.flatten(F.transform(quoted, lambda q: F.regexp_extract_all(q, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))))
    return F.array_distinct(F.filter(names, lambda n: (F.length(n) >= least) & ~n.isin(*STOP_IDENTIFIERS)))


def short_symbol(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def class_root(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def sub_queries(question: Column, least: int = 120) -> Column:
    """Parts at "and" or "while" of long questions, each opened with What; short ones stay whole."""
    parts = F.filter(F.transform(F.split(question, r"(?i)\s+(?:and|while)\s+"), lambda p: F.trim(p)), lambda p: p != "")
    opened = F.transform(parts, lambda p: F.when(p.rlike(r"(?i)^(?:what|how|why|where|when|which|who|does|is|are)\b"), p).otherwise(F.concat(F.lit("What "), p)))
    return F.when((F.length(question) >= least) & (F.size(parts) > 1), opened).otherwise(F.array(question))


def is_refusal(answer: Column) -> Column:
    return answer.rlike(REFUSAL)


def is_hedged(answer: Column) -> Column:
    return ~is_refusal(answer) & answer.rlike(HEDGE)


def strip_citations(answer: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(answer, rf"\s*[\[(]?{CITATION}[\])]?", ""), " {2,}", " "))


def clean_answer(answer: Column, sentences: int = 2) -> Column:
    """Without fences, source labels and an answer prefix; the first sentences."""
    bare = F.regexp_replace(F.regexp_replace(answer, r"```[a-z]*", ""), r"\[S\d+\]", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)^\s*answer:\s*", ""), r"\s+", " "))
    return F.array_join(F.slice(F.split(F.regexp_replace(bare, r"([.!?]) ", "$1\u0001"), "\u0001"), 1, sentences), " ")


def fenced_json(text: Column) -> Column:
    """The body of the one code fence, or the text itself if it has none; null if there are several."""
    body = F.regexp_extract(text, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    fences = F.size(F.regexp_extract_all(text, F.lit("(```)"), F.lit(1)))
    return F.when(fences == 0, F.trim(text)).when((fences == 2) & (body != ""), body)


def in_arabic_script(texts: Column) -> Column:
    """Whether every text holds a letter of the Arabic block."""
    return F.forall(texts, lambda t: t.rlike(r"[\p{InArabic}&&\p{L}]"))


def mentions(question: Column, name: Column, case_sensitive: bool = False) -> Column:
    """Whether a dotted name is mentioned as a whole; the case-sensitive form also stops at a dot behind it."""
    escaped = F.regexp_replace(name, r"([^\p{L}\p{N}_])", r"\\$1")
    if case_sensitive:
        return F.regexp_like(question, F.concat(F.lit(r"(?<![\p{L}\p{N}_.])"), escaped, F.lit(r"(?![\p{L}\p{N}_.])")))
    return F.regexp_like(question, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_.])"), escaped, F.lit(r"(?![\p{L}\p{N}_])")))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", "")


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^(?:/|\\|[A-Za-z]:)")


def newline_hash(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256)


def chunk_identity(path: Column, kind: Column, name: Column, start: Column, end: Column, content_hash: Column) -> Column:
    """SHA-256 of the chunk's place and content, parts divided by NUL; a null part is empty."""
    parts = [path, kind, name, F.concat(F.coalesce(start.cast("string"), F.lit("")), F.lit(":"), F.coalesce(end.cast("string"), F.lit(""))), content_hash]
    return F.sha2(F.concat_ws("\0", *[F.coalesce(x.cast("string"), F.lit("")) for x in parts]), 256)


def embedding_text(**parts: Column) -> Column:
    """The labelled lines that are embedded for a chunk, the source last; is_async is written True or False."""
    if "is_async" in parts:
        parts = parts | {"is_async": F.initcap(parts["is_async"].cast("string"))}
    labels = ("path", "chunk_type", "symbol_kind", "qualified_name", "parent", "is_async", "parameters", "returns", "decorators", "bases", "docstring")
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(parts[k].cast("string") if k in parts else F.lit(""), F.lit(""))) for k in labels]
    return F.concat_ws("\n", *lines, F.lit("source:"), parts["source"])


def with_identifier_terms(text: Column, terms: Column) -> Column:
    """The embedding text with a line of identifier terms before its source."""
    at = F.instr(text, "\nsource:")
    line = F.concat(F.lit("\nidentifier_terms: "), F.array_join(terms, " "))
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - F.lit(1)), line, F.substr(text, at))).otherwise(text)


def signature(name: Column, parameters: Column, returns: Column, is_async: Column) -> Column:
    head = F.concat(F.when(is_async, F.lit("async ")).otherwise(F.lit("")), F.lit("def "), name, F.lit("("), F.array_join(parameters, ", "), F.lit(")"))
    return F.concat(head, F.when(returns.isNotNull(), F.concat(F.lit(" -> "), returns)).otherwise(F.lit("")))


def error_category(message: Column) -> Column:
    """Safe category of an error text; the first that fits."""
    low = F.lower(message)
    return (
        F.when(message.isNull() | (message == ""), "none").when(low.contains("timeout") | low.contains("timed out"), "timeout").when(low.contains("rate"), "rate_limit")
        .when(low.contains("connect"), "connection").when(low.contains("json") | low.contains("parse"), "invalid_response").otherwise("other")
    )


def judge_scores(reply: Column, criteria: tuple[str, ...], most: int = 20) -> Column:
    """The scores of a judge's JSON reply, with or without a code fence, as a struct; null if one is missing or no whole number from 1 to ``most``."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(reply, r"^\s+|\s+$", "")), r"^```json", ""), r"```$", "")
    raw = {c: F.get_json_object(bare, f"$.{c}") for c in criteria}
    # Booleans and numbers with a point are no whole numbers; a null or broken reply has none.
    good = {c: F.when(v.rlike(r"^-?\d{1,9}$") & ~bare.rlike(f'"{c}"\\s*:\\s*"'), v.cast("int")) for c, v in raw.items()}
    whole = None
    for v in good.values():
        inside = F.coalesce(v.between(1, most), F.lit(False))
        whole = inside if whole is None else whole & inside
    return F.when(whole, F.struct(*[v.alias(c) for c, v in good.items()]))


def case_concept(case_id: Column) -> Column:
    """The concept of a case id: what stands before its last hyphen, or all of it."""
    return F.regexp_replace(case_id, r"-[^-]*$", "")


def utc_text(moment: Column) -> Column:
    """A timestamp as ISO 8601 with microseconds and the offset of UTC (the session's time zone has to be UTC)."""
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
