"""Document fingerprints: threshold-scaled sketches of word shingles, by built-in functions only.

A text's shingles are its distinct runs of five words (A-Z lower-cased; with fewer words the whole
sequence); each is hashed to 16 hexadecimal digits of its MD5. A sketch keeps every hash below a fixed
fraction of all hashes, 1/16: those that begin with 0. So it grows with its text, sketches of very unequal
texts hold the same share of what they have in common, and sketches merge by union. Short texts
would keep too few: a sketch with fewer than LEAST hashes below the fraction keeps its LEAST least ones,
which is all of a text of up to that many shingles. ``limit`` says up to which hash a sketch is
complete; two sketches are compared up to the smaller limit, below which both are whole samples.

Likeness is the estimated containment of the smaller sketch in the other one: 1 for texts without
words on both sides, 0 where one side has no hash up to the common limit.

The query compares each document with an edit of it that ends in words of the next document. The order
of documents is made of ids, lengths and digests alone, by ranges. Texts with their sketches are shuffled
once, by a digest of id and text, and the exchange is used twice: a document joins its own row and
sends its neighbour what that needs, its sketch and half the neighbour's length of its text at most.

Defined cases: null texts are empty; null ids come last in the descending order; rows of one id
are ordered by the digest of their text; repeated rows follow each other, so each but the last has
its own text as the next; with one row the next document is itself; an empty table gives an empty result;
other columns are kept by ``with_fingerprint`` unless they have the name of the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import numbered, stage_table

WORDS, LEAST, DIGITS = 5, 32, 16
#: Hashes up to this one are below the fixed fraction of 1/16.
FRACTION = "0" + "f" * (DIGITS - 1)
WHOLE = "f" * DIGITS
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.translate(text, UPPER, LOWER), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _hashes(words: Column, width: int) -> Column:
    """Hashes of all shingles of an array of words; missing words at the end of a short text are left out."""
    def shingle(i):
        return F.substring(F.md5(F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)])), 1, DIGITS)

    some = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
    return F.array_distinct(F.transform(F.when(F.size(words) > 0, some).otherwise(F.array().cast("array<int>")), shingle))


def with_sketch(rows: DataFrame, text: str, name: str, width: int = WORDS, least: int = LEAST) -> DataFrame:
    """Add struct(limit, hashes), the sketch of column ``text``. Each step is a column of its own, so that it is computed once."""
    rows = rows.withColumn("_words", _words(F.coalesce(text, F.lit(""))))
    rows = rows.withColumn("_all", _hashes(F.col("_words"), width)).drop("_words")
    rows = rows.withColumn("_low", F.filter("_all", lambda h: h <= FRACTION))
    rows = rows.withColumn("_kept", F.sort_array(F.when(F.size("_low") >= least, F.col("_low")).otherwise(F.col("_all"))))
    low = F.size("_low") >= least
    rows = rows.withColumn("_kept", F.when(low, F.col("_kept")).otherwise(F.slice("_kept", 1, least)))
    limit = F.when(low, FRACTION).when(F.size("_all") <= least, WHOLE).otherwise(F.element_at("_kept", -1))
    return rows.withColumn(name, F.struct(limit.alias("limit"), F.col("_kept").alias("hashes"))).drop("_all", "_low", "_kept")


def fingerprint(sketch: str) -> Column:
    """A sketch as text: its limit and its hashes in order."""
    return F.concat(F.col(sketch)["limit"], F.lit(":"), F.array_join(F.col(sketch)["hashes"], ","))


def parsed(text: Column) -> Column:
    """A sketch from its text."""
    rest = F.substring_index(text, ":", -1)
    return F.struct(F.substring_index(text, ":", 1).alias("limit"), F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, ",")).alias("hashes"))


def merged(a: Column, b: Column) -> Column:
    """The sketch of what two texts hold together, up to the smaller limit."""
    limit = F.least(a["limit"], b["limit"])
    return F.struct(limit.alias("limit"), F.sort_array(F.filter(F.array_union(a["hashes"], b["hashes"]), lambda h: h <= limit)).alias("hashes"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the smaller sketch's shingles that the other one has too."""
    limit = F.least(a["limit"], b["limit"])
    mine, other = F.filter(a["hashes"], lambda h: h <= limit), F.filter(b["hashes"], lambda h: h <= limit)
    less = F.least(F.size(mine), F.size(other))
    both = (F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0)
    return F.when(both, 1.0).when(less == 0, 0.0).otherwise(F.size(F.array_intersect(mine, other)) / less)


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of the shingles of ``part`` that ``whole`` has; null where the sketches cannot tell."""
    limit = F.least(part["limit"], whole["limit"])
    mine, other = F.filter(part["hashes"], lambda h: h <= limit), F.filter(whole["hashes"], lambda h: h <= limit)
    return F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, other)) / F.size(mine))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a text column."""
    kept = [c for c in docs.columns if c != name]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("_text"))
    return with_sketch(own, "_text", "_sketch").select("row.*", fingerprint("_sketch").alias(name))


def packed(sketch: Column) -> Column:
    """A sketch as bytes, eight a hash, the limit first; that is how it is shuffled."""
    return F.unhex(F.concat(sketch["limit"], F.array_join(sketch["hashes"], "")))


def unpacked(data: Column) -> Column:
    """A sketch from its bytes."""
    def digits(k):
        return F.lower(F.hex(F.substring(data, k * 8 + 1, F.lit(8))))

    n = (F.octet_length(data) / 8).cast("int")
    hashes = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), digits)).otherwise(F.array().cast("array<string>"))
    return F.struct(digits(F.lit(0)).alias("limit"), hashes.alias("hashes"))


def _neighbours(keyed: DataFrame) -> DataFrame:
    """For every distinct (id, text), by its digest: id, length, rows, and the digest of the next one. No text takes part."""
    each = keyed.groupBy("key", "doc_id", "n_chars").agg(F.count("*").alias("copies"))
    placed = stage_table(numbered(each, [F.desc_nulls_last("doc_id"), F.desc("key")], "place"), "places")
    last = placed.agg(F.max("place")).first()[0]
    after = placed.select(F.col("key").alias("next_key"), F.when(F.col("place") == 1, F.lit(last)).otherwise(F.col("place") - 1).alias("place"))
    return placed.join(after, "place").drop("place")


def edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars, edited, sketch, next_sketch) of every row of (doc_id, text).

    ``edited`` is the text with its last floor(n_chars / 2) characters replaced by as many of the next document.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text), 256))
    keyed = docs.select("doc_id", text.alias("text")).withColumns({"key": key, "n_chars": F.char_length(text).cast("long")})
    known = stage_table(_neighbours(keyed.select("key", "doc_id", "n_chars")), "neighbours")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    own_sketch = packed(F.col("_sketch"))
    # Rows of one key are equal, and merged before they are shuffled.
    texts = with_sketch(keyed.select("key", "text"), "text", "_sketch").select("key", "text", own_sketch.alias("sketch")).groupBy("key").agg(F.first("text").alias("text"), F.first("sketch").alias("sketch"))
    wanted = known.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), half.alias("wanted"))
    sent = texts.join(wanted, "key").select(F.col("for_key").alias("key"), F.left("text", F.col("wanted")).alias("tail"), F.col("sketch").alias("next_sketch"))
    own = texts.join(known, "key").join(sent, "key")
    each = own.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    again = F.col("copy") < F.col("copies")
    tail = F.when(again, F.left("text", half)).otherwise(F.col("tail"))
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), tail)
    rows = each.select("doc_id", "text", "n_chars", edited.alias("edited"), "sketch", F.when(again, F.col("sketch")).otherwise(F.col("next_sketch")).alias("next_sketch"))
    return rows.withColumns({c: unpacked(F.col(c)) for c in ("sketch", "next_sketch")})


def op13_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of ``documents`` and of its edit, with their likeness."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = edits(docs).drop("text")
    both = with_sketch(rows, "edited", "edited_sketch")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
placed AS (
  SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, sha256(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || text) DESC) AS p, count(*) OVER () AS total FROM docs),
pairs AS (
  SELECT a.p, a.doc_id, a.n, a.text, b.text AS next, left(a.text, a.n - a.n // 2) || left(b.text, a.n // 2) AS edited FROM placed a JOIN placed b ON b.p = CASE WHEN a.p = a.total THEN 1 ELSE a.p + 1 END),
sides AS (
  SELECT p, 0 AS side, text AS t FROM pairs UNION ALL SELECT p, 1, edited FROM pairs UNION ALL SELECT p, 2, next FROM pairs),
words AS (
  SELECT p, side, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM sides),
hashed AS (
  SELECT p, side, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: substr(md5(array_to_string(w[i:i+4], ' ')), 1, 16)) END)) AS h FROM words),
counted AS (
  SELECT *, len(list_filter(h, lambda x: x <= '0fffffffffffffff')) AS low FROM hashed),
sketches AS (
  SELECT p, side, CASE WHEN low >= 32 THEN '0fffffffffffffff' WHEN len(h) <= 32 THEN 'ffffffffffffffff' ELSE h[32] END AS top,
         CASE WHEN low >= 32 THEN h[1:low] ELSE h[1:32] END AS kept FROM counted),
wide AS (
  SELECT pairs.*, s.top AS top, s.kept AS kept, e.top AS e_top, e.kept AS e_kept, x.top AS x_top, x.kept AS x_kept
  FROM pairs JOIN sketches s ON s.p = pairs.p AND s.side = 0 JOIN sketches e ON e.p = pairs.p AND e.side = 1 JOIN sketches x ON x.p = pairs.p AND x.side = 2),
cut AS (
  SELECT *, list_filter(kept, lambda v: v <= least(top, e_top)) AS ae, list_filter(e_kept, lambda v: v <= least(top, e_top)) AS ea,
         list_filter(kept, lambda v: v <= least(top, x_top)) AS ax, list_filter(x_kept, lambda v: v <= least(top, x_top)) AS xa FROM wide)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, top || ':' || array_to_string(kept, ',') AS fingerprint, e_top || ':' || array_to_string(e_kept, ',') AS edited_fingerprint,
       CASE WHEN len(kept) = 0 AND len(e_kept) = 0 THEN 1.0::DOUBLE WHEN least(len(ae), len(ea)) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(ae, ea)) / least(len(ae), len(ea)) END AS near_edited,
       CASE WHEN len(kept) = 0 AND len(x_kept) = 0 THEN 1.0::DOUBLE WHEN least(len(ax), len(xa)) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(ax, xa)) / least(len(ax), len(xa)) END AS near_next
FROM cut
"""
