"""The assembled context: drop hubs, keep the first hits, put named ones first, cut to excerpts, pack under a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import code
from siltstone.functions import text as tx
from siltstone.operators import context as cx

KEPT = 8
PIECE = T.ArrayType(T.StructType([T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("code", T.StringType())]))


@F.pandas_udf(PIECE)
def excerpts(source: pd.Series, start: pd.Series, question: pd.Series) -> pd.Series:
    """The signature and the best lines of each chunk, with their lines in the file."""
    out = []
    for body, first, asked in zip(source, start, question, strict=True):
        lines = (body or "").splitlines()
        out.append([{"start_line": int(first) + a, "end_line": int(first) + b, "code": "\n".join(lines[a : b + 1])} for a, b in code.excerpt_spans(body or "", asked or "")])
    return pd.Series(out)


def mention_tier(question: str = "text", name: str = "qualified_name") -> Column:
    """3 for a dotted name that the question mentions, 2 for its class, 1 for its bare name (no dunder), else 0."""
    q, n = F.col(question), F.col(name)
    short = tx.short_symbol(n)
    return (
        F.when(F.contains(n, F.lit(".")) & tx.mentions(q, n), 3).when(tx.mentions(q, tx.class_root(n), True), 2)
        .when(~short.startswith("__") & tx.mentions(q, short, True), 1).otherwise(0)
    )


def assemble(hits: DataFrame, budget: int = cx.BUDGET, kept: int = KEPT) -> DataFrame:
    """(question_id, place, chunk_id, source_file, start_line, end_line, code) of the pieces that fit, in order.

    ``hits``: question_id, text, rank, chunk_id, chunk_type, qualified_name, source_file, start_line, code.
    Class overviews over cx.HUB characters are hubs. Of the first ``kept`` others those of the best tier
    that the question mentions come first. Pieces are packed greedily; one that does not fit is skipped.
    """
    hubless = hits.where(~((F.col("chunk_type") == "class_overview") & (F.length("code") > cx.HUB)))
    first = hubless.withColumn("_k", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where(F.col("_k") <= kept)
    tiered = first.withColumn("_tier", mention_tier())
    best = F.max("_tier").over(Window.partitionBy("question_id"))
    ordered = cx.soft_focus(tiered.withColumn("_best", best), (F.col("_tier") == F.col("_best")) & (F.col("_best") > 0))
    cut = ordered.select("question_id", "place", "chunk_id", "source_file", F.posexplode(excerpts("code", "start_line", "text")).alias("piece", "p"))
    order = Window.partitionBy("question_id").orderBy("place", "piece")
    pieces = cut.withColumn("rank", F.row_number().over(order)).select("question_id", "rank", "chunk_id", "source_file", "p.*")
    packed = cx.pack(pieces.select("question_id", "rank", F.col("rank").cast("long").alias("chunk_id"), F.length("code").cast("long").alias("chars")), "question_id", budget)
    chosen = packed.select("question_id", F.explode("chunk_ids").alias("rank"))
    return pieces.join(chosen, ["question_id", "rank"]).withColumnRenamed("rank", "place").select("question_id", "place", "chunk_id", "source_file", "start_line", "end_line", "code")
