"""Trigram phrase search with BM25, and the substring fallback for short tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import TRIGRAM, contains_folded, occurrences, tokenize

K1, B = 1.2, 0.75


def bm25(docs: DataFrame, tokens: list[str]) -> DataFrame:
    """docs (id, name, summary) -> (id, score) of those that hold a token; less is better. Repeated tokens count again."""
    name, summary = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("summary", F.lit("")))
    rows = docs.select("id", name.alias("a"), summary.alias("b"))
    dl = F.greatest(F.length("a") - 2, F.lit(0)) + F.greatest(F.length("b") - 2, F.lit(0))
    tf = [occurrences(F.col("a"), t.lower()) + occurrences(F.col("b"), t.lower()) for t in tokens]
    rows = rows.select("id", dl.cast("double").alias("dl"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)])
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(tokens))])
    hits = rows.filter(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(tokens))], F.lit(False)))
    hits = hits.crossJoin(F.broadcast(stats))  # one row

    def part(i: int):
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        return idf * (F.col(f"tf{i}") * (K1 + 1)) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    return hits.select("id", (-reduce(lambda x, y: x + y, [part(i) for i in range(len(tokens))], F.lit(0.0))).alias("score"))


def ranked(df: DataFrame, limit: int, *order) -> DataFrame:
    """The first `limit` rows with a 0-based rank; the window sees those rows only."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def search(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, score, rank): BM25 hits, then, if slots are left, substring hits of shorter tokens with score 0."""
    words = tokenize(query)
    empty = docs.sparkSession.createDataFrame([], "id long, score double, rank int")
    if limit <= 0 or not words:
        return empty
    long, short = [t for t in words if len(t) >= TRIGRAM], list(dict.fromkeys(t for t in words if len(t) < TRIGRAM))
    found = ranked(bm25(docs, long), limit, "score", "id") if long else empty
    if not short:
        return found
    like = reduce(lambda x, y: x | y, [contains_folded(F.col(c), t) for t in short for c in ("name", "summary")])
    more = docs.filter(like).select("id").orderBy("id").limit(limit)  # before those already found are taken out
    more = more.join(found.select("id"), "id", "left_anti").select("id", F.lit(0.0).alias("score"), F.lit(1).alias("tier"))
    both = found.select("id", "score", F.lit(0).alias("tier")).union(more)
    return ranked(both, limit, "tier", "score", "id").drop("tier")


def trigram_frequencies(texts: DataFrame) -> DataFrame:
    """texts (id, text) -> (gram, df): in how many texts each lower-case trigram occurs."""
    t = F.lower("text")
    n = F.length(t)
    grams = F.when(n >= TRIGRAM, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return texts.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
