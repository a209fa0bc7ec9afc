"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

Words are runs of digits, a-z and characters beyond ASCII, after A-Z are lower-cased. Each benchmark item gives windows
of `size` consecutive words (one shorter window for a shorter item, none for an item without words). A document has a
window's set of words at some place only if it has the window's rarest word there: windows are ordered by how often the
corpus has their words, their prefix is the rarest one (containment 1 needs one prefix token), and the join goes over
prefix words. Positional and length bounds follow (the window must start and end inside the document), and then the
window's words are compared one by one. Frequencies are counted over all documents.

The prefix table is broadcast where its counted rows are at most `broadcast_rows`; beyond that, documents' words are
shuffled to it and candidates are verified after a join back. Null text has no words. Rows with equal doc_id and text
get equal results, each its own row. Null item_ids are dropped from the item list. Items of equal words all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import checkpoint, table, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what stands between words
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of words; nothing for null."""
    # a gap at either end leaves an empty string there
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(words, items): every different window and the ids of the items that have it."""
    w = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1)))
    w = w.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), size).alias("win"))
    return w.groupBy("win").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def prefixes(windows: DataFrame, docs_words: DataFrame, broadcast_rows: int) -> tuple[DataFrame, bool]:
    """(word, shift, win, items) by each window's rarest word, and whether that table is small enough to broadcast."""
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    small = vocabulary.limit(broadcast_rows + 1).count() <= broadcast_rows
    counted = docs_words.select(F.explode("w").alias("word")).join(F.broadcast(vocabulary) if small else vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    each = windows.select(F.xxhash64(F.array_join("win", " ")).alias("id"), "win", "items", F.posexplode("win").alias("shift", "word"))
    each = each.join(counted, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = each.groupBy("win").agg(F.min(F.struct("n", "shift", "word")).alias("r"), F.first("items").alias("items")).filter("r.n > 0")
    # as large as the benchmark; kept, since counting words reads the whole corpus
    out = checkpoint(rarest.select(F.col("r.word").alias("word"), F.col("r.shift").alias("shift"), "win", "items"))
    return out, out.limit(broadcast_rows + 1).count() <= broadcast_rows


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 8, min_items: int = 2, broadcast_rows: int = 200_000) -> DataFrame:
    """The columns of docs, and n_words, n_hit, n_items, items_sha256, contaminated, and hits: the [start, end) word spans."""
    keyed = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
    base = keyed.select("doc_id", "_h", words(F.col("text")).alias("w"))
    prefix, small = prefixes(item_windows(benchmark, size), base.select("w"), broadcast_rows)
    start = F.col("pos") - F.col("shift") + 1
    fits = (start >= 1) & (start + F.size("win") - 1 <= F.size("w"))
    same = F.slice("w", F.greatest(start, F.lit(1)), F.size("win")) == F.col("win")
    if small:
        found = base.select("doc_id", "_h", "w", F.posexplode("w").alias("pos", "word")).join(F.broadcast(prefix), "word").filter(fits & same)
    else:
        near = base.select("doc_id", "_h", F.size("w").alias("len"), F.posexplode("w").alias("pos", "word")).join(prefix, "word")
        near = near.filter((start >= 1) & (start + F.size("win") - 1 <= F.col("len"))).select("doc_id", "_h", "pos", "shift", "win", "items")
        on = near["doc_id"].eqNullSafe(base["doc_id"]) & near["_h"].eqNullSafe(base["_h"])
        found = near.join(base, on).select(near["doc_id"], near["_h"], "w", "pos", "shift", "win", "items").filter(same)
    found = found.select("doc_id", "_h", start.alias("start"), F.size("win").alias("len"), "items")
    spots = F.array_distinct(F.flatten(F.transform(F.col("at"), lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))
    per = found.groupBy("doc_id", "_h").agg(F.collect_set(F.struct("start", "len")).alias("at"), F.collect_set("items").alias("items"))
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits")
    h, d, g, n, ids, at = unused(docs, "h", "d", "g", "n", "ids", "at")
    span = lambda x: F.struct((x["start"] - 1).alias("start"), (x["start"] - 1 + x["len"]).alias("end"))
    per = per.select(F.col("doc_id").alias(d), F.col("_h").alias(g), F.size(spots).alias(n), F.array_sort(F.array_distinct(F.flatten("items"))).alias(ids), F.transform(F.array_sort("at"), span).alias(at))
    out = docs.withColumn(h, F.xxhash64("text"))
    out = out.join(per, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(g)), "left")
    n_items = F.when(F.col(ids).isNull(), 0).otherwise(F.size(ids)).cast("long")
    return out.select(
        *docs.columns,
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
        F.coalesce(n, F.lit(0)).cast("long").alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.coalesce(F.array_join(ids, ","), F.lit("")), 256).alias("items_sha256"),
        F.when(F.col(ids).isNull(), False).otherwise(n_items >= min_items).alias("contaminated"),
        F.col(at).alias("hits"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, lens WHERE len(w) >= n)
), m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1
), it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',')) AS h FROM m GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
