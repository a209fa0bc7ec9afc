"""Language ID by a bidirectional gated recurrent network over bytes.

The network (bigru.py) is trained in numpy on the driver from a bounded sample: for each language (the `max_labels`
most frequent) at most `per_label` windows of labelled documents, up to three of one, cut at places that follow from
the doc_id's hash. It labels every position of every whole text, and a document's distribution is the mean over its positions.

`held_out` is true if crc32(doc_id as text) mod 4 is 2; such documents are never learned from, nor are rows without a
doc_id (held_out false). Null text and text without any letter is `und` with score 0, as is everything if there is
nothing to learn from. Equal texts get equal results. Equal scores go to the first label in order. Existing columns
named like the new ones are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.llm.bigru import BiGRU
from lodegraph.llm.common import table, unused

UNKNOWN = "und"
CUT = 160  # characters that hold a window
CUTS = 3  # of one document


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_label: int, max_labels: int) -> list:
    """Rows (lang, cut): at most per_label of each of at most max_labels languages, chosen by hash."""
    rows = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id"))).filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.explode(F.array(*[F.xxhash64("doc_id", F.lit(k)) for k in range(CUTS)])).alias("h"), "text")
    off = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - CUT, F.lit(1))).cast("int") + 1
    rows = rows.select("lang", "h", F.substring("text", off, F.lit(CUT)).alias("cut"))
    # the filter on the rank is applied before the exchange, too: what moves is bounded for each task
    rows = rows.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("h", "cut"))).filter(F.col("no") <= per_label)
    per = rows.groupBy("lang").agg(F.collect_list("cut").alias("cuts")).orderBy(F.size("cuts").desc(), "lang").limit(max_labels)
    return per.orderBy("lang").collect()


def train(docs: DataFrame, per_label: int = 600, max_labels: int = 64, **options) -> BiGRU | None:
    per = sample(docs, per_label, max_labels)
    if not per:
        return None
    model = BiGRU([r["lang"] for r in per], **options)
    texts = [(c.encode(), k) for k, r in enumerate(per) for c in sorted(r["cuts"])]
    if len(per) > 1:
        model.fit(model.windows([t for t, _ in texts]), np.array([k for _, k in texts]))
    return model


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column's bytes, and where each text starts and how long it is (0 for null)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    sizes = np.diff(at)
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(1, np.uint8)), at[:-1], sizes


def predictor(model: BiGRU | None):
    """A function of a text column: struct(lang, score)."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, starts, sizes = _bytes_of(column)
            if model is None or not len(sizes):
                yield pa.StructArray.from_arrays([pa.array([UNKNOWN] * len(sizes), pa.string()), pa.array([0.0] * len(sizes))], names=["lang", "score"])
                continue
            p = model.pooled(data if len(data) else np.zeros(1, np.uint8), starts, sizes)
            best = p.argmax(axis=1)
            lang = pa.array(model.labels, pa.string()).take(pa.array(best))
            yield pa.StructArray.from_arrays([lang, pa.array(np.clip(p[np.arange(len(best)), best], 0.0, 1.0))], names=["lang", "score"])

    return predict


def with_language(docs: DataFrame, model: BiGRU | None) -> DataFrame:
    """The columns of docs, and held_out, lang_pred, score."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    docs = docs.drop("held_out", "lang_pred", "score")
    (p,) = unused(docs, "p")
    return docs.withColumn(p, predictor(model)("text")).select(
        *docs.columns,
        held_out(F.col("doc_id")).alias("held_out"),
        F.when(letters, F.col(f"{p}.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(letters, F.col(f"{p}.score")).otherwise(0.0).alias("score"),
    )


def language_spans(docs: DataFrame, model: BiGRU, smooth: int = 31) -> DataFrame:
    """(doc_id, spans): runs of bytes [start, end) with one label, after a mean over `smooth` positions of a window."""

    @F.arrow_udf("array<struct<start:long,end:long,lang:string>>")
    def spans(column: pa.Array) -> pa.Array:
        data, starts, sizes = _bytes_of(column)
        out: list[list] = [[] for _ in sizes]

        def see(doc, at, n, p):
            k = np.ones(min(smooth, n)) / min(smooth, n)
            best = np.stack([np.convolve(p[:, c], k, "same")[:n] for c in range(p.shape[1])]).argmax(axis=0)
            cut = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), n]
            for i, j in zip(cut[:-1], cut[1:]):
                lang = model.labels[best[i]]
                if out[doc] and out[doc][-1]["lang"] == lang:
                    out[doc][-1]["end"] = at + j
                else:
                    out[doc].append({"start": at + i, "end": at + j, "lang": lang})

        model.pooled(data if len(data) else np.zeros(1, np.uint8), starts, sizes, each=see)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))

    return docs.select("doc_id", spans("text").alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_language(docs, train(docs)).select("doc_id", "held_out", "lang_pred", "score")
