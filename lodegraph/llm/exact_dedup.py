"""Exact dedup by counting quotient filters.

Texts are equal when their bytes are, once every space, tab, line feed, vertical tab, form feed and carriage return is
deleted. Each partition turns the 64-bit fingerprints of its texts into a counting quotient filter (quotient_filter.py), in blocks
by their high bits. Blocks are dealt to the tasks that merge them, without loss, by sorted remainders; one key, however
frequent, is a single remainder with a count in each partition's filter. Only texts whose fingerprint has a count over
one are routed on, to be grouped by their very bytes.

Null text is empty text, and all empty texts are equal. In a group the row with the most code points in its original
text stays, then the smallest doc_id (null last); of rows that tie in both, exactly one stays. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import table
from lodegraph.llm.quotient_filter import QuotientFilter, summed

SPACE = b" \t\n\x0b\x0c\r"
#: fewest bits that choose a block, and fingerprints that a merged block is meant to hold
BLOCK_BITS, BLOCK = 6, 1 << 16


def _texts(column) -> list[bytes]:
    return [(b"" if t is None else t) for t in column.cast(pa.binary()).to_pylist()]


def digests(docs: DataFrame, with_text: bool) -> DataFrame:
    """(doc_id, n_points, fp, text_sha256[, norm]) of each row; fp is the fingerprint of the normalised bytes."""

    def run(batches):
        for b in batches:
            raw = _texts(b.column(1))
            norm = [t.translate(None, SPACE) for t in raw]
            fp = np.array([xxhash.xxh3_64_intdigest(t) for t in norm], np.uint64).view(np.int64)
            points = [len(t) if t.isascii() else len(t.decode("utf-8", "replace")) for t in raw]
            cols = [b.column(0), pa.array(points, pa.int64()), pa.array(fp), pa.array([hashlib.sha256(t).hexdigest() for t in norm], pa.string())]
            if with_text:
                cols.append(pa.array(norm, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_points", "fp", "text_sha256", "norm"][: len(cols)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_points long, fp long, text_sha256 string" + ", norm binary" * with_text)


def fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            fp = [xxhash.xxh3_64_intdigest(t.translate(None, SPACE)) for t in _texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(fp, np.uint64).view(np.int64))], names=["fp"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "fp long")


def block_bits(rows: int) -> int:
    """So many that a block, which one task merges, holds about BLOCK fingerprints at any size of the corpus."""
    return max(BLOCK_BITS, min(40, (rows // BLOCK).bit_length()))


def quotient_filters(fps: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """A counting quotient filter of each partition, in blocks by the fingerprints' high bits: (block, quotient_bits, slots, marks)."""

    def run(batches):
        new = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        held = np.concatenate([np.zeros(0, np.uint64), *new])
        held, counts = summed(held, np.ones(len(held), np.int64))
        if not len(held):
            return
        width = 64 - bits
        block = (held >> np.uint64(width)).astype(np.int64)
        rest = held & np.uint64((1 << width) - 1)
        at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        made = [QuotientFilter.build(rest[i:j], counts[i:j], width) for i, j in zip(at.tolist(), np.append(at[1:], len(held)).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[at]), pa.array([f.bits for f in made], pa.int32()), pa.array([f.slots.tobytes() for f in made], pa.binary()), pa.array([f.marks.tobytes() for f in made], pa.binary())],
            names=["block", "quotient_bits", "slots", "marks"],
        )

    return fps.mapInArrow(run, "block long, quotient_bits int, slots binary, marks binary")


def repeated(filters: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Merge the filters of each block; (fp, n): fingerprints with a count over one."""
    width = 64 - bits

    def run(key, t):
        parts = zip(t.column("quotient_bits").to_pylist(), t.column("slots").to_pylist(), t.column("marks").to_pylist())
        whole = QuotientFilter.merge((QuotientFilter(width, q, np.frombuffer(s, np.uint64), np.frombuffer(m, np.uint8)) for q, s, m in parts), width)
        fps, counts = whole.items()
        fps = fps[counts > 1] | (np.uint64(key[0].as_py()) << np.uint64(width))
        return pa.table({"fp": fps.view(np.int64), "n": counts[counts > 1]})

    return filters.groupBy("block").applyInArrow(run, "fp long, n long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    bits = block_bits(docs.count())  # from the files' metadata
    routes = repeated(quotient_filters(fingerprints(docs), bits), bits).select("fp")
    routed = digests(docs, True).join(routes, "fp", "left_semi")
    best = F.max_by(F.struct("doc_id", "n_points"), F.struct("n_points", F.col("doc_id").isNotNull(), F.bitwise_not("doc_id")))
    verified = routed.groupBy("norm").agg(F.first("text_sha256").alias("text_sha256"), best.alias("best"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    # rows that tie in all respects are numbered, before the join: the exchange is by all three columns
    w = Window.partitionBy("text_sha256", "doc_id", "n_points").orderBy("fp")
    rows = digests(docs, False).withColumn("no", F.row_number().over(w)).join(verified.select("text_sha256", "best", "size"), "text_sha256", "left")
    stays = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_points") == F.col("best.n_points")))
    rows = rows.withColumn("stays", stays)
    return rows.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("stays") & (F.col("no") == 1)).alias("kept"),
        "text_sha256",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT *, row_number() OVER w AS no, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n_points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, no = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
