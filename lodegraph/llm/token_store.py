"""Token ids as Parquet list columns.

File format: one row a document with (doc_id, part, at, n_tokens, tokens), files in ascending doc_id order. Token
lists are dictionary-encoded; doc_id, at and n_tokens are delta-encoded (format version 2, no dictionary); row groups
are small enough for one task, and pages hold few rows, so the page indexes let a reader that wants some documents, or
only the metadata, skip the rest. `part` numbers the writing partition, `at` counts the ids of this partition before
the document; a document's place in the whole stream is that plus the ids of all earlier parts.

Null text is empty text. A document always gets the end id. Equal doc_ids keep all their rows, ordered by text hash;
null doc_ids come first. An empty table gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import shared_path, table
from lodegraph.llm.wordbpe import encoder, strings

SCHEMA = "doc_id long, part int, at long, n_tokens long, tokens array<int>"
ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])
SLICE_BYTES = 2_000_000


def encode_tokens(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of the store, in ascending doc_id order over the partitions and within each."""

    def run(batches):
        from pyspark import TaskContext

        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, sizes = batch.num_rows, batch.column(1).nbytes
            step = max(1, rows * SLICE_BYTES // max(sizes, 1))
            for i in range(0, rows, step):
                piece = batch.slice(i, step)
                ids, counts = enc.encode(strings(piece.column(1)))
                ends = np.cumsum(counts)
                tokens = np.insert(ids.astype(np.int32), ends, end_id)
                counts = counts + 1
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(at + ends - counts), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))], schema=ARROW
                )
                at += int(ends[-1]) if len(ends) else 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return rows.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 512) -> None:
    out = encode_tokens(docs, tokenizer, end_id).write.mode("error")
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#at": "false", "parquet.enable.dictionary#n_tokens": "false",
    }
    for k, v in options.items():
        out = out.option(k, v)
    out.parquet(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows; selecting columns or doc_ids reads only their pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Replace part and at, in rows made of the store's, by `start`, the place in the whole stream. Reads two columns of the store."""
    totals = read_rows(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    return rows.join(base, "part").withColumn("start", F.col("base") + F.col("at")).drop("base", "part", "at")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, part, at, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for b in batches:
            lists = b.column(3)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "part", "at", "tokens").mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return with_start(spark, path, checksums(read_rows(spark, path))).select("doc_id", "start", "n_tokens", "ids_crc32")
