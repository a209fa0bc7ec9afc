"""Best-fit packing into bins of several permitted sizes.

Items go in order of falling length into the open bin with the least room that still takes them. Where none does, the
bin size to open is the one with the least cost for each token that it is expected to hold: `cost` of the size, over the
item's length and what of the items still to come can fill the rest. In the end each bin shrinks to the smallest
permitted size that holds its contents. Texts longer than the largest size are cut into pieces of that size and a rest,
so no token goes. Items are dealt by hash to shards of about `shard_items`; each shard is packed on its own, and costs a
few part-filled bins at most.

Null text has only its end token. Null doc_ids are kept. Rows that repeat are packed each for itself. Ties go by hash,
then doc_id, then piece. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import checkpoint, table

SIZES = (512, 1024, 2048, 4096)


def cost(size: int, largest: int) -> float:
    """Of one sequence: linear layers by its length, attention by its square (a tenth of the whole at the largest size)."""
    return size * (1 + size / largest / 9)


def best_fit(lengths: list[int], sizes: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """Of each item its bin and its place there, and of each bin its size. lengths fall, and none is over the largest size."""
    largest = sizes[-1]
    room: list[list[int]] = [[] for _ in range(largest + 1)]  # bins by the room they have left
    mask = 0  # bit r: some bin has room r
    bins, places, used, opened = [], [], [], []
    # tokens of the items from here on, by length, for the expected fill
    suffix = np.concatenate([np.cumsum(np.array(lengths[::-1], np.int64))[::-1], [0]]).tolist() if lengths else [0]
    falling = [-x for x in lengths]
    for k, n in enumerate(lengths):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            best = None
            for size in sizes:
                if size >= n:
                    # items to come that are no longer than the rest
                    first = max(k + 1, bisect_left(falling, -(size - n)))
                    held = n + min(size - n, suffix[first])
                    best = min(best or (np.inf, 0), (cost(size, largest) / held, size))
            b, r = len(used), best[1]
            used.append(0)
            opened.append(r)
        bins.append(b)
        places.append(used[b])
        used[b] += n
        r -= n
        room[r].append(b)
        mask |= 1 << r
    return bins, places, [sizes[bisect_left(sizes, u)] for u in used]


def packed(items: DataFrame, sizes: tuple[int, ...] = SIZES, shard_items: int = 50_000) -> DataFrame:
    """items: (doc_id, n_tokens), n_tokens at least 1. One row a piece: doc_id, piece, start (in its document), length, bin_id, bin_size, bin_start."""
    largest = sizes[-1]
    items = checkpoint(items.select("doc_id", "n_tokens"))  # lengths alone: counted once, read twice
    pieces = items.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / largest).cast("long"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest).cast("long"), F.col("n_tokens") - F.col("piece") * largest).alias("length"))
    n = items.agg(F.coalesce(F.sum(F.floor((F.col("n_tokens") - 1) / largest) + 1), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-int(n) // shard_items))
    # with the row's number: equal rows go to different shards
    h = F.xxhash64("doc_id", "piece", "length", F.monotonically_increasing_id())
    pieces = pieces.withColumn("h", h).withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))

    def pack(key, t):
        t = t.sort_by([("length", "descending"), ("h", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, places, size = best_fit(t.column("length").to_pylist(), sizes)
        base = key[0].as_py() << 32
        sized = np.array(size, np.int64)[bins] if bins else np.zeros(0, np.int64)
        return pa.table({**{c: t.column(c) for c in ("doc_id", "piece", "start", "length")}, "bin_id": pa.array(np.array(bins, np.int64) + base), "bin_size": pa.array(sized), "bin_start": pa.array(places, pa.int64())})

    return pieces.groupBy("shard").applyInArrow(pack, "doc_id long, piece long, start long, length long, bin_id long, bin_size long, bin_start long")


def sequences(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(bin_id, bin_size, tokens, doc_ids): the token ids of every bin, from rows (doc_id, tokens), doc_id once, and their places.

    A bin has at most the largest size's tokens, so a group is bounded.
    """
    part = F.slice("tokens", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    parts = placed.join(rows.select("doc_id", "tokens"), "doc_id").select("bin_id", "bin_size", F.struct("bin_start", "doc_id", part.alias("ids")).alias("p"))
    parts = parts.groupBy("bin_id", "bin_size").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return parts.select("bin_id", "bin_size", F.flatten("p.ids").alias("tokens"), F.col("p.doc_id").alias("doc_ids"))


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words between white space, and an end token."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (words + 1).cast("long").alias("n_tokens"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(token_counts(table(spark, sf_dir, "documents")))
