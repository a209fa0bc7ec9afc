"""SimHash near-dedup with BK-trees.

A text's words (split at white space, A-Z lower-cased) give shingles of three; a bit of the fingerprint is set if it is
set in over half the shingles' XXH64 hashes. Fingerprints that differ in at most two bits link, and classes are the
connected components of links.

Search: two fingerprints within two bits agree in at least one of three blocks of their bits, so each fingerprint goes
to three shards, one a block, keyed by the block's bits. A shard with more than `shard_rows` different fingerprints is
dealt anew by three blocks of its remaining bits, up to four times; then 13 bits are left, that is 8192 fingerprints at
most, so every shard has a proven bound. Each shard builds a BK-tree (children keyed by integer Hamming distance to the
parent), and its members are looked up in it, following only edges within the radius of a query's distance. Shard trees
travel by key to the task that queries them, not by broadcast: a broadcast of all trees would grow with the corpus. A
shard returns a spanning forest of its links, not all pairs; a distributed union-find joins the forests.

Null text has no words; no words give fingerprint zero, linked like any other; fewer words than a shingle are one
shingle. Equal fingerprints are one class. A class id is its smallest doc_id (nulls ignored). Every row, repeated rows
too, gets a row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodegraph.llm.common import checkpoint, components, table

RADIUS = 2
LEVELS = 4


def _paths() -> tuple[list[int], list[int]]:
    """Fixed bits of every path of block choices, and how deep it is; the children of path p are 3p + 3, + 4, + 5."""
    masks, depth = [], []
    for level in range(LEVELS):
        for p in range(3 ** (level + 1)):
            parent = masks[(3 ** (level + 1) - 3) // 2 - 3**level + p // 3] if level else 0
            free = [b for b in range(64) if not parent >> b & 1]
            third = [free[: (n := -(-len(free) // 3))], free[n : n + (len(free) - n + 1) // 2], free[n + (len(free) - n + 1) // 2 :]][p % 3]
            masks.append(parent | sum(1 << b for b in third))
            depth.append(level)
    return masks, depth


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(data: bytes, size: int = 3) -> int:
    words = data.lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    n = max(1, len(words) - size + 1)
    hashes, counts = np.fromiter(map(xxh64_intdigest, parts, repeat(42)), np.uint64, n), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([0 if t is None else fingerprint(t, size) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent; built for many members at once."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.children = fps, {}
        work = [(0, np.arange(1, len(fps)))]
        while work:
            node, rest = work.pop()
            if not len(rest):
                continue
            d = np.bitwise_count(fps[rest] ^ fps[node])
            kids = self.children.setdefault(node, {})
            for edge in np.unique(d).tolist():
                under = rest[d == edge]
                kids[edge] = int(under[0])
                work.append((int(under[0]), under[1:]))

    def within(self, queries: np.ndarray, radius: int):
        """(node, places of the queries within the radius of it), for each node that some query reaches."""
        work = [(0, np.arange(len(queries)))]
        while work:
            node, q = work.pop()
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            yield node, q[d <= radius]
            for edge, kid in self.children.get(node, {}).items():
                near = q[np.abs(d - edge) <= radius]
                if len(near):
                    work.append((kid, near))


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest (place, place of its root) of the links within one shard."""
    n = len(fps)
    if n == 2:
        return [(1, 0)] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    root = np.arange(n)
    for node, hits in BKTree(fps).within(fps, radius):
        if len(hits) < 2:
            continue
        tops = hits
        while True:
            up = root[tops]
            if (up == tops).all():
                break
            tops = up
        top = root[node]
        while root[top] != top:
            top = root[top]
        least = min(int(tops.min()), int(top))
        root[tops] = least
        root[top] = least
        root[hits] = least
    while (root[root] != root).any():
        root = root[root]
    return [(int(i), int(root[i])) for i in np.flatnonzero(root != np.arange(n))]


def links(fps: DataFrame, shard_rows: int = 4096) -> DataFrame:
    """Edges (a, b) between different fingerprints, whose components are those of all links. fps: different ones, in column fp."""
    masks, depth = _paths()
    lookup = F.array(*[F.lit(_signed(m)) for m in masks])
    deal = lambda paths: F.explode(F.array(*paths)).alias("path")
    keyed = lambda df: df.select("path", F.col("fp").bitwiseAND(F.element_at(lookup, F.col("path") + 1)).alias("val"), "fp")
    rows = keyed(fps.select("fp", deal([F.lit(i) for i in range(3)])))
    leaves = None
    for level in range(LEVELS):
        big = None
        if level < LEVELS - 1:
            big = checkpoint(rows.groupBy("path", "val").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows).select("path", "val"))
            if big.isEmpty():
                big = None
        leaf = rows if big is None else rows.join(big, ["path", "val"], "left_anti")
        leaves = leaf if leaves is None else leaves.union(leaf)
        if big is None:
            break
        rows = keyed(rows.join(big, ["path", "val"], "left_semi").select("fp", deal([F.col("path") * 3 + i for i in (3, 4, 5)])))

    def run(batches):
        held = []  # the rows of the shard that the last batch left open

        def out(path, val, fp):
            edge = np.flatnonzero((path[1:] != path[:-1]) | (val[1:] != val[:-1])) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
            many = ends - starts > 1
            a, b = [], []
            for i, j in zip(starts[many].tolist(), ends[many].tolist()):
                for x, y in forest(fp[i:j].view(np.uint64)):
                    a.append(fp[i + x])
                    b.append(fp[i + y])
            return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)] if held else [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            path, val, _ = cols
            if not len(path):
                continue
            cut = int(np.flatnonzero((path != path[-1]) | (val != val[-1]))[-1]) + 1 if (path[0] != path[-1] or val[0] != val[-1]) else 0
            if cut:
                yield out(*(c[:cut] for c in cols))
            held = [c[cut:] for c in cols]
        if held:
            yield out(*held)

    return leaves.repartition("path", "val").sortWithinPartitions("path", "val").mapInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp, component_id of each row."""
    base = checkpoint(fingerprints(docs, size))
    fps = base.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(fps.select("fp"))).select(F.col("node").alias("fp"), "root")
    linked = found.join(fps, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("fp", "least")
    ids = fps.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    # a key of its own gives the join its own exchange, whose large partitions can be split
    return base.withColumn("k", F.hash("fp")).join(ids.withColumn("k", F.hash("fp")), ["k", "fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = 3) -> DataFrame:
    """The rows of docs that stay: of each class, the one with the smallest doc_id. Rows without a doc_id all stay."""
    classes = checkpoint(near_classes(docs, size))
    drop = classes.filter("doc_id <> component_id").select("doc_id").distinct()
    out = docs.join(drop, "doc_id", "left_anti")
    repeated = classes.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").isEmpty()
    return out if repeated else out.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(out.filter("doc_id IS NULL"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
