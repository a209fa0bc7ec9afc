"""Near copies of a Jaccard similarity of word shingles, found by SimHash and MinHash and verified exactly.

A text's words (split at white space, A-Z lower-cased) give shingles of `size` words (one shorter shingle for fewer
words); its set is that of their XXH64 hashes. Two texts link if the Jaccard similarity of their sets is at least
`threshold`, and classes are the connected components of links.

Candidates: fingerprints of the same shingles that link in the SimHash operator's BK-trees (simhash.py). Two bits can't
reach a similarity of 0.8, though, so texts that share one of `BANDS` bands of `ROWS` MinHash values, and most of 128
digests of such values, are candidates, too: at a similarity of 0.8 a pair shares a band with probability 0.994.
Candidates are examined as lines are (line_dedup.band_links): none is left out. One pass over the texts makes all
features; the texts of candidates alone are moved to be verified.

Equal sets are one class; texts without words (null, too) have the empty set. Columns other than text and doc_id are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodegraph.llm import simhash
from lodegraph.llm.common import checkpoint, components, is_small, unused
from lodegraph.llm.line_dedup import BROADCAST_IDS, band_links, most_frequent

BANDS, ROWS = 10, 4
#: digests of a set, and those that agree in candidates: at a similarity of 0.8, 109 of 128 are expected to (deviation 4)
DIGESTS, AGREE = 128, 101
MARKS = [f"d{k}" for k in range(DIGESTS // 32)]
_TIMES = np.random.default_rng(20240611).integers(0, 1 << 63, DIGESTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(data: bytes | None, size: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    words = (data or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter(map(xxh64_intdigest, parts, repeat(42)), np.uint64, max(1, len(words) - size + 1))


def _key(tokens: np.ndarray) -> int:
    k = xxh64_intdigest(tokens.tobytes())
    return k - (1 << 64) if k >> 63 else k


def _fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _minima(tokens: np.ndarray) -> np.ndarray:
    """MinHash values: the hash times an odd number is another order for each number. Few tokens at a time."""
    low = np.full(DIGESTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(tokens), 4096):
        np.minimum(low, (tokens[i : i + 4096, None] * _TIMES).min(axis=0), out=low)
    return low


def agree(x: str, y: str) -> Column:
    """Whether enough digests of the two sides are the same."""

    def differ(c: str) -> Column:
        bits = F.col(f"{c}{x}").bitwiseXOR(F.col(f"{c}{y}"))
        return F.bit_count(bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return reduce(Column.__add__, map(differ, MARKS)) <= DIGESTS - AGREE


def features(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, h, k, fp, bands, d0, ...) of each row: its text's hash, the set's key, the fingerprint, band keys and digests."""
    schema = "doc_id long, h long, k long, fp long, bands array<long>, " + ", ".join(f"{m} long" for m in MARKS)

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(2).cast(pa.large_binary()).to_pylist():
                hashes = shingle_hashes(t, size)
                tokens = np.unique(hashes)
                low = _minima(tokens)
                bands = [_key(np.append(low[i * ROWS : (i + 1) * ROWS], np.uint64(i))) for i in range(BANDS)]
                two = (low >> np.uint64(8)) & np.uint64(3)
                marks = [int((two[i : i + 32] << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(dtype=np.uint64).view(np.int64)) for i in range(0, DIGESTS, 32)]
                out.append((_key(tokens), _fingerprint(hashes) if len(hashes) else 0, bands, *marks))
            cols = list(zip(*out)) or [[]] * (3 + len(MARKS))
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * len(MARKS)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "h", "k", "fp", "bands", *MARKS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def texts_of(docs: DataFrame, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(k, text): one text of each set of ids (k). rows: the features of docs."""
    one = rows.join(ids, "k", "left_semi").groupBy("k").agg(F.min("h").alias("h"))  # texts of one set are one class
    one = F.broadcast(one) if is_small(one, BROADCAST_IDS) else one
    return docs.select(F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text")).join(one, "h").groupBy("k").agg(F.first("text").alias("text"))


def verified(texts: DataFrame, pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of keys whose sets are as similar as the threshold."""

    def run(batches):
        for b in batches:
            sides = (c.cast(pa.large_binary()) for c in b.columns[2:])
            keep, last = [], (None, None)
            for x, y in zip(*sides):
                x, y = x.as_py(), y.as_py()
                one = last[1] if last[0] == x else np.unique(shingle_hashes(x, size))
                last, two = (x, one), np.unique(shingle_hashes(y, size))
                i = len(np.intersect1d(one, two, assume_unique=True))
                # i / (n - i) >= t, for i common shingles and n in both sets together
                keep.append(i >= threshold * (len(one) + len(two) - i) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("k").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """(a, b): links between keys of different sets, whose components are those of all links between candidates."""
    sets = checkpoint(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), *[F.first(m).alias(m) for m in MARKS]))
    keys = sets.select(F.col("k").alias("id"), "n", F.explode("bands").alias("band")).repartition("band")
    near = checkpoint(keys.join(most_frequent(keys), "band").select("band", "id", "n", "top"))
    # SimHash: links of fingerprints, by one set of each; and sets with one fingerprint
    first = sets.groupBy("fp").agg(F.min("k").alias("first"))
    close = simhash.links(first.select("fp")).join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    close = close.select("x", "y").union(sets.join(first, "fp").filter("k <> first").select("k", "first"))
    close = checkpoint(close.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    ids = near.select(F.col("id").alias("k")).union(close.select(F.explode(F.array("a", "b")))).distinct()
    texts = checkpoint(texts_of(docs, rows, checkpoint(ids)))
    verify = lambda pairs: verified(texts, pairs, size, threshold)
    return band_links(near, sets.select(F.col("k").alias("id"), *MARKS), agree, verify, found=checkpoint(verify(close)))


def keep_one(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that stay: of each class, the one with the smallest doc_id. Rows without a doc_id all stay.

    A row is its doc_id and text: rows that share only one of them are different rows, and of equal ones one stays.
    """
    base = checkpoint(features(docs, size))
    tops = components(links(docs, base, size, threshold)).select(F.col("node").alias("k"), "root")
    rows = base.filter("doc_id IS NOT NULL").join(tops, "k", "left").select("doc_id", "h", F.coalesce("root", "k").alias("cls"))
    first = rows.groupBy("cls").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("rows"))
    i, h, d, g, n = unused(docs, "i", "h", "d", "g", "n")
    stay = first.select(F.col("first.doc_id").alias(d), F.col("first.h").alias(g), F.col("rows").alias(n))
    named = docs.withColumn(h, F.xxhash64("text")).withColumn(i, F.col("doc_id").cast("long"))
    out = named.join(stay, (F.col(i) == F.col(d)) & (F.col(h) == F.col(g)))
    single = out.filter(F.col(n) == 1).select(*docs.columns)
    some = out.filter(F.col(n) > 1).dropDuplicates([d, g]).select(*docs.columns)
    return single.union(some).union(docs.filter("doc_id IS NULL"))
