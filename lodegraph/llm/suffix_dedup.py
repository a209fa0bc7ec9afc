"""Removal of long repeats: common-prefix interval trees over an enhanced suffix array, dealt out by anchors.

A byte is removed if a `size`-byte string that covers it also starts anywhere else, in the same text or another; strings
never cross texts, and all are judged on the input. Texts are their UTF-8 bytes.

How it scales. Of the `gram`-byte strings in a window of `size` bytes the one with the least hash (all of them, if
several tie) is the window's anchor. Equal windows have equal anchors at equal places, so a repeat can be found among
the occurrences of one anchor string. Anchors are counted over all texts; those of a string that occurs once go no
further. For each other occurrence its context (the `size` bytes from it, the `size - gram` bytes before it) goes to its
string's shard. A shard sorts the contexts from the anchor on (an enhanced suffix array of the anchored suffixes),
stack-scans their common prefixes into the interval tree, and in each interval tests how far its members extend to the
left together: members that share `left` bytes before and `right` bytes from the anchor, with left + right >= size, are a
maximal repeat, and all its occurrences are reported, not only neighbours.

Equal texts are one text with a count (if that is over one, all of it is repeated), so copies cost nothing. A string
with over `shard_rows` occurrences isn't gathered in one shard: its windows are counted one by one by their 128-bit
digests, with partial sums on the map side, which gives the same result.

Null text is empty text. Texts shorter than `size` lose nothing. Rows that repeat a doc_id each get their own result.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import checkpoint, table

SIZE, GRAM = 400, 128
#: bytes of text that are worked on at once, and rows of lists
STEP_BYTES, STEP_ROWS = 250_000, 500
#: bytes of contexts that are sent on at once
CONTEXT_BYTES = 1_000_000

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_TIMES = _rng.integers(1, 1 << 63, 32, dtype=np.uint64) | np.uint64(1)


def gram_hashes(a: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of a[i : i + gram], for each i; gram is a power of two. Built by doubling."""
    h, n, level = _BYTE[a], 1, 0
    while n < gram:
        h = h[:-n] * _TIMES[level] + h[n:]
        n, level = n * 2, level + 1
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding(x: np.ndarray, w: int, op, pad) -> np.ndarray:
    """op over x[i : i + w] for each i with i + w <= len(x)."""
    n = len(x)
    full = np.full(-(-n // w) * w, pad, x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - w + 1], ahead[w - 1 : n])


def anchors(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in a, and their hashes; texts are a[start:end], one after another."""
    if len(a) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(a, gram)
    rank = (h >> np.uint64(32)).astype(np.uint32)
    np.maximum(rank, np.uint32(1), out=rank)  # 0 is for places in no window
    w = size - gram + 1
    least = _sliding(rank, w, np.minimum, np.uint32(0xFFFFFFFF))  # of the window that starts here
    valid = np.zeros(len(least) + 1, np.int8)  # windows within one text
    long = ends - starts >= size
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, np.minimum(ends[long] - size + 1, len(least)), -1)
    inside = np.cumsum(valid[:-1], dtype=np.int8) > 0
    least = np.where(inside, least, np.uint32(0))
    edge = np.zeros(len(rank) + w - 1, np.uint32)
    edge[w - 1 : w - 1 + len(least)] = least
    highest = _sliding(edge, w, np.maximum, np.uint32(0))[: len(rank)]  # over the windows that hold the gram
    at = np.flatnonzero((highest == rank) & (highest > 0))
    return at, h[at]


def _texts(batch, column: int):
    """Pieces of a batch with bounded bytes: (first row, bytes, starts, ends)."""
    col = batch.column(column).cast(pa.large_binary())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + STEP_BYTES, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i]
        i = j


def _lists(batches):
    """The columns of a few rows at a time, as lists."""
    for batch in batches:
        i = 0
        while i < batch.num_rows:
            piece = batch.slice(i, STEP_ROWS)
            yield [c.to_pylist() for c in piece.columns]
            i += STEP_ROWS


def _hits(batches):
    """(keys, texts, offsets, grams, places, hots) of a few rows (key, text, n, hits) at a time; hits of row i are those from offsets[i] to offsets[i + 1]."""
    for batch in batches:
        for i in range(0, batch.num_rows, STEP_ROWS):
            piece = batch.slice(i, STEP_ROWS)
            hits = piece.column(3)
            offsets = hits.offsets.to_numpy()
            gram, at, hot = hits.values.slice(offsets[0], offsets[-1] - offsets[0]).flatten()
            yield piece.column(0).to_pylist(), piece.column(1).to_pylist(), (offsets - offsets[0]).tolist(), gram.to_numpy().tolist(), at.to_numpy().tolist(), hot.to_numpy(zero_copy_only=False).tolist()


def lce(x: bytes, y: bytes) -> int:
    """How many first bytes are the same."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    d = int.from_bytes(x[:n], "little") ^ int.from_bytes(y[:n], "little")
    return ((d & -d).bit_length() - 1) >> 3


def intervals(prefix: list[int], least: int) -> list[tuple[int, int, int]]:
    """The common-prefix intervals (length, first, last) with a length of at least `least`; prefix[i]: of suffixes i and i + 1. A stack scan."""
    out, stack = [], []
    for i, p in enumerate([*prefix, -1]):
        first = i
        while stack and stack[-1][0] > p:
            length, first = stack.pop()
            out.append((length, first, i))
        if p >= least and (not stack or stack[-1][0] < p):
            stack.append((p, first))
    return out


def extents(lefts: list[bytes], rights: list[bytes], size: int) -> dict[int, tuple[int, int]]:
    """For each context that is in some maximal repeat of size bytes: how far its repeats reach to the left and right. lefts are reversed."""
    n = len(rights)
    if n == 2:
        right = lce(rights[0], rights[1])
        left = lce(lefts[0], lefts[1]) if right >= size - min(len(lefts[0]), len(lefts[1])) else 0
        return {0: (left, right), 1: (left, right)} if left + right >= size else {}
    order = sorted(range(n), key=rights.__getitem__)
    prefix = [lce(rights[i], rights[j]) for i, j in zip(order, order[1:])]
    most = max(map(len, lefts))
    found = intervals(prefix, max(1, size - most))
    if not found:
        return {}
    by_left = sorted(range(n), key=lefts.__getitem__)
    common = [lce(lefts[i], lefts[j]) for i, j in zip(by_left, by_left[1:])]
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    if n > 64:
        return _extents_many(np.array(order), found, np.array(rank), np.array(by_left), np.array(common), size)
    left, right = [0] * n, [0] * n
    for r, first, last in found:
        ranks = sorted(rank[i] for i in order[first : last + 1])
        for x, y in zip(ranks, ranks[1:]):
            shared = min(common[x:y])
            if shared + r >= size:
                for i in (by_left[x], by_left[y]):
                    left[i], right[i] = max(left[i], shared), max(right[i], r)
    return {i: (left[i], right[i]) for i in range(n) if right[i]}


def _extents_many(order, found, rank, by_left, common, size) -> dict[int, tuple[int, int]]:
    levels = [common.astype(np.int32)]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        x, k = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(x[:-k], x[k:]))
    width = len(common)
    tab = np.zeros((len(levels), width), np.int32)
    for k, x in enumerate(levels):
        tab[k, : len(x)] = x
    left, right = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
    for r, first, last in found:
        ranks = np.sort(rank[order[first : last + 1]])
        x, y = ranks[:-1], ranks[1:]
        k = np.frexp((y - x).astype(np.float64))[1] - 1
        shared = np.minimum(tab[k, x], tab[k, y - (1 << k)])
        ok = shared + r >= size
        for side in (x, y):
            i = by_left[side[ok]]
            left[i] = np.maximum(left[i], shared[ok])
            right[i] = np.maximum(right[i], r)
    return {int(i): (int(left[i]), int(right[i])) for i in np.flatnonzero(right)}


def _key(text):
    # never null, and known not to be: an inner join's own filter for that would give it another exchange than a left join's
    return F.coalesce(F.substring(F.unhex(F.sha2(text, 256)), 1, 16), F.lit(bytearray()))


def repeated_anchors(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(gram, n): anchor hashes that occur in different texts or more than once in a text, and how often in all rows."""

    def run(batches):
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for i, a, starts, ends in _texts(batch, 0):
                at, h = anchors(a, starts, ends, size, gram)
                doc = np.searchsorted(starts, at, "right") - 1
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(keys[i + doc[new]]), pa.array(times)], names=["gram", "text", "times"])

    rows = docs.select(F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("h")).mapInArrow(run, "gram long, text long, times long")
    per = rows.groupBy("gram").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.max("times").alias("most"), F.sum("times").alias("n"))
    return per.filter("a <> b OR most > 1").select("gram", "n")


def repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, shard_rows: int = 50_000) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) of each different text; key is the first half of its SHA-256, spans [start, end) of bytes."""
    repeated = checkpoint(repeated_anchors(docs, size, gram))
    some_hot = not repeated.filter(F.col("n") > shard_rows).isEmpty()
    texts = docs.select(_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))

    def places(batches):
        for batch in batches:
            for i, a, starts, ends in _texts(batch, 1):
                at, h = anchors(a, starts, ends, size, gram)
                doc = np.searchsorted(starts, at, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + doc)), pa.array(h.view(np.int64)), pa.array((at - starts[doc]))], names=["key", "gram", "at"])

    # each use of texts takes all its columns, so that they share one exchange
    hits = texts.mapInArrow(places, "key binary, gram long, at long").join(repeated, "gram")
    hits = hits.groupBy("key").agg(F.collect_list(F.struct("gram", "at", (F.col("n") > shard_rows).alias("hot"))).alias("hits"))

    def contexts(batches):
        # a context that a text has again is covered in full there and there; only the first goes to a shard
        for keys, texts_, offsets, grams, places_, hots in _hits(batches):
            rows: list[tuple] = []
            held = 0
            for key, text, i, j in zip(keys, texts_, offsets, offsets[1:]):
                seen: dict[bytes, int] = {}
                length = len(text)
                for at, gram_, hot in zip(places_[i:j], grams[i:j], hots[i:j]):
                    start, end = max(0, at - size + gram), min(length, at + size)
                    if end - start < size:
                        continue
                    whole = hashlib.blake2b(text[start:end], digest_size=16, salt=(at - start).to_bytes(8, "little")).digest()
                    if whole not in seen:
                        seen[whole] = start
                        rows.append((gram_, key, at, hot, text[start:at][::-1], text[at:end], None))
                        held += end - start
                    else:
                        if seen[whole] >= 0:
                            rows.append((gram_, key, seen[whole], False, None, None, seen[whole] + end - start))
                            seen[whole] = -1
                        rows.append((gram_, key, start, False, None, None, end))
                        held += 64
                    if held > CONTEXT_BYTES:
                        yield pack(rows)
                        rows, held = [], 0
            if rows:
                yield pack(rows)

    def pack(rows):
        types = [pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["gram", "key", "at", "hot", "left", "right", "end"])

    ctx = texts.join(hits, "key").select("key", "text", "n", "hits").mapInArrow(contexts, "gram long, key binary, at long, hot boolean, left binary, right binary, end long")

    def shards(batches):
        gram_, held = None, []
        for columns in _lists(batches):
            out: list[list] = [[], [], []]
            for row in zip(*columns):
                if row[0] != gram_:
                    close(held, out)
                    gram_, held = row[0], []
                if row[6] is None:
                    held.append(row)
                else:
                    for col, v in zip(out, (row[1], row[2], row[6])):
                        col.append(v)
            yield spans_batch(out)
        out = [[], [], []]
        close(held, out)
        yield spans_batch(out)

    def close(held, out):
        if len(held) > 1:
            for i, (left, right) in extents([x[4] for x in held], [x[5] for x in held], size).items():
                out[0].append(held[i][1])
                out[1].append(held[i][2] - left)
                out[2].append(held[i][2] + right)

    def spans_batch(out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["key", "start", "end"])

    # one exchange for both kinds, which both read with all columns: hot strings are dealt by text, too. A filter that isn't
    # deterministic (its random part is always 0) stays above the exchange
    dealt = ctx.repartition("gram", F.when(F.col("hot"), F.hash("key")).otherwise(F.lit(0))) if some_hot else ctx.repartition("gram")
    cold = dealt.filter("cast(hot AS int) + cast(rand() AS int) = 0") if some_hot else dealt
    found = cold.sortWithinPartitions("gram").mapInArrow(shards, "key binary, start long, end long")
    if some_hot:

        def windows(batches):
            for columns in _lists(batches):
                out: list[list] = [[], [], [], []]
                for _, key, at, _, left, right, _ in zip(*columns):
                    whole, a = left[::-1] + right, len(left)
                    n = len(whole) - size + 1
                    out[0] += [hashlib.blake2b(whole[p : p + size], digest_size=16).digest() for p in range(n)]
                    out[1] += [key] * n
                    out[2] += [at] * n
                    out[3] += range(at - a, at - a + n)
                    if len(out[0]) > 50_000:
                        yield windows_batch(out)
                        out = [[], [], [], []]
                yield windows_batch(out)

        def windows_batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["w", "key", "at", "p"])

        each = dealt.filter("cast(hot AS int) + cast(rand() AS int) = 1").mapInArrow(windows, "w binary, key binary, at long, p long")
        # a window occurs again if it has two places
        many = each.groupBy("w").agg(F.min(F.struct("key", "p")).alias("a"), F.max(F.struct("key", "p")).alias("b")).filter("a <> b").select("w")
        wide = each.join(many, "w").groupBy("key", "at").agg(F.min("p").alias("start"), (F.max("p") + size).alias("end"))
        found = found.union(wide.select("key", "start", "end"))
    found = found.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def assemble(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for columns in _lists(batches):
            rows: list[list] = [[], [], [], [], [], []]
            for key, text, n, found in zip(*columns):
                if n > 1 and len(text) >= size:
                    found = [{"start": 0, "end": len(text)}]
                merged: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in found or []):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                kept, at = hashlib.sha256(), 0
                for s, e in merged:
                    kept.update(text[at:s])
                    at = e
                kept.update(text[at:])
                removed = sum(e - s for s, e in merged)
                for col, v in zip(rows, (key, len(text), removed, len(merged), kept.hexdigest(), [{"start": s, "end": e} for s, e in merged])):
                    col.append(v)
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return texts.join(found, "key", "left").select("key", "text", "n", "spans").mapInArrow(assemble, schema)


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The columns of docs, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans, row by row."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans").withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    found = repeats(docs.select("text"), size)
    return docs.withColumn("_key", _key(F.col("text"))).join(found.withColumnRenamed("key", "_key"), "_key").drop("_key")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = repeats(docs.select(text.alias("text"))).drop("spans")
    return docs.select("doc_id", _key(text).alias("key")).join(found, "key").drop("key")
