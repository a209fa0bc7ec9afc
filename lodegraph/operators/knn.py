"""Exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.vector import l2_to, matrix, similarity

#: Most bytes of query-side vectors, as doubles, that one task holds.
QUERY_BYTES = 64 << 20


def knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """vectors (id, embedding) -> the k nearest: id, distance, similarity. Ties by id; k <= 0 gives none."""
    scored = vectors.filter("embedding IS NOT NULL").select("id", l2_to(query)("embedding").alias("distance"))
    return scored.orderBy("distance", "id").limit(max(k, 0)).withColumn("similarity", similarity(F.col("distance")))


def knn_within(vectors: DataFrame, ids: DataFrame, query: list[float], k: int) -> DataFrame:
    """The same over the vectors whose id is in ids."""
    return knn(vectors.join(ids.select("id").distinct(), "id", "left_semi"), query, k)


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """(id, embedding): element-wise mean of the vectors of each group, of all one length. Every batch sends one sum a group."""

    def partial(batches):
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            ids, m = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1))
            if not len(ids):
                continue
            order = np.argsort(ids, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
            sums = np.add.reduceat(m[order], at, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[order][at]), pa.array(np.diff(np.append(at, len(ids)))), pa.array(list(sums), pa.list_(pa.float64()))], names=["id", "n", "sums"])

    def total(key, t):
        mean = matrix(t.column("sums").combine_chunks()).sum(axis=0) / sum(t.column("n").to_pylist())
        return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "embedding": pa.array([mean], pa.list_(pa.float64()))})

    sums = vectors.filter(F.col(group).isNotNull()).select(F.col(group).cast("long").alias("id"), "embedding").mapInArrow(partial, "id long, n long, sums array<double>")
    return sums.groupBy("id").applyInArrow(total, "id long, embedding array<double>")


def similarity_topk(queries: DataFrame, vectors: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """For each query (qid, embedding) its k nearest vectors (id, embedding): qid, id, distance, similarity.

    Queries of at most query_bytes, by a count first, go to every task in one piece. More are dealt to blocks, vectors to
    slices, of that size, and every block meets every slice in a task of its own. Either way a task sends its k best for
    each query, so what is exchanged is bounded by k rows a query and task, and no pair but those is a row.
    """
    q = queries.filter("embedding IS NOT NULL").select(F.col("qid").cast("long").alias("qid"), "embedding")
    v = vectors.filter("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), "embedding")
    schema = "qid long, id long, distance double"
    size = lambda df: df.agg(F.coalesce(F.sum(8 * F.size("embedding")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-size(q) // query_bytes)
    if blocks <= 1:
        rows = q.orderBy("qid").collect()
        qid, m = np.array([r["qid"] for r in rows], np.int64), np.array([r["embedding"] for r in rows], np.float64)

        def one(batches):
            for b in batches:
                yield _best(qid, m, b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1)), k)

        out = v.mapInArrow(one, schema)
    else:
        slices = max(1, -(-size(v) // query_bytes))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = q.withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("s", each(slices))
        v = v.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")).withColumn("b", each(blocks))

        def both(left, right):
            side = lambda t, c: (t.column(c).to_numpy(), matrix(t.column("embedding").combine_chunks()))
            return pa.Table.from_batches([_best(*side(left, "qid"), *side(right, "id"), k)])

        out = q.groupBy("b", "s").cogroup(v.groupBy("b", "s")).applyInArrow(both, schema)
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r").withColumn("similarity", similarity(F.col("distance")))


def _best(qid: np.ndarray, m: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest of v for each row of m, by differences: a product of matrices only leaves out what its error can't reach."""
    out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    norm = (v**2).sum(1)
    for i in range(0, len(qid) if len(ids) and k > 0 else 0, 256):
        part = m[i : i + 256]
        own = (part**2).sum(1)
        rough = own[:, None] + norm - 2 * part @ v.T
        # each of the three sums is off by at most its number of steps times the rounding of what it adds up
        error = 4 * (v.shape[1] + 4) * np.finfo(np.float64).eps * (own + norm.max())
        reach = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * error if len(ids) > k else np.full(len(part), np.inf)
        for j in range(len(part)):
            near = np.flatnonzero(rough[j] <= reach[j])
            d = np.sqrt(((v[near] - part[j]) ** 2).sum(axis=1))
            first = np.lexsort((ids[near], d))[:k]
            out[0].append(np.full(len(first), qid[i + j]))
            out[1].append(ids[near][first])
            out[2].append(d[first])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["qid", "id", "distance"])
