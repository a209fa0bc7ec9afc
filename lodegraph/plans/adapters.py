"""The driver's tables as graph, text and vector tables; and the same in SQL, as CTEs for the oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUSTOMER, ORDER, PART, SUPPLIER = 10**9, 2 * 10**9, 3 * 10**9, 4 * 10**9


class Tables:
    """Views of one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("file_id"), "embedding")

    def query_vector(self, vec_id: int = 0) -> list[float]:
        return self.embeddings.filter(F.col("vec_id") == vec_id).first()["embedding"]

    def edges(self) -> DataFrame:
        return self.edge_rows().distinct()

    def edge_rows(self) -> DataFrame:
        """Edges, as often as the tables have them."""
        o = self.orders.select((F.col("o_custkey") + CUSTOMER).alias("source"), (F.col("o_orderkey") + ORDER).alias("target"), F.lit("refs").alias("kind"))
        c = self.lineitem.select((F.col("l_orderkey") + ORDER).alias("source"), (F.col("l_partkey") + PART).alias("target"), F.lit("calls").alias("kind"))
        i = self.lineitem.select((F.col("l_partkey") + PART).alias("source"), (F.col("l_suppkey") + SUPPLIER).alias("target"), F.lit("imports").alias("kind"))
        return o.union(c).union(i)

    def nodes(self) -> DataFrame:
        col = lambda c, t: c.cast(t)
        rows = [
            self.customer.select((F.col("c_custkey") + CUSTOMER).alias("node_id"), col(F.col("c_nationkey"), "long").alias("file_id"), F.col("c_name").alias("name"), F.lit("class").alias("kind"), (F.col("c_custkey") % 97).alias("start_line")),
            self.orders.select((F.col("o_orderkey") + ORDER).alias("node_id"), (F.col("o_orderkey") % 50 + 100).alias("file_id"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("name"), F.lit("function").alias("kind"), (F.col("o_orderkey") % 97).alias("start_line")),
            self.part.select((F.col("p_partkey") + PART).alias("node_id"), (col(F.col("p_size"), "long") + 200).alias("file_id"), F.col("p_name").alias("name"), F.lit("component").alias("kind"), (F.col("p_partkey") % 97).alias("start_line")),
            self.supplier.select((F.col("s_suppkey") + SUPPLIER).alias("node_id"), (col(F.col("s_nationkey"), "long") + 300).alias("file_id"), F.col("s_name").alias("name"), F.lit("module").alias("kind"), (F.col("s_suppkey") % 97).alias("start_line")),
        ]
        return reduce(DataFrame.union, rows).withColumn("is_exported", F.col("start_line") % 2 == 0)

    def files(self) -> DataFrame:
        ids = self.spark.range(0, 400).withColumnRenamed("id", "file_id")
        return ids.withColumn("file_path", F.concat(F.lit("src/m"), (F.col("file_id") / 100).cast("int").cast("string"), F.lit("/f"), F.col("file_id").cast("string"), F.lit(".ts")))

    def texts(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("summary"))

    def resources(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("id"), F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("name"), F.col("text").alias("summary"))

    def snapshot(self, which: str) -> DataFrame:
        """Old: documents not divisible by 7; new: those not divisible by 11, every 13th with another text, every 17th moved."""
        d = self.documents
        text, path = F.col("text"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
        if which == "old":
            d = d.filter("doc_id % 7 <> 0")
        else:
            d = d.filter("doc_id % 11 <> 0")
            text = F.when(F.col("doc_id") % 13 == 0, F.concat(text, F.lit("!"))).otherwise(text)
            path = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("moved/"), F.col("doc_id").cast("string"))).otherwise(path)
        return d.select("doc_id", path.alias("file_path"), F.sha2(text, 256).alias("hash"), text.alias("text"))


EDGES = f"""edges AS (
  SELECT DISTINCT source, target, kind FROM (
    SELECT {CUSTOMER} + o_custkey AS source, {ORDER} + o_orderkey AS target, 'refs' AS kind FROM orders
    UNION ALL SELECT {ORDER} + l_orderkey, {PART} + l_partkey, 'calls' FROM lineitem
    UNION ALL SELECT {PART} + l_partkey, {SUPPLIER} + l_suppkey, 'imports' FROM lineitem))"""
NODES = f"""nodes AS (
  SELECT *, start_line % 2 = 0 AS is_exported FROM (
    SELECT {CUSTOMER} + c_custkey AS node_id, CAST(c_nationkey AS BIGINT) AS file_id, c_name AS name, 'class' AS kind, c_custkey % 97 AS start_line FROM customer
    UNION ALL SELECT {ORDER} + o_orderkey, o_orderkey % 50 + 100, 'order_' || o_orderkey, 'function', o_orderkey % 97 FROM orders
    UNION ALL SELECT {PART} + p_partkey, p_size + 200, p_name, 'component', p_partkey % 97 FROM part
    UNION ALL SELECT {SUPPLIER} + s_suppkey, s_nationkey + 300, s_name, 'module', s_suppkey % 97 FROM supplier))"""
FILES = "files AS (SELECT range AS file_id, 'src/m' || (range // 100) || '/f' || range || '.ts' AS file_path FROM range(400))"
TEXTS = "texts AS (SELECT p_partkey AS id, p_name AS name, p_type || ' ' || p_brand AS summary FROM part)"
RESOURCES = "resources AS (SELECT item_id AS id, 'item_' || item_id AS name, text AS summary FROM benchmark)"
SNAPSHOTS = """old AS (SELECT doc_id, 'doc/' || doc_id AS file_path, sha256(text) AS hash, text FROM documents WHERE doc_id % 7 <> 0),
new AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'moved/' ELSE 'doc/' END || doc_id AS file_path, sha256(t) AS hash, t AS text
  FROM (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END AS t FROM documents WHERE doc_id % 11 <> 0))"""


def walk(start: int | str, direction: str, hops: int, kinds: str = "") -> str:
    """CTEs step and walk (seed, node_id, depth); start is an id or a SELECT of ids."""
    where = f"WHERE kind IN ({kinds})" if kinds else ""
    forward, back = f"SELECT source AS src, target AS dst FROM edges {where}", f"SELECT target AS src, source AS dst FROM edges {where}"
    step = {"callees": forward, "callers": back, "both": f"{forward} UNION {back}"}[direction]
    seeds = f"SELECT CAST({start} AS BIGINT) AS s" if isinstance(start, int) else start
    return f"""step AS ({step}), seeds AS ({seeds}),
walk(seed, node_id, depth) AS (
  SELECT s, s, 0 FROM seeds
  UNION SELECT seed, dst, depth + 1 FROM walk JOIN step ON src = node_id WHERE depth < {hops})"""


def bm25(tokens: list[str], where: str = "texts") -> str:
    """CTE bm25 (id, score) over `where` (id, name, summary), for tokens that can't overlap themselves."""
    tf = lambda t: f"((length(lower(name)) - length(replace(lower(name), '{t}', ''))) // {len(t)} + (length(lower(summary)) - length(replace(lower(summary), '{t}', ''))) // {len(t)})"
    cols = ", ".join(f"{tf(t)} AS tf{i}" for i, t in enumerate(tokens))
    sums = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in range(len(tokens)))
    idf = lambda i: f"ln((n - n{i} + 0.5) / (n{i} + 0.5))"
    parts = " + ".join(f"(CASE WHEN {idf(i)} <= 0 THEN 1e-6 ELSE {idf(i)} END) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(tokens)))
    return f"""tfs AS (SELECT id, CAST(greatest(length(name) - 2, 0) + greatest(length(summary) - 2, 0) AS DOUBLE) AS dl, {cols} FROM {where}),
sums AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {sums} FROM tfs),
bm25 AS (SELECT id, -({parts}) AS score FROM tfs, sums WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(tokens)))})"""
