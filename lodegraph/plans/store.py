"""Snapshots: a folder a version, and a pointer to the current one.

A write makes a new version with all tables, then moves the pointer by renaming one file, so readers see the old tables
or the new ones. Paths may be in any file system that Spark reaches; files are handled by its own API.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.plans.schemas import TABLES, VERSION


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """Versions that were finished, oldest first."""
        if not self.fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        return sorted(int(n[9:]) for n in names if n.startswith("_CURRENT-"))

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, table: str) -> DataFrame:
        done = self.versions()
        if not done or not self.fs.exists(self._path(f"v{done[-1]}/{table}")):  # a store of a version without that table
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/v{done[-1]}/{table}")

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in TABLES}

    def write(self, **tables: DataFrame) -> int:
        """A new version; tables that aren't given stay as they are. Returns its number."""
        version = (self.versions() or [0])[-1] + 1
        for name in TABLES:
            df = conform(tables[name], name) if name in tables else self.read(name)
            df.write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
        self.spark.createDataFrame([(VERSION, version)], "schema_version int, version int").coalesce(1).write.mode("overwrite").json(f"{self.path}/v{version}/_meta")
        self.fs.create(self._path(f"_CURRENT-{version}"), True).close()  # the pointer, last
        return version

    def prune(self, keep: int = 2) -> None:
        for v in self.versions()[:-keep]:
            self.fs.delete(self._path(f"_CURRENT-{v}"), False)
            self.fs.delete(self._path(f"v{v}"), True)

    def reset(self) -> None:
        self.fs.delete(self._path(""), True)


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order; missing ones get their defaults or null."""
    from pyspark.sql.types import StructType

    defaults = {"summary_status": F.lit("pending"), "embedding_status": F.lit("pending"), "confidence": F.lit(1.0), "link_type": F.lit("strong"), "weak": F.lit(False), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    schema = StructType.fromDDL(TABLES[table])
    return df.select(*[(F.col(f.name) if f.name in df.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema])
