"""Stores: a folder of Parquet tables with a manifest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VERSION = 1


class Store:
    """An index in a folder that Spark can read: its tables, and parameters in ``manifest``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def save(self, tables: dict[str, DataFrame], parameters: dict, partition_by: dict[str, str] | None = None) -> None:
        """Write all tables, and last the manifest, which makes the index exist."""
        for name, table in tables.items():
            writer = table.write.mode("overwrite")
            column = (partition_by or {}).get(name)
            (writer.partitionBy(column) if column else writer).parquet(f"{self.path}/{name}")
        manifest = json.dumps({"version": VERSION, "tables": sorted(tables), "parameters": parameters})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")

    def manifest(self) -> dict:
        found = json.loads(self.spark.read.text(f"{self.path}/manifest").first()[0])
        if found["version"] != VERSION:
            raise ValueError(f"version {found['version']} of an index cannot be read")
        return found

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def load(self) -> tuple[dict[str, DataFrame], dict]:
        manifest = self.manifest()
        return {name: self.table(name) for name in manifest["tables"]}, manifest["parameters"]

    def get_or_build(self, build: Callable[[], tuple[dict[str, DataFrame], dict]], parameters: dict, partition_by: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], dict]:
        """The stored index if it has these parameters, else a new one."""
        if not self.exists() or any(self.manifest()["parameters"].get(k) != v for k, v in parameters.items()):
            tables, more = build()
            self.save(tables, parameters | more, partition_by)
        return self.load()


def write_csv(result: DataFrame, path: str) -> None:
    """A result as CSV with a header."""
    result.write.mode("overwrite").csv(path, header=True)
