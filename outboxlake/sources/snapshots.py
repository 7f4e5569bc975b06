"""Versioned parquet snapshots with an exclusive commit file per version.

A writer puts new table versions next to the old ones and then creates the commit
file, which fails if another writer got there first. Readers follow the newest commit.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outboxlake.functions import states

CLOSED = "closed"


class CommitConflict(RuntimeError):
    pass


@dataclass(frozen=True)
class SnapshotStore:
    spark: SparkSession
    root: str

    def _fs(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return target.getFileSystem(conf), target

    def _commit_path(self, version: int) -> str:
        return f"{self.root}/_commits/{version:010d}.json"

    def version(self) -> int:
        """Newest committed version, 0 if there is none."""
        fs, folder = self._fs(f"{self.root}/_commits")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)

    def _tables(self, version: int) -> dict[str, str]:
        if version == 0:
            return {}
        text = self.spark.read.text(self._commit_path(version), wholetext=True).head()[0]
        return json.loads(text)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        return self.spark.read.parquet(self._tables(version)[table]).drop(CLOSED)

    def read_open(self, version: int | None = None) -> DataFrame:
        """Deliveries that may still change by themselves: one partition of the table."""
        version = self.version() if version is None else version
        path = self._tables(version)["deliveries"]
        return self.spark.read.parquet(path).filter(~F.col(CLOSED)).drop(CLOSED)

    def commit(self, expected: int, **tables: DataFrame) -> int:
        """Writes tables as the version after ``expected``; others carry over."""
        version = expected + 1
        paths = self._tables(expected)
        for name, df in tables.items():
            path = f"{self.root}/{name}/{version:010d}-{df.sparkSession._jvm.java.util.UUID.randomUUID()}"
            if name == "deliveries":
                df.withColumn(CLOSED, ~states.is_open()).write.partitionBy(CLOSED).parquet(path)
            else:
                df.write.parquet(path)
            paths[name] = path
        fs, target = self._fs(self._commit_path(version))
        try:
            stream = fs.create(target, False)
        except Exception as error:
            raise CommitConflict(f"version {version} was committed by another writer") from error
        stream.write(bytearray(json.dumps(paths).encode()))
        stream.close()
        return version
