"""A durable log of finished micro-batches.

A listener writes one small file per batch of every named query, named after query and batch,
so a batch that is reported again replaces its row. The log outlives the session and holds
every batch, not only those a query still remembers.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from outboxlake.schemas import RUN_LOG


class RunLog(StreamingQueryListener):
    """Register with ``spark.streams.addListener``; the worker is the query's name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self, query_id: str, batch_id: int):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{query_id}-{batch_id:012d}.json")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def rows(self) -> DataFrame:
        return self.spark.read.schema(RUN_LOG).json(self.path)

    def settled(self, query: StreamingQuery, seconds: float = 30) -> bool:
        """Waits until the last batch of a stopped query is in the log; reports come with a delay."""
        last = query.lastProgress
        if last is None:
            return True
        end = time.monotonic() + seconds
        fs, file = self._file(str(last["id"]), int(last["batchId"]))
        while not fs.exists(file):
            if time.monotonic() > end:
                return False
            time.sleep(0.05)
        return True

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name is None:
            return
        row = {
            "query_id": str(progress.id),
            "batch_id": progress.batchId,
            "worker": progress.name,
            "started_at": progress.timestamp,
            "duration_seconds": progress.durationMs.get("triggerExecution", 0) / 1000.0,
        }
        fs, file = self._file(row["query_id"], row["batch_id"])
        stream = fs.create(file, True)
        stream.write(bytearray(json.dumps(row).encode()))
        stream.close()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
