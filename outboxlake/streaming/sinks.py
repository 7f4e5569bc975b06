"""Folders that streams and batch jobs append to, one per (writer, micro-batch).

A writer is a stream (named by its query id, which lives in the checkpoint) or a batch run.
Rows are written aside and put in place by one rename, so a folder is seen whole or not at
all; a batch that runs again replaces its own folder. A stream with a new checkpoint is a new
writer and leaves the folders of the old one alone. Readers list the folders with one glob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Events of a batch up to which their rows are looked up by a list of ids.
LOOKUP_IDS = 1000


@dataclass(frozen=True)
class Part:
    writer: str
    batch: int
    #: A number its writer gave it, such as the highest id inside.
    top: int
    path: str


def writer_of(batch: DataFrame) -> str:
    """The id of the stream whose ``foreachBatch`` this is called in."""
    named = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not named:
        raise RuntimeError("not called inside a micro-batch")
    return named


@dataclass(frozen=True)
class Folders:
    spark: SparkSession
    path: str

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def parts(self) -> list[Part]:
        fs, pattern = self._fs(f"{self.path}/writer=*/batch=*/top=*")
        found = []
        for status in fs.globStatus(pattern) or []:
            place = status.getPath().toString()
            writer, batch, top = (level.split("=", 1)[1] for level in place.split("/")[-3:])
            found.append(Part(writer, int(batch), int(top), place))
        return sorted(found, key=lambda p: (p.writer, p.batch))

    def read(self, parts: list[Part], schema) -> DataFrame | None:
        if not parts:
            return None
        return self.spark.read.schema(schema).parquet(*[p.path for p in parts])

    def write(self, rows: DataFrame, writer: str, batch: int, top: str | None = None) -> Part:
        """Puts rows in place as one batch of a writer; ``top`` names a column whose maximum is kept."""
        aside = f"{self.path}/_aside/{uuid.uuid4().hex}"
        options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("event_id",) if c in rows.columns}
        rows.write.options(**options).parquet(aside)
        highest = 0
        if top is not None:
            highest = self.spark.read.schema(rows.schema).parquet(aside).agg(F.coalesce(F.max(top), F.lit(0))).first()[0]
        part = Part(writer, batch, highest, f"{self.path}/writer={writer}/batch={batch}/top={highest}")
        fs, folder = self._fs(f"{self.path}/writer={writer}/batch={batch}")
        fs.delete(folder, True)
        fs.mkdirs(folder)
        target = self._fs(part.path)[1]
        if not fs.rename(self._fs(aside)[1], target):
            raise RuntimeError(f"could not put {part.path} in place")
        return part

    def replace(self, parts: list[Part], rows: DataFrame, writer: str, batch: int) -> None:
        """Takes parts out for one that holds what they held. Not while another job writes."""
        self.write(rows, writer, batch)
        for part in parts:
            if (part.writer, part.batch) != (writer, batch):
                fs, folder = self._fs(f"{self.path}/writer={part.writer}/batch={part.batch}")
                fs.delete(folder, True)


class DeliverySink:
    """Delivery rows on top of a base table, appended by streams and backfills.

    Writers that append at the same time may insert the same key twice, so a backfill runs
    while the stream rests. A batch that runs again does not see its own earlier rows.
    """

    def __init__(self, spark: SparkSession, path: str, base: DataFrame):
        self.spark, self.path, self.base = spark, path, base
        self.folders = Folders(spark, path)

    def _parts(self, writer: str | None, batch: int | None) -> list[Part]:
        return [p for p in self.folders.parts() if (p.writer, p.batch) != (writer, batch)]

    def rows(self, writer: str | None = None, batch: int | None = None) -> DataFrame:
        """Base rows and those written, without one batch of one writer if it is named."""
        more = self.folders.read(self._parts(writer, batch), self.base.schema)
        return self.base if more is None else self.base.unionByName(more)

    def new_rows(self) -> DataFrame:
        more = self.folders.read(self._parts(None, None), self.base.schema)
        return self.base.limit(0) if more is None else more

    def rows_of(self, events: DataFrame, writer: str | None = None, batch: int | None = None) -> DataFrame:
        """Rows of the events of a batch. A short batch looks them up by a list of its ids, which
        the files' filters use; a long one meets the stored keys."""
        ids = [r[0] for r in events.select("event_id").distinct().limit(LOOKUP_IDS + 1).collect()]
        stored = self.rows(writer, batch)
        if len(ids) <= LOOKUP_IDS:
            return stored.filter(F.col("event_id").isin(ids))
        return stored.join(events.select("event_id").distinct(), "event_id", "left_semi")

    def highest(self, writer: str | None = None, batch: int | None = None) -> int:
        """Highest id so far: the parts carry theirs in their names."""
        base = self.base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first()["id"]
        return max([base, *(p.top for p in self._parts(writer, batch))])

    def write(self, rows: DataFrame, writer: str, batch: int) -> Part:
        return self.folders.write(rows, writer, batch, "id")


class CountSink:
    """Counts of a stream, kept as partial sums per micro-batch and added up when read.

    Sums do not depend on how rows were dealt to batches, and rows may come as late as they
    like: their window gets another partial sum. ``compact`` puts many parts into one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema, value: str = "value"):
        self.keys, self.schema, self.value = keys, schema, value
        self.folders = Folders(spark, path)

    def write(self, partial: DataFrame, writer: str, batch: int) -> None:
        self.folders.write(partial.select(*self.keys, self.value), writer, batch)

    def totals(self) -> DataFrame:
        """Counts of everything written, windows that are still open included."""
        return self._added(self.folders.parts())

    def _added(self, parts: list[Part]) -> DataFrame:
        rows = self.folders.read(parts, self.schema)
        if rows is None:
            return self.folders.spark.createDataFrame([], self.schema)
        return rows.groupBy(*self.keys).agg(F.sum(self.value).alias(self.value))

    def compact(self, writer: str) -> None:
        """Adds all parts of a writer but its last into one, which may run again. While it rests."""
        parts = [p for p in self.folders.parts() if p.writer == writer][:-1]
        if len(parts) > 1:
            self.folders.replace(parts, self._added(parts), writer, parts[-1].batch)
