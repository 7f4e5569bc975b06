"""Written steps: results kept in the shared folder, so that lost executors cost no rerun."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from outboxlake.session import fresh_path

#: Rows in an Arrow batch: texts may be long, and a batch is held in memory as a whole.
BATCH_ROWS = 1000


SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    # Packed blocks are large rows: batches of them are bounded in bytes as well.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    # Joins of texts or sets with the ids they are needed for drop other rows before the
    # exchange. The filter's size is bounded (runtime.bloomFilter.maxNumBits); a full one
    # only lets more rows through to the join itself.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "16m",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """The rows, written once to `spark.checkpoint.dir` and read from there."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
