"""Incremental bronze ingest: new files of a folder become rows of a table, once each.

The batch engine has no streams; this is the same plan over ``readStream`` with an available-now trigger. The
checkpoint folder keeps which files were taken, so a restart neither loses nor repeats one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ingest(spark: SparkSession, folder: str, schema: T.StructType, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, fmt: str = "parquet", files_per_batch: int = 1000, **options) -> None:
    """Takes what has arrived and stops."""
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options).load(folder)
    q = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination()
