"""Calls that arrive as a stream, added to a table of carriers batch by batch.

Carriers are a set, so a batch is deduplicated and appended under its batch id;
replaying a batch overwrites the same folder, and ``carriers`` reads the union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.variants import genotype_code
from ..plans.compile import VARIANT


def ingest(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts writing the carriers of a stream of calls; stops when what is there now is read."""

    def add(batch: DataFrame, batch_id: int) -> None:
        hit = batch.where(genotype_code(F.col("gt")) != 0)
        hit.select(*VARIANT, "sample").distinct().write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return calls.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def carriers(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*VARIANT, "sample").distinct()
