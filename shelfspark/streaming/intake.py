"""Cleaning exports as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators.cleaning import clean_rows
from shelfspark.sources.exports import read_export

# Files of one batch; their names go through the driver.
BATCH_FILES = 1000


def clean_arrivals(
    spark: SparkSession, folder: str, target: str, checkpoint: str, multi_line: bool = True
) -> StreamingQuery:
    """Clean all files that have come to ``folder`` since the last run, then stop.

    The stream tells which files are new; each batch of them goes through the batch
    reader, so encodings, headers, surplus cells and row positions are as there. A batch
    is written to a folder of its own under ``target``, so doing it again is harmless.
    Only the row-local stage runs here. Which row keeps an id, category names and
    copies depend on all rows and are decided by the batch build.
    """
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", BATCH_FILES)
        .load(folder)
        .select("path")
    )

    def clean(batch: DataFrame, number: int) -> None:
        paths = [row.path for row in batch.collect()]
        if paths:
            rows = read_export(spark, paths, multi_line).rows
            clean_rows(rows).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        arrivals.writeStream.foreachBatch(clean)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
