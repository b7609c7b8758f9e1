"""The catalogue as Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfspark.session import _file_system


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Write each table below ``folder``; one with a column ``bucket`` in a folder per bucket."""
    for name, table in tables.items():
        parts = ["bucket"] if "bucket" in table.columns else []
        table.write.mode("overwrite").partitionBy(*parts).parquet(f"{folder.rstrip('/')}/{name}")


def pending_folder(folder: str) -> str:
    """A folder beside ``folder`` for tables that are still being written."""
    return f"{folder.rstrip('/')}.pending-{uuid.uuid4().hex}"


def switch(spark: SparkSession, pending: str, folder: str) -> None:
    """Put complete tables in place of the old ones, so that a failed build leaves those.

    Readers see the old tables, none for a moment, or the new ones, never a mixture.
    """
    system, new = _file_system(spark, pending)
    _, place = _file_system(spark, folder.rstrip("/"))
    _, old = _file_system(spark, f"{folder.rstrip('/')}.old-{uuid.uuid4().hex}")
    replaced = system.exists(place) and system.rename(place, old)
    if not system.rename(new, place):
        raise OSError(f"{pending} could not be moved to {folder}")
    if replaced:
        system.delete(old, True)


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}
