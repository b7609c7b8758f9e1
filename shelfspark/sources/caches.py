"""Caches of precomputed texts: JSON objects from product id to an entry."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The text fields an entry of each cache holds, next to its hash.
TRANSLATION_FIELDS = ["name_es", "description_es"]
PITCH_FIELDS = ["pitch"]


def read_cache(
    spark: SparkSession, path: str, fields: list[str], one_entry_per_line: bool = False
) -> DataFrame:
    """``(product_id, hash, *fields)``, one row per id; a missing or unreadable cache is empty.

    Where an id comes more than once its last entry counts, by file name and place.

    A cache file is one JSON object, hence one record for Spark; spread a large
    cache over many files. With ``one_entry_per_line`` each line is a JSON record
    that carries its own ``product_id``, and files split freely.
    """
    entry = ", ".join(f"{name} string" for name in ["hash", *fields])
    schema = f"product_id string, {entry}"
    try:
        if one_entry_per_line:
            lines = spark.read.schema(schema).json(path).select("*", *_place())
            return _last_entries(lines.filter("product_id IS NOT NULL"), ["hash", *fields])
        text = spark.read.text(path, wholetext=True).select("value", *_place())
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    typed = entry.replace(" string", ": string")
    entries = F.from_json("value", f"map<string, struct<{typed}>>")
    found = (
        text.select("file", F.posexplode(F.map_entries(entries)).alias("place", "e"))
        .filter("e.value IS NOT NULL")
        .select("file", "place", F.col("e.key").alias("product_id"), "e.value.*")
    )
    return _last_entries(found, ["hash", *fields])


def _place() -> list[Column]:
    """Where a record stands: its file, and its order within it."""
    block = F.col("_metadata.file_block_start")
    within = F.struct(block.alias("block"), F.monotonically_increasing_id().alias("line"))
    return [F.col("_metadata.file_path").alias("file"), within.alias("place")]


def _last_entries(entries: DataFrame, fields: list[str]) -> DataFrame:
    last = F.max_by(F.struct(*fields), F.struct("file", "place"))
    return entries.groupBy("product_id").agg(last.alias("entry")).select("product_id", "entry.*")
