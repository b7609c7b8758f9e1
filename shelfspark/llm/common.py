"""What several operators share: input columns, worker caches, row removal, components' sums."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many ids (16 MB of longs) are broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 2_000_000
#: Documents that a task has as Python objects at a time.
PART_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_name(rows: DataFrame, stem: str) -> str:
    """A column name that ``rows`` doesn't have, for a helper column."""
    taken = {name.lower() for name in rows.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_parts(batches: Iterator, rows: int = PART_ROWS) -> Iterator:
    """Arrow batches cut into smaller ones, as their values as Python objects take more memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, so that models load once in it."""
    name = "_shelfspark_worker_cache"
    return vars(sys.modules.setdefault(name, types.ModuleType(name)))


def bounded(ids: DataFrame) -> DataFrame:
    """Marked for broadcast where a count shows that it is small enough."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return F.broadcast(ids)
    return ids


def without(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``removed``, which has that column (a null key stays).

    Removed keys are counted first: a bounded number is broadcast, so rows are not
    shuffled; more of them meet the rows in a shuffled join.
    """
    return rows.join(bounded(removed.select(key)), key, "left_anti").select(*rows.columns)


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids``; broadcast or shuffled as in ``without``."""
    return rows.join(bounded(ids.select(key)), key, "left_semi").select(*rows.columns)
