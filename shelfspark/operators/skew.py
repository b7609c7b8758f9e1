"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import written

# A key with more rows than this is hot. Every hot key stands for that many rows
# of the large side, so there are at most rows / HOT_ROWS of them to broadcast.
HOT_ROWS = 1_000_000


#: Rows of a table that are sent to all tasks at most.
FEW_ROWS = 100_000


def unsent(table: DataFrame) -> DataFrame:
    """One side of a join that sends neither side to all tasks: both are sorted by the key.

    Spark sends a side if its files are small, and all of it passes the driver. Files of repeated ids and
    copied rows are 40 times smaller than the rows and more, so a small file may fill the driver.
    """
    return table.hint("merge")


def beside(table: DataFrame, n_rows: int | None = None, few_rows: int = FEW_ROWS) -> DataFrame:
    """A stored table of narrow rows as right side of joins: sent to all tasks if its rows are few, else ``unsent``.

    What is filtered or selected from it is sent or not like the table. ``n_rows`` is its count, if known.
    """
    n_rows = table.count() if n_rows is None else n_rows
    return F.broadcast(table) if n_rows <= few_rows else unsent(table)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows by a hash of ``by`` over as many tasks as a shuffle has, for costly work on each.

    A scan makes no more tasks than a table has row groups, or multi-line files.
    """
    n_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n_tasks, *by)


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread: Column,
    n_rows: str = "n_rows",
    hot_rows: int = HOT_ROWS,
    few_rows: int = FEW_ROWS,
) -> DataFrame:
    """Left join ``lookup`` (one row per key, with its row count) to ``rows``.

    The lookup is written first, so it is computed once and its hot keys are known
    before the join is planned. Rows of a hot key are spread by a hash of ``spread``,
    over twice as many salts as it has times ``hot_rows``; only the lookup rows of hot keys
    are repeated to meet them. Null keys match nothing and are spread by the hash alone.
    A lookup of more than ``few_rows`` is never sent to all tasks, nor are the rows it meets (``unsent``).
    ``n_rows`` is an upper bound of how many ``rows`` carry the key.
    """
    lookup = written(lookup, "lookup")
    is_hot = F.col(n_rows) > hot_rows
    n_salts = (2 * F.ceil(F.col(n_rows) / hot_rows)).cast("bigint")
    hot = lookup.filter(is_hot).select(key, n_salts.alias("_salts"))
    none = F.lit(0).cast("bigint")
    size = lookup.agg(F.count("*").alias("n"), F.max(n_rows).alias("most")).first()
    if (size.most or 0) <= hot_rows:
        salts = F.array(none)
        salt = F.when(F.col(key).isNull(), F.xxhash64(spread))
    else:
        rows = rows.join(F.broadcast(hot), key, "left")
        salts = F.when(is_hot, F.sequence(none, n_salts - 1)).otherwise(F.array(none))
        salt = F.when(F.col(key).isNull(), F.xxhash64(spread)).when(
            F.col("_salts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_salts"))
        )
    salted_rows = rows.withColumn("_salt", F.coalesce(salt, none))
    salted_lookup = lookup.withColumn("_salt", F.explode(salts)).drop(n_rows)
    if size.n > few_rows:
        salted_lookup = unsent(salted_lookup)
    return salted_rows.join(salted_lookup, [key, "_salt"], "left").drop(
        "_salt", "_salts"
    )
