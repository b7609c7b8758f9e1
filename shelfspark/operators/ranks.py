"""Running sums, minima and ranks over rows in order, spread over all partitions.

A window that orders all rows of a key in one task ends where a key holds much of a table. Here
rows are range-partitioned by key and order, summed within partitions, and what lies in other
partitions of a key is added: one number per key and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import written


def running(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    sums: list[str] = (),
    next_of: list[str] = (),
) -> DataFrame:
    """Rows with ``up_to_<name>`` for ``sums`` and ``next_<name>`` for ``next_of``, in the order of a key.

    The first is the sum of a column from the first row of the key to this one, nulls as
    zero; the second the least value of a column in all rows after this one (null if none).
    ``order`` must tell rows of a key apart, or their order is any; nulls come first. No keys
    make one order of all rows. Columns that begin with ``_part`` or these names are the helper's.
    """
    keys = list(keys)
    placed = rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    placed = written(placed, "placed")
    whole = placed.groupBy(*keys, "_part").agg(
        *[F.sum(name).alias(f"_sum_{name}") for name in sums],
        *[F.min(name).alias(f"_min_{name}") for name in next_of],
        F.lit(True).alias("_more"),
    )
    # A key is in few partitions, and all rows in as many as there are: a row each.
    group = keys or [F.lit(0)]
    parts = Window.partitionBy(*group).orderBy("_part")
    before, after = parts.rowsBetween(Window.unboundedPreceding, -1), parts.rowsBetween(1, Window.unboundedFollowing)
    others = whole.select(
        *keys,
        "_part",
        F.count("*").over(Window.partitionBy(*group)).alias("_parts"),
        *[F.sum(f"_sum_{name}").over(before).alias(f"_before_{name}") for name in sums],
        *[F.min(f"_min_{name}").over(after).alias(f"_after_{name}") for name in next_of],
    ).filter("_parts > 1")
    here = Window.partitionBy(*keys, "_part").orderBy(*order)
    up_to = here.rowsBetween(Window.unboundedPreceding, 0)
    beyond = here.rowsBetween(1, Window.unboundedFollowing)
    local = placed.select(
        "*",
        *[F.coalesce(F.sum(name).over(up_to), F.lit(0)).alias(f"_here_{name}") for name in sums],
        *[F.min(name).over(beyond).alias(f"_beyond_{name}") for name in next_of],
    )
    joined = local.join(others, [*keys, "_part"], "left")
    return joined.select(
        *rows.columns,
        *[(F.col(f"_here_{n}") + F.coalesce(f"_before_{n}", F.lit(0))).alias(f"up_to_{n}") for n in sums],
        *[_least(F.col(f"_beyond_{n}"), F.col(f"_after_{n}")).alias(f"next_{n}") for n in next_of],
    )


def _least(one: Column, other: Column) -> Column:
    """The lesser of two values that may be null, structs too."""
    return F.array_min(F.array(one, other))


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Rows with their place from one in the order of a key, or of all rows."""
    one = rows.withColumn("_one", F.lit(1).cast("long"))
    return running(one, keys, order, ["_one"]).withColumnRenamed("up_to__one", name).drop("_one")
