"""The first rows of ranges, without a question meeting the rows of its range.

Rows of a list stand by a value (a price) and are wanted by another order (a score). They are cut
into blocks of ``LEAF`` rows by value; ``FAN`` blocks make one of the next level, and so on. A block keeps
its first rows in the wanted order, so a range is read from few blocks: whole ones as
large as fit inside it, and the smallest ones at both its ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.ranks import running
from shelfspark.operators.skew import unsent
from shelfspark.session import written

LEAF = 64
FAN = 16
#: Order at equal values: a bound before the rows there, the rows, a bound after them.
BEFORE, ROWS, AFTER = 0, 1, 2


def range_tops(items: DataFrame, asks: DataFrame) -> DataFrame:
    """``ask_id, item``: rows of each asked range that hold its first ``n`` by ``item``.

    ``items`` has ``list_id, at, item``, where ``item`` is a struct that orders the rows of a list and
    tells them apart. ``asks`` has ``ask_id, list_id, low, high, open, n``: the range from ``low`` on, up to ``high``,
    which is left out if ``open``. Without ``low`` a range begins with all rows, those without a
    value first; without ``high`` it ends with all rows. An ask gets at most ``n`` rows of every block it reads,
    and reads no more than 32 of each level. Empty ranges give no rows.
    """
    asks = written(asks, "asks")
    bounds = asks.select(
        "list_id",
        "ask_id",
        F.inline(
            F.array(
                F.struct(F.col("low").alias("at"), F.lit(BEFORE).alias("side"), F.lit(True).alias("begins")),
                F.struct(
                    F.coalesce("high", F.lit(float("inf"))).alias("at"),
                    F.when(F.col("open"), BEFORE).otherwise(AFTER).alias("side"),
                    F.lit(False).alias("begins"),
                ),
            )
        ),
    ).withColumn("one", F.lit(0).cast("long"))
    rows = items.select("list_id", "at", "item", F.lit(ROWS).alias("side"), F.lit(1).cast("long").alias("one"))
    placed = written(
        running(
            rows.unionByName(bounds, allowMissingColumns=True), ["list_id"], ["at", "side", "item", "ask_id"], ["one"]
        ),
        "places",
    )
    most = asks.agg(F.max("n")).first()[0] or 0
    held = placed.filter(F.col("side") == ROWS).select(
        "list_id", (F.col("up_to_one") - 1).alias("pos"), "item"
    )
    last = held.agg(F.max("pos")).first()[0] or 0
    blocks = [
        written(
            held.groupBy("list_id", F.floor(F.col("pos") / LEAF).alias("node")).agg(
                F.array_sort(F.collect_list(F.struct("item", "pos"))).alias("items")
            ),
            "blocks",
        )
    ]
    size = LEAF
    while size * FAN <= last + 1:
        size *= FAN
        firsts = F.flatten(F.collect_list(F.slice("items", 1, most)))
        blocks.append(
            written(
                blocks[-1]
                .groupBy("list_id", F.floor(F.col("node") / FAN).alias("node"))
                .agg(F.slice(F.array_sort(firsts), 1, most).alias("items")),
                "blocks",
            )
        )
    levels = [block.withColumn("level", F.lit(level)) for level, block in enumerate(blocks)]

    def at(begins: bool) -> Column:
        return F.max(F.when(F.col("begins") == begins, F.col("up_to_one")))

    ranges = (
        placed.filter(F.col("side") != ROWS)
        .groupBy("ask_id")
        .agg(at(True).alias("begin"), at(False).alias("end"))
        .filter(F.col("begin") < F.col("end"))
        .join(unsent(asks.select("ask_id", "list_id", "n")), "ask_id")
    )
    inside = F.filter("items", lambda x: (x["pos"] >= F.col("begin")) & (x["pos"] < F.col("end")))
    return (
        ranges.select("*", F.inline(_cover(len(levels))))
        .join(unsent(reduce(DataFrame.unionByName, levels)), ["list_id", "level", "node"])
        .select("ask_id", F.explode(F.slice(inside, F.lit(1), F.col("n"))).alias("found"))
        .select("ask_id", F.col("found.item").alias("item"))
    )


def _cover(levels: int) -> Column:
    """The blocks, by level and number, that make up the positions from ``begin`` to before ``end``."""

    def numbers(start: Column, stop: Column) -> Column:
        return F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>"))

    def whole(level: int) -> tuple[Column, Column]:
        size = LEAF * FAN**level
        if level == 0:  # blocks at both ends count too, and are cut by position
            return F.floor(F.col("begin") / size), F.ceil(F.col("end") / size)
        return F.ceil(F.col("begin") / size), F.floor(F.col("end") / size)

    parts = []
    for level in range(levels):
        low, high = whole(level)
        left, right = high, high
        if level + 1 < levels:
            above, beyond = whole(level + 1)
            left = F.when(above < beyond, above * FAN).otherwise(high)
            right = F.when(above < beyond, beyond * FAN).otherwise(high)
        here = F.concat(numbers(low, F.least(high, left)), numbers(F.greatest(low, right), high))
        number = F.lit(level).alias("level")
        parts.append(F.transform(here, lambda node: F.struct(number, node.alias("node"))))
    return F.concat(*parts)
