"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents and gaps are sorted by size. As sizes are at most the sequence length, the
sorted lists are runs of equal sizes, at most one per length, however large the corpus
is. A sweep from large to small sizes matches each document with its successor, the
smallest gap that holds it and that no larger document has taken; where documents of one
size meet gaps of one size, the n-th takes the n-th. Gaps are updated, and sweeps repeat
until all documents have a place. Spark ranks the documents within their size over all
partitions and joins each to the stretch of ranks it belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import in_parts, text_or_empty
from shelfspark.llm.tokens import END_ID, encoder
from shelfspark.session import written

SEQUENCE_TOKENS = 1024


def pieces(
    docs: DataFrame,
    limit: int = SEQUENCE_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, part, nth``, one row per piece.

    A document is its ids and the end id. One longer than ``limit`` is cut into pieces
    of that length, the first one taking what is left over. ``nth`` numbers the
    pieces of a length within the task ``part``. Null text is empty: a piece with
    only the end id. ``ids`` are little-endian unsigned 32-bit integers, null if not wanted.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    ).mapInArrow(
        _pieces(limit, with_ids),
        "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long",
    )


def packed(
    docs: DataFrame, limit: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Where each piece lies: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Repeated rows are packed as often as they come. An empty table gives no rows.
    """
    rows = written(pieces(docs, limit, id_col, text_col, False).drop("ids"), "pieces")
    return placed(rows, limit).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def placed(rows: DataFrame, limit: int = SEQUENCE_TOKENS) -> DataFrame:
    """Adds ``sequence_id, offset`` to written rows with ``length, part, nth``."""
    runs = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(
        runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "runs"
    )
    # At most ``limit`` rows, one per length.
    sizes = {r.length: r.n for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    stretches = _stretches(rows.sparkSession, best_fit(sizes, limit))
    ranked = rows.join(runs.select("length", "part", "before"), ["length", "part"]).withColumn(
        "rank", F.col("before") + F.col("nth")
    )
    return (
        ranked.join(F.broadcast(stretches), "length")
        .filter("rank >= first AND rank < last")
        .withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first"))
    )


def _stretches(spark: SparkSession, plan: list[tuple]) -> DataFrame:
    return spark.createDataFrame(
        plan, "length long, first long, last long, sequence long, offset long"
    )


def best_fit(sizes: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Stretches ``(length, first, last, sequence, offset)`` for counts of documents by length.

    Documents of that length ranked ``first`` to ``last`` (exclusive) go to sequences
    numbered from ``sequence`` on, at ``offset``. Its input and work depend on the
    number of lengths, not of documents.
    """
    waiting = dict(sizes)
    taken = dict.fromkeys(sizes, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: stretches of sequences (first, last)
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def place(size: int, gap: int, first: int, n: int, later: dict) -> None:
        plan.append((size, taken[size], taken[size] + n, first, limit - gap))
        taken[size] += n
        waiting[size] -= n
        if gap > size:
            later.setdefault(gap - size, []).append((first, first + n))

    while any(waiting.values()):
        # Sweep: gaps are stacked as sizes fall, so the top is the successor of the next size.
        later: dict[int, list[tuple[int, int]]] = {}
        stack: list[tuple[int, tuple[int, int]]] = []
        largest_left = 0
        for size in range(limit, 0, -1):
            stack.extend((size, stretch) for stretch in gaps.pop(size, ()))
            while waiting.get(size) and stack:
                gap, (first, last) = stack.pop()
                n = min(waiting[size], last - first)
                place(size, gap, first, n, later)
                if first + n < last:
                    stack.append((gap, (first + n, last)))
            if waiting.get(size):
                # No gap holds it; smaller sizes wait until this one has its place.
                largest_left = size
                break
        for gap, stretch in stack:
            later.setdefault(gap, []).append(stretch)
        for gap, stretches in later.items():
            gaps.setdefault(gap, []).extend(stretches)
        if largest_left and not any(gap >= largest_left for gap in gaps):
            # As many new sequences as these documents fill, each with one of them now.
            n = -(-waiting[largest_left] // (limit // largest_left))
            place(largest_left, limit, opened, n, gaps)
            opened += n
    return plan


def _pieces(limit: int, with_ids: bool):
    def cut(batches: Iterator) -> Iterator:
        import zlib
        from array import array

        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder().encode
        end = array("I", [END_ID]).tobytes()
        seen = [0] * (limit + 1)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"]
        for batch in in_parts(batches):
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
                ids = encode(text) + end
                n = len(ids) // 4
                start, piece, stop = 0, 0, n % limit or limit
                while start < n:
                    own = ids[4 * start : 4 * stop]
                    size = stop - start
                    row = (doc_id, piece, start, size, zlib.crc32(own), own if with_ids else None, part, seen[size])
                    for column, value in zip(out, row):
                        column.append(value)
                    seen[size] += 1
                    start, stop, piece = stop, stop + limit, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(out, kinds)], names=names
            )

    return cut
