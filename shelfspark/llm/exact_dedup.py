"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed size. Sorting the blocks gives each
distinct one an integer name; adjacent names are then paired, distinct pairs are
named, and so on, until a text has one name. Two texts have the same name (of the
same level) exactly when they are identical: names stand for whole blocks or pairs,
not for hashes of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import free_name, in_parts, text_or_empty, without
from shelfspark.session import dropped, written

#: Characters in a block: most documents are one block, and a block is a small row.
BLOCK_CHARS = 4096
#: Bytes of distinct blocks that a task remembers, to send repeats within it once only.
REMEMBERED_BYTES = 32_000_000


def normalised(column: str = "text") -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(
        text_or_empty(column), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Equal texts are one group; of a group the row with the smallest id stays (null
    ids come last; of repeated ids any one row stays). Null text is empty text. Other
    columns of ``docs`` are not read, so their names cannot clash. An empty table gives
    no rows.
    """
    text = normalised(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
    ).withColumn("sha", F.sha2("text", 256))
    blocks = written(
        rows.mapInArrow(
            _cut(block_chars),
            "row long, pos int, n int, rep long, block string, doc_id long, sha string",
        ),
        "blocks",
    )
    # A repeated block comes from each task at most a few times, so no block is a hot key.
    same_block = Window.partitionBy("block")
    names = written(
        blocks.filter("block IS NOT NULL").select("rep", F.min("rep").over(same_block).alias("name")),
        "names",
    )
    named = written(
        blocks.select("row", "pos", "n", "rep", "doc_id", "sha").join(names, "rep").drop("rep"),
        "named",
    )
    dropped(blocks)
    dropped(names)
    facts = named.filter("pos = 0").select("row", "doc_id", "sha")
    found = [named.filter("n = 1").select("row", F.lit(0).alias("level"), "name")]
    level, longest = 0, named.agg(F.max("n")).first()[0] or 0
    current = named.filter("n > 1").select("row", "pos", "n", "name")
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        pairs = written(
            current.groupBy("row", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            ),
            "pairs",
        )
        names = written(
            pairs.select("left", "right")
            .distinct()
            .sortWithinPartitions("left", "right")
            .withColumn("name", F.monotonically_increasing_id()),
            "names",
        )
        current = written(
            pairs.join(names, ["left", "right"]).select(
                "row", "pos", F.expr("(n + 1) div 2").cast("int").alias("n"), "name"
            ),
            "named",
        )
        dropped(pairs)
        dropped(names)
        found.append(current.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        current = current.filter("n > 1")
    identities = found[0]
    for more in found[1:]:
        identities = identities.union(more)
    identities = written(identities.join(facts, "row"), "identities")
    dropped(named)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = written(
        identities.groupBy("level", "name").agg(
            F.count("*").alias("group_size"), first.alias("first")
        ),
        "groups",
    )
    return identities.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that share id and text are one document; one of them stays.
    """
    verdict = written(exact_groups(docs, id_col, text_col), "verdict")
    columns = docs.columns
    gone = verdict.filter("NOT kept AND (doc_id != keep_id OR (doc_id IS NULL AND keep_id IS NOT NULL))")
    twice = verdict.filter("NOT kept AND doc_id <=> keep_id")
    by = [F.col(id_col).cast("string"), F.sha2(normalised(text_col), 256)]
    key = free_name(docs, "row_key")
    marked = docs.withColumn(key, F.concat_ws(":", *by))
    of = F.concat_ws(":", F.col("doc_id").cast("string"), "text_sha256").alias(key)
    kept = without(marked, gone.select(of).distinct(), key)
    if not twice.isEmpty():
        repeated = written(twice.select(of).distinct(), "repeated")
        once = kept.join(repeated, key, "left_semi").dropDuplicates([key])
        kept = without(kept, repeated, key).unionByName(once)
    return kept.select(*columns)


def _cut(size: int):
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        seen: dict[str, int] = {}
        held = made = 0
        for batch in in_parts(batches):
            out: list[list] = [[] for _ in range(7)]
            for row, doc_id, text, sha in zip(*(column.to_pylist() for column in batch.columns)):
                n = max(1, -(-len(text) // size))
                for pos in range(n):
                    block = text[pos * size : (pos + 1) * size]
                    rep = seen.get(block)
                    first = rep is None
                    if first:
                        rep = base + made
                        made += 1
                        if held > REMEMBERED_BYTES:
                            seen.clear()
                            held = 0
                        seen[block] = rep
                        held += len(block) + 100
                    head = pos == 0
                    for column, value in zip(
                        out, (row, pos, n, rep, block if first else None, doc_id if head else None, sha if head else None)
                    ):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string())
            names = ("row", "pos", "n", "rep", "block", "doc_id", "sha")
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(out, kinds)], names=list(names)
            )

    return cut
