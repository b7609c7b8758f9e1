"""Token counts as rollups that signed deltas keep up to date.

A change of a document is an old count, a new count, or both: a delete, an insert or a
revision. A batch of changes is summed to one signed delta by source, language and
tokenizer version and committed under its batch id; committing an id again does
nothing. Totals are the sums of all committed deltas, so batches may come in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import in_parts, text_or_empty
from shelfspark.llm.tokens import encoder
from shelfspark.session import _file_system

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def token_counts(docs: DataFrame, tokenizers: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, source, lang`` and ``n_<k>``, the tokens by the k-th tokenizer, of every row.

    Null texts have no tokens; null sources and languages are groups of their own.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        text_or_empty(text_col).alias("text"),
    )
    counts = ", ".join(f"n_{k} long" for k in range(len(tokenizers)))
    return rows.mapInArrow(_count(tokenizers), f"doc_id long, source string, lang string, {counts}")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of ``changes``: the keys, ``old_tokens`` (null: an insert), ``new_tokens`` (null: a delete)."""
    there = F.col("new_tokens").isNotNull().cast("long") - F.col("old_tokens").isNotNull().cast("long")
    more = F.coalesce("new_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))
    return changes.groupBy(*KEYS).agg(F.sum(there).alias("n_docs"), F.sum(more).alias("n_tokens"))


def commit(changes: DataFrame, root: str, batch: str) -> bool:
    """Add a batch of changes to the rollup in folder ``root``; False if it was there already.

    The delta is written aside and moved into place when complete, so a failed write
    leaves nothing, and a repeated one is harmless. One writer at a time.
    """
    spark = changes.sparkSession
    system, place = _file_system(spark, f"{root}/batches/{batch}")
    if system.exists(place):
        return False
    aside = f"{root}/pending/{batch}"
    deltas(changes).write.mode("overwrite").parquet(aside)
    system.mkdirs(place.getParent())
    if not system.rename(_file_system(spark, aside)[1], place):
        raise OSError(f"batch {batch} could not be moved into place")
    return True


def totals(spark: SparkSession, root: str) -> DataFrame:
    """The keys, ``n_docs, n_tokens`` over all committed batches; keys without documents are left out."""
    system, place = _file_system(spark, f"{root}/batches")
    if not system.exists(place):
        return spark.createDataFrame([], DELTA)
    rows = spark.read.schema(DELTA).parquet(f"{root}/batches/*")
    sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.filter("n_docs != 0 OR n_tokens != 0")


def _count(tokenizers: list[str]):
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoders = [encoder(name) for name in tokenizers]
        for batch in in_parts(batches):
            texts = batch.column(3).to_pylist()
            columns = [pa.array([len(e.encode(text)) // 4 for text in texts], pa.int64()) for e in encoders]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *columns],
                names=["doc_id", "source", "lang", *[f"n_{k}" for k in range(len(encoders))]],
            )

    return count
