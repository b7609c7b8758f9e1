"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. Flipping
a bit changes one count by one, so the Manhattan distance of two such vectors is at
most the Hamming distance of the fingerprints: a lower bound. Points within Manhattan
distance 2 differ in at most two of six blocks of coordinates, so they share a unit
grid cell in one of the 15 projections to four blocks. Points of a cell are joined
under the bound, then verified on the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import bounded, free_name, in_parts, text_or_empty, without
from shelfspark.llm.components import components
from shelfspark.session import written

#: Words of a shingle, and bits that may differ.
WORDS, BITS = 3, 2
#: The 32 segments in six blocks of adjacent segments.
BLOCK_SEGMENTS = (5, 5, 5, 5, 6, 6)
#: Cells with more points are linked by shared neighbours instead of pairs.
PAIRED_CELL = 64
LOW_BITS = 0x5555555555555555


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: SimHash of lower-cased (A-Z) word shingles, repeats counted.

    A null or wordless text has fingerprint zero; a text of fewer words than a shingle
    has one, all its words.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    ).mapInArrow(_fingerprint, "doc_id long, fp long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``.

    Fingerprints within ``BITS`` bits are linked, links are followed, and a component's
    id is its smallest doc_id (null only where all its ids are null). Repeated rows and
    copies share a fingerprint and are not paired. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes.select("fp")))
    named = written(
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), "first_id"
        ),
        "named",
    )
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = written(named.join(smallest, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component those with its smallest id.

    Rows that share an id are told apart by their fingerprints; repeated rows stay together.
    Rows without an id stay, as nothing tells them apart.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    groups = written(near_groups(docs, id_col, text_col).withColumn("stays", stays), "near")
    by_id = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.bool_or("stays").alias("some"), F.bool_and("stays").alias("every")
    )
    by_id = written(by_id.filter("NOT every"), "gone")
    of_all = by_id.filter("NOT some").select(F.col("doc_id").alias(id_col))
    kept = without(docs, of_all, id_col)
    shared = by_id.filter("some").select(F.col("doc_id").alias("shared_id"))
    if shared.isEmpty():
        return kept
    shared = bounded(shared)
    same_id = F.col(id_col).cast("long") == F.col("shared_id")
    # Fingerprints once more, of the texts of these ids only.
    unsure = written(kept.join(shared, same_id, "left_semi"), "unsure")
    key, fp = free_name(docs, "text_key"), free_name(docs, "print")
    of_text = F.sha2(text_or_empty(text_col), 256)
    texts = unsure.select(of_text.alias("key"), text_or_empty(text_col).alias("text"))
    known = texts.dropDuplicates(["key"]).mapInArrow(_fingerprint, "key string, fp long").toDF(key, fp)
    gone = groups.filter("NOT stays").select(F.col("doc_id").alias("gone_id"), F.col("fp").alias("gone_fp"))
    gone = gone.join(shared, F.col("gone_id") == F.col("shared_id"), "left_semi").distinct()
    marked = unsure.withColumn(key, of_text).join(bounded(known), key)
    went = (F.col(fp) == F.col("gone_fp")) & (F.col(id_col).cast("long") == F.col("gone_id"))
    left = marked.join(bounded(written(gone, "gone_rows")), went, "left_anti").select(*docs.columns)
    return kept.join(shared, same_id, "left_anti").unionByName(left)


def embedded(fp: Column) -> Column:
    """The 32 segment counts (0, 1 or 2), two bits each, in one long."""
    low = F.lit(LOW_BITS)
    high = F.shiftrightunsigned(fp, 1)
    both = fp.bitwiseAND(high).bitwiseAND(low)
    one = fp.bitwiseXOR(high).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(one)


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two embedded fingerprints: a field of the XOR is 1 or 3 for one, 2 for two."""
    low = F.lit(LOW_BITS)
    odd = a.bitwiseXOR(b)
    two = F.shiftrightunsigned(odd, 1).bitwiseAND(F.bitwise_not(odd)).bitwiseAND(low)
    return F.bit_count(odd.bitwiseAND(low)) + 2 * F.bit_count(two)


def links(nodes: DataFrame, paired_cell: int = PAIRED_CELL) -> DataFrame:
    """Links ``a, b`` whose components are those of all fingerprints ``fp`` within two bits.

    Cells of up to ``paired_cell`` points give every pair that is close enough. In a
    larger cell each point emits the 65 values within one bit of it: two fingerprints
    are within two bits exactly when they share such a value, so linking each to the
    least that shares it joins the same points without pairing them.
    """
    places, at = [], 0
    for size in BLOCK_SEGMENTS:
        places.append(((1 << (2 * size)) - 1) << at)
        at += 2 * size
    masks = [sum(kept) for kept in combinations(places, len(places) - BITS)]
    point = embedded(F.col("fp"))
    cells = nodes.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).cast("tinyint").alias("grid"),
                        point.bitwiseAND(F.lit(_signed(mask))).alias("cell"),
                    )
                    for k, mask in enumerate(masks)
                ]
            )
        ).alias("c"),
    ).select("fp", "c.grid", "c.cell")
    shared = written(
        cells.groupBy("grid", "cell").agg(F.count("*").alias("points")).filter("points > 1"), "cells"
    )
    members = written(cells.join(shared, ["grid", "cell"]), "members")
    small = members.filter(F.col("points") <= paired_cell)
    a = small.select("grid", "cell", F.col("fp").alias("a"))
    b = small.select("grid", "cell", F.col("fp").alias("b"))
    pairs = (
        a.join(b, ["grid", "cell"])
        .filter(F.col("a") < F.col("b"))
        .filter(manhattan(embedded(F.col("a")), embedded(F.col("b"))) <= BITS)
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)
        .select("a", "b")
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << bit)) for bit in range(64)])
    balls = (
        members.filter(F.col("points") > paired_cell)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("near"))
    )
    balls = written(balls, "balls")
    least = written(
        balls.groupBy("near").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1"),
        "least",
    )
    shared_near = balls.join(least, "near").filter("fp != b").select(F.col("fp").alias("a"), "b")
    return pairs.union(shared_near)


def _fingerprint(batches: Iterator) -> Iterator:
    """The first column and, of the second, its fingerprint."""
    from itertools import repeat

    import numpy as np
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    part = 65_536
    for batch in in_parts(batches):
        prints = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = text.lower().split()
            if len(words) > WORDS:
                shingles = map(b" ".join, zip(*(words[k:] for k in range(WORDS))))
                n = len(words) - WORDS + 1
            else:
                shingles, n = iter([b" ".join(words)] if words else ()), min(1, len(words))
            hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
            counts = np.zeros(64, np.int64)
            for start in range(0, n, part):
                bits = np.unpackbits(
                    hashes[start : start + part].astype("<u8").view(np.uint8).reshape(-1, 8),
                    axis=1,
                    bitorder="little",
                )
                counts += bits.sum(axis=0, dtype=np.int64)
            chosen = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
            prints.append(int(chosen.view("<i8")[0]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints, pa.int64())], names=[batch.schema.names[0], "fp"]
        )
