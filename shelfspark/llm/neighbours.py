"""Nearest neighbours by cosine, with a vantage-point tree per shard.

Rows are dealt to shards by a hash of their id; each shard builds a tree over its unit
vectors, where the cosine's order is that of the Euclidean distance. A search keeps the
distance of its k-th best so far and skips a side of a node when the triangle inequality
says that nothing in it is nearer. ``relax`` times the inequality's bound is compared, so
one is exact and more skips more. Blocks of queries meet every shard's tree; the best of
all shards are ranked last.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import written

NEAREST = 5
#: Rows of a shard, queries of a block, rows of a leaf.
SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 8192, 1024, 128
#: Smaller differences of distance are taken as rounding.
MARGIN = 1e-7


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` in double precision; vectors null, zero, or with null or non-finite parts left out.

    Rows without an id, too.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & some
    )


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = NEAREST,
    relax: float = 1.0,
    shard_rows: int = SHARD_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` nearest rows by cosine.

    Both tables have ``vec_id, v`` as ``valid_vectors`` gives them; vectors of another width
    than most rows have (the smaller of equally common ones) take no part, and of
    rows with one id the least vector does. A row is no neighbour of the query that has
    its id. Ties go to the smaller id, however many rows are equally near;
    a query with fewer candidates gets them all. Without rows or queries there are none.
    """
    rows = written(rows, "vectors")
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    same_width = F.size("v") == (widths.width if widths else 0)
    rows = rows.filter(same_width)
    queries = written(queries.filter(same_width), "queries")
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))

    def dealt(table: DataFrame, parts: int) -> DataFrame:
        return table.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))

    trees = written(
        dealt(rows, shards)
        .groupBy("part")
        .applyInPandas(_tree(k, leaf_rows), "part long, tree binary")
        .withColumnRenamed("part", "shard"),
        "trees",
    )
    asked = written(
        dealt(queries, blocks)
        .groupBy("part")
        .applyInPandas(_block, "part long, ids binary, vectors binary")
        .withColumnRenamed("part", "block"),
        "blocks",
    )
    # Each shard gets all blocks, a row each: a stream of blocks past one tree.
    sent = asked.withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )
    found = (
        sent.join(trees.hint("merge"), "shard")
        .select("tree", "ids", "vectors")
        .mapInArrow(_search(k, relax), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _unit(vectors):
    """Unit vectors; scaled first, so that very long and very short ones keep their digits."""
    import numpy as np

    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _one_of_each(rows):
    """Rows by id, of repeated ids the least vector."""
    rows = rows.sort_values("vec_id", kind="stable").reset_index(drop=True)
    if rows["vec_id"].is_unique:
        return rows
    vectors = rows["v"].map(tuple)
    order = sorted(rows.index, key=lambda at: (rows["vec_id"][at], vectors[at]))
    return rows.loc[order].drop_duplicates("vec_id")


def _tree(k: int, leaf_rows: int):
    def tree(shard):
        """The tree of a shard: equal vectors are one point, which keeps its first k + 1 ids.

        More of them can't be among the k nearest, the query itself being one.
        """
        import pickle

        import numpy as np
        import pandas as pd

        shard = _one_of_each(shard)
        vectors = np.array(shard["v"].tolist(), float)
        ids = shard["vec_id"].to_numpy(np.int64)
        points, member = np.unique(vectors, axis=0, return_inverse=True)
        order = np.argsort(member.ravel(), kind="stable")
        starts = np.searchsorted(member.ravel()[order], np.arange(len(points) + 1))
        groups = [ids[order[a : min(b, a + k + 1)]] for a, b in zip(starts, starts[1:])]
        unit = _unit(points)
        nodes: list[tuple] = []  # (vantage point, radius, inside, outside) or (members,)
        chance = np.random.default_rng(0)

        def build(members) -> int:
            at = len(nodes)
            nodes.append(())
            if len(members) <= leaf_rows:
                nodes[at] = (members,)
                return at
            vantage = members[chance.integers(len(members))]
            distance = np.sqrt(np.maximum(0, ((unit[members] - unit[vantage]) ** 2).sum(axis=1)))
            radius = float(np.median(distance))
            inside = distance <= radius
            if inside.all():  # many as far as the farthest
                inside = distance < radius
                if not inside.any():
                    nodes[at] = (members,)
                    return at
                radius = float(distance[inside].max())
            nodes[at] = (vantage, radius, build(members[inside]), build(members[~inside]))
            return at

        if len(points):
            build(np.arange(len(points)))
        data = pickle.dumps((points, unit, groups, nodes), protocol=5)
        return pd.DataFrame({"part": shard["part"].iloc[:1], "tree": [data]})

    return tree


def _block(block):
    import numpy as np
    import pandas as pd

    block = _one_of_each(block)
    vectors = np.array(block["v"].tolist(), float)
    return pd.DataFrame(
        {
            "part": block["part"].iloc[:1],
            "ids": [block["vec_id"].to_numpy(np.int64).tobytes()],
            "vectors": [vectors.tobytes()],
        }
    )


def _search(k: int, relax: float):
    def search(batches: Iterator) -> Iterator:
        import pickle

        import numpy as np
        import pyarrow as pa

        def searched(tree, ids, vectors):
            points, unit, groups, nodes = tree
            asked = _unit(vectors)
            first_id = np.fromiter((group[0] for group in groups), np.int64, len(groups))
            lengths = np.sqrt((points * points).sum(axis=1))
            asked_lengths = np.sqrt((vectors * vectors).sum(axis=1))
            # The least distances so far, k + 1 as the query's own point may be one of them; and the
            # points that are best by exact score and id, among all that may be as near.
            keep = k + 1
            best = np.full((len(ids), keep), np.inf)
            which = np.full((len(ids), keep), -1, np.int64)
            scores = np.full((len(ids), keep), -np.inf)

            def scored(queries, found):
                """Exactly the cosine of the vectors as given, summed alike for each."""
                with np.errstate(over="ignore", invalid="ignore"):
                    dots = (points[found] * vectors[queries]).sum(axis=1)
                    score = dots / (lengths[found] * asked_lengths[queries])
                odd = ~np.isfinite(score)
                if odd.any():  # too long or short for the plain formula
                    score[odd] = (unit[found[odd]] * asked[queries[odd]]).sum(axis=1)
                return score

            def visit(at: int, q) -> None:
                node = nodes[at]
                if len(node) == 1:
                    members = node[0]
                    near = np.sqrt(np.maximum(0.0, 2 - 2 * asked[q] @ unit[members].T))
                    best[q] = np.partition(np.concatenate([best[q], near], axis=1), keep - 1, axis=1)[:, :keep]
                    row, column = np.nonzero(near <= best[q].max(axis=1, keepdims=True) + MARGIN)
                    touched = np.unique(row)
                    held = np.repeat(touched, keep)
                    rows = np.concatenate([held, row])
                    found = np.concatenate([which[q[touched]].ravel(), members[column]])
                    score = np.concatenate([scores[q[touched]].ravel(), scored(q[row], members[column])])
                    order = np.lexsort((first_id[found], -score, rows))
                    rank = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
                    order = order[rank < keep]
                    which[q[touched]] = found[order].reshape(-1, keep)
                    scores[q[touched]] = score[order].reshape(-1, keep)
                    return
                vantage, radius, inside, outside = node
                distance = np.sqrt(np.maximum(0.0, 2 - 2 * asked[q] @ unit[vantage]))
                gap = distance - radius
                for first, second, some in ((inside, outside, gap <= 0), (outside, inside, gap > 0)):
                    if some.any():
                        own, far = q[some], np.abs(gap[some])
                        visit(first, own)
                        left = far * relax <= best[own].max(axis=1) + MARGIN
                        if left.any():
                            visit(second, own[left])

            visit(0, np.arange(len(ids)))
            out_q, out_v, out_s = [], [], []
            for i, own in enumerate(ids):
                found = which[i] >= 0
                pairs = zip(scores[i][found].tolist(), which[i][found].tolist())
                hits = [(-s, v) for s, p in pairs for v in groups[p].tolist() if v != own]
                for s, v in sorted(hits)[:k]:
                    out_q.append(int(own))
                    out_v.append(v)
                    out_s.append(-s)
            return pa.RecordBatch.from_arrays(
                [pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())],
                names=["query_id", "vec_id", "score"],
            )

        last, tree = None, None
        for batch in batches:
            for data, ids, vectors in zip(*(column.to_pylist() for column in batch.columns)):
                if data != last:
                    last, tree = data, pickle.loads(data)
                ids = np.frombuffer(ids, np.int64)
                if len(ids) and len(tree[0]):
                    yield searched(tree, ids, np.frombuffer(vectors).reshape(len(ids), -1))

    return search
