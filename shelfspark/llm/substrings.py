"""Repeated passages: paragraphs, MinHash banding, exact Jaccard, components.

A document is taken apart twice: into its lines, and, regardless of lines, into pieces
that end at anchors, places whose five-word hash is the least of a window. A passage that is
set into different texts has the same anchors in each, so a passage of 50 words holds
at least one whole piece. Equal paragraphs (by a 128-bit hash of their words) are a
class. Classes of lines are banded by MinHash, classes that share a band are compared by
exact Jaccard of their five-word shingles, and components of what is similar are
clusters. In a cluster the first paragraph stays, the others are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import BROADCAST_IDS, text_or_empty
from shelfspark.llm.components import components
from shelfspark.session import dropped, written

SHINGLE, SIMILARITY = 5, 0.8
#: Shingles in a window of anchors. Of 50 repeated words the first and last anchor are 16 apart or more.
ANCHOR_WINDOW = 15
#: Lines of fewer words are in pieces only; repeats of fewer words in a row are left alone.
LINE_WORDS, REPEAT_WORDS = 20, 16
#: At least this share of pairs at the similarity shares a band, with so many bands at most.
RECALL, MOST_BANDS = 0.995, 8
#: Texts, or sets of shingles, are Python's together until they have so many bytes.
TEXT_BYTES = 1 << 18
#: Classes compared in one go; larger bands are compared block by block.
BLOCK = 64


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """Bands and rows: the most rows for which at most ``most`` bands reach the recall."""
    import math

    best = (most, 1)
    for rows in range(1, 33):
        missed = 1 - similarity**rows
        bands = math.ceil(math.log(1 - recall) / math.log(missed))
        if bands <= most:
            best = (bands, rows)
    return best


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of at least ``LINE_WORDS`` words and pieces of every row.

    ``row, doc_id, text_key, start, stop`` (characters), ``first, last`` (words, the last
    exclusive), ``h1, h2`` (hash of the lower-case words) and ``bands`` (null for pieces).
    """
    return _texts(docs, id_col, text_col).mapInArrow(
        _taken_apart(*bands_for()),
        "row long, doc_id long, text_key long, start int, stop int, first int, last int, h1 long, h2 long, bands array<long>",
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, text_key``; the key finds a text again, also among rows without an id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.withColumn("text_key", F.xxhash64("doc_id", "text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs of clusters: ``doc_id, start, stop, words, cluster, keep_doc_id, size, removed``.

    A row for each paragraph that is in a cluster of several and lies in a stretch of at
    least ``REPEAT_WORDS`` words of such. ``keep_doc_id`` is the document of the first one,
    by id (null last) and place; the others are ``removed``, where they make up so many
    words of their stretch (else a short piece that occurs elsewhere would be cut from
    the first copy of a passage). Null and empty texts have no paragraphs. Rows that repeat
    an id are documents of their own.
    """
    units = _kept(paragraphs(docs, id_col, text_col))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "start", "stop")
    classes = written(
        units.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min(place).alias("head"), F.first("bands", True).alias("bands"))
        .filter("n > 1 OR bands IS NOT NULL")
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    links = _links(docs, units, classes, id_col, text_col)
    roots = written(components(links).select(F.col("node").alias("id"), F.col("root").alias("cluster")), "roots")
    dropped(links)
    clustered = classes.select("id", "h1", "h2", "n", "head").join(roots, "id", "left")
    clustered = written(clustered.withColumn("cluster", F.coalesce("cluster", "id")), "clustered")
    dropped(classes)
    dropped(roots)
    clusters = clustered.groupBy("cluster").agg(F.sum("n").alias("size"), F.min("head").alias("head"))
    of_class = written(
        clustered.select("h1", "h2", "cluster").join(clusters.filter("size > 1"), "cluster"), "repeated"
    )
    dropped(clustered)
    found = units.withColumn("line", F.col("bands").isNotNull()).drop("bands", "text_key")
    found = found.join(of_class, ["h1", "h2"])
    words = F.col("last") - F.col("first")
    found = found.withColumn("later", F.when(place != F.col("head"), words).otherwise(0))
    # Stretches of words covered without a gap.
    in_order = Window.partitionBy("row").orderBy("first", F.col("last").desc())
    reached = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("opens", (F.coalesce(reached, F.lit(-1)) < F.col("first")).cast("int"))
    found = found.withColumn("stretch", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("row", "stretch")
    found = found.withColumn("covered", F.max("last").over(whole) - F.min("first").over(whole))
    lines = F.max(F.when(F.col("line"), F.col("later")).otherwise(0)).over(whole)
    pieces = F.sum(F.when(F.col("line"), 0).otherwise(F.col("later"))).over(whole)
    found = found.withColumn("repeated", F.greatest(lines, pieces))
    return found.filter(F.col("covered") >= REPEAT_WORDS).select(
        "doc_id",
        "start",
        "stop",
        words.alias("words"),
        "cluster",
        F.col("head.doc_id").alias("keep_doc_id"),
        "size",
        ((F.col("later") > 0) & (F.col("repeated") >= REPEAT_WORDS)).alias("removed"),
    )


def without_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed paragraphs of ``repeats`` cut from their texts.

    Ids must be unique; rows without one are returned as they are.
    """
    cuts = found.filter("removed AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(id_col)).agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("_cuts")
    )
    columns = docs.columns
    joined = docs.join(cuts, id_col, "left")
    cut = F.pandas_udf(_cut_out, "string")(F.col(text_col), F.to_json("_cuts"))
    text = F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(cut)
    return joined.withColumn(text_col, text).select(*columns)


def _kept(units: DataFrame) -> DataFrame:
    """Lines, and pieces that may occur again: by half of their hash, which is a long, they do.

    Most pieces occur once; they are counted in narrow rows and go no further. Only lines
    keep ``text_key``, as only their texts are read again.
    """
    units = units.withColumn("text_key", F.when(F.col("bands").isNotNull(), F.col("text_key")))
    units = written(units, "paragraphs")
    again = written(units.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "n"), "again")
    kept = written(units.join(again, "h1", "left").filter("n > 1 OR bands IS NOT NULL").drop("n"), "kept")
    dropped(units)
    dropped(again)
    return kept


def _links(docs: DataFrame, units: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links ``a, b`` of similar classes of lines, written; enough to join all that are."""
    banded = classes.filter("bands IS NOT NULL").select("id", F.explode("bands").alias("band"))
    shared = written(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = written(banded.join(shared, "band"), "members")
    wanted = (
        members.select("id")
        .distinct()
        .join(classes, "id")
        .select("id", "head.row", "head.start", "head.stop", "h1", "h2")
        .join(units.filter("bands IS NOT NULL").select("row", "start", "stop", "text_key"), ["row", "start", "stop"])
        .groupBy("text_key")
        .agg(F.collect_list(F.struct("id", "start", "stop", "h1", "h2")).alias("_wanted"))
    )
    wanted = written(wanted, "wanted")
    few = wanted.limit(BROADCAST_IDS // 16 + 1).count() <= BROADCAST_IDS // 16
    texts = _texts(docs, id_col, text_col).join(F.broadcast(wanted) if few else wanted, "text_key")
    texts = texts.select("text", "_wanted")
    sets = written(
        texts.mapInArrow(_shingle_sets, "id long, shingles array<long>").dropDuplicates(["id"]), "sets"
    )
    # A band of many classes is cut into blocks, and each pair of blocks is compared apart.
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.struct(F.least(F.col("own"), other).alias("i"), F.greatest(F.col("own"), other).alias("j")),
    )
    dealt = (
        members.withColumn("blocks", blocks)
        .withColumn("own", own)
        .select("id", "band", "own", F.explode(pairs).alias("p"))
        .select("id", "band", "own", "p.i", "p.j")
        .join(sets, "id")
    )
    links = (
        dealt.repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j", "id")
        .mapInArrow(_compared, "a long, b long")
        .distinct()
    )
    links = written(links, "links")
    for done in (shared, members, wanted, sets):
        dropped(done)
    return links


def _word_bounds(data: bytes):
    """Starts and ends in bytes of the words of UTF-8 text."""
    import numpy as np

    chars = np.frombuffer(data, np.uint8)
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    return chars, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _shingles(words: list[bytes]):
    """Hashes of the shingles of a text of lower-case words; of all its words, if they are fewer."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1) if len(words) else 0
    mixed = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        mixed = (mixed + hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _shingles_of(words: list[bytes], bounds):
    """Shingles of texts one after the other, by the word that they begin with.

    ``bounds``: the first word of each text, and the number of words. The last words of a
    text begin none; their values mean nothing.
    """
    import numpy as np
    from xxhash import xxh3_64_intdigest

    n = len(words)
    hashes = np.zeros(n + SHINGLE, np.uint64)
    hashes[:n] = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    mixed = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        mixed += hashes[k : k + n]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    short = np.flatnonzero(np.diff(bounds) < SHINGLE)
    for first, last in zip(bounds[short].tolist(), bounds[short + 1].tolist()):
        if first < last:
            mixed[first] = _shingles(words[first:last])[0]
    return mixed


def _least_places(values, window: int):
    """The place of the least value, of equal ones the first, in each window of ``values``."""
    import numpy as np

    least, at, width = values, np.arange(len(values)), 1
    while width < window:
        step = min(width, window - width)
        later = least[step:] < least[:-step]
        at = np.where(later, at[step:], at[:-step])
        least = values[at]
        width += step
    return at


def _anchors(shingles, bounds):
    """Places that are the least of some window of a text; in a run of equal ones a window apart."""
    import numpy as np

    if len(shingles) < ANCHOR_WINDOW:
        return np.zeros(0, np.int64)
    least = _least_places(shingles, ANCHOR_WINDOW)
    # A window lies in a text if its last shingle does.
    texts = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.arange(len(least)) + (ANCHOR_WINDOW + SHINGLE - 1) <= bounds[1:][texts[: len(least)]]
    chosen = np.zeros(len(shingles), bool)
    chosen[least[inside]] = True
    at = np.flatnonzero(chosen)
    same = (shingles[at[1:]] == shingles[at[:-1]]) & (texts[at[1:]] == texts[at[:-1]])
    kept, last = np.ones(len(at), bool), 0
    for k in (np.flatnonzero(same) + 1).tolist():
        if kept[k - 1]:
            last = at[k - 1]
        kept[k] = at[k] - last >= ANCHOR_WINDOW
    return at[kept]


def _taken_apart(bands: int, rows: int):
    def taken_apart(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        from xxhash import xxh3_128_digest

        chance = np.random.default_rng(5)
        factors = chance.integers(1, 1 << 63, bands * rows, np.int64).astype(np.uint64) | np.uint64(1)
        terms = chance.integers(0, 1 << 63, bands * rows, np.int64).astype(np.uint64)
        row = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "text_key", "start", "stop", "first", "last", "h1", "h2", "bands"]

        def of_texts(texts: list[bytes]):
            """Units of texts one after the other: first all pieces, then all lines."""
            data = b" ".join(texts)
            chars, starts, ends = _word_bounds(data)
            words = data.lower().split()
            text_starts = np.cumsum([0, *(len(text) + 1 for text in texts)])
            bounds = np.searchsorted(starts, text_starts)
            opens = np.zeros(len(words) + 1, bool)
            opens[bounds] = True
            shingles = _shingles_of(words, bounds)
            line = np.cumsum(chars == 10)[starts]
            line_first = np.flatnonzero(opens[:-1] | np.r_[True, line[1:] != line[:-1]])
            line_last = np.r_[line_first[1:], len(words)]
            long = line_last - line_first >= LINE_WORDS
            line_first, line_last = line_first[long], line_last[long]
            opens[_anchors(shingles, bounds)] = True
            cuts = np.flatnonzero(opens)
            first = np.r_[cuts[:-1], line_first]
            last = np.r_[cuts[1:], line_last]
            spaced = b" ".join(words)
            at = np.r_[0, np.cumsum(ends - starts + 1)]
            digests = b"".join(
                xxh3_128_digest(spaced[a:b]) for a, b in zip(at[first].tolist(), (at[last] - 1).tolist())
            )
            keys = np.zeros((len(line_first), bands), np.int64)
            if len(line_first):
                # The shingles of a line are those that end in it.
                edges = np.c_[line_first, line_last - SHINGLE + 1].ravel()
                for b in range(bands):
                    key = np.full(len(line_first), b, np.uint64)
                    for r in range(b * rows, (b + 1) * rows):
                        mixed = shingles * factors[r]
                        mixed += terms[r]
                        mixed ^= mixed >> np.uint64(32)
                        lowest = np.minimum.reduceat(mixed, edges)[::2]
                        key = (key + lowest) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(31)
                    keys[:, b] = key.view(np.int64)
            of = np.searchsorted(bounds, first, "right") - 1
            place = np.r_[0, np.cumsum((chars & 0xC0) != 0x80)]
            before = place[text_starts[of]]
            hashes = np.frombuffer(digests, "<i8").reshape(-1, 2)
            places = place[starts[first]] - before, place[ends[last - 1]] - before
            return of, *places, first - bounds[of], last - bounds[of], hashes[:, 0], hashes[:, 1], keys

        for batch in batches:
            for part in _of_bytes(batch, pc.binary_length(batch.column(1)), TEXT_BYTES):
                texts = [text.encode("utf-8", "replace") for text in part.column(1).to_pylist()]
                got = of_texts(texts) if any(map(bytes.strip, texts)) else None
                if got is not None:
                    of, start, stop, first, last, h1, h2, keys = got
                    has = np.arange(len(of)) >= len(of) - len(keys)
                    offsets = pa.array(np.r_[0, np.cumsum(has * bands)].astype(np.int32))
                    of_text = pa.array(of)
                    arrays = [
                        pa.array(row + of),
                        part.column(0).take(of_text),
                        part.column(2).take(of_text),
                        *(pa.array(values, pa.int32()) for values in (start, stop, first, last)),
                        pa.array(h1, pa.int64()),
                        pa.array(h2, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()), mask=pa.array(~has)),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                row += part.num_rows

    return taken_apart


def _of_bytes(batch, sizes, most: int) -> Iterator:
    """Slices of an Arrow batch of ``most`` bytes each, or of one longer row; ``sizes``: the bytes of each row."""
    import numpy as np

    ends = np.cumsum(sizes.to_numpy(False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _shingle_sets(batches: Iterator) -> Iterator:
    """Distinct shingles of the wanted paragraphs of each text, checked by their hash."""
    import struct

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from xxhash import xxh3_128_digest

    for batch in batches:
        for part in _of_bytes(batch, pc.binary_length(batch.column(0)), TEXT_BYTES):
            ids, sets = [], []
            for text, wanted in zip(*(c.to_pylist() for c in part.columns)):
                for w in wanted:
                    words = text[w["start"] : w["stop"]].encode("utf-8", "replace").lower().split()
                    if struct.unpack("<2q", xxh3_128_digest(b" ".join(words))) == (w["h1"], w["h2"]):
                        ids.append(w["id"])
                        sets.append(np.unique(_shingles(words)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
            )


def _compared(batches: Iterator) -> Iterator:
    """Links of each group of rows ``id, band, own, i, j, shingles`` that come one after the other.

    The shingles of a row are distinct and ascending as unsigned numbers; they stay arrays,
    as sets of Python's numbers take ten times the memory.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def common(x, y) -> int:
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        return int(np.count_nonzero(y[at] == x))

    def links(group: list, i: int, j: int) -> list[tuple[int, int]]:
        parent = list(range(len(group)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        out = []
        for y in range(len(group)):
            id_y, own_y, set_y = group[y]
            for x in range(y):
                id_x, own_x, set_x = group[x]
                if (own_x == own_y and i != j) or root(x) == root(y):
                    continue
                small, large = sorted((len(set_x), len(set_y)))
                if small < SIMILARITY * large:
                    continue
                both = common(set_x, set_y)
                if both >= SIMILARITY * (small + large - both):
                    parent[root(y)] = root(x)
                    out.append((id_x, id_y))
        return out

    key, group = None, []
    for batch in batches:
        for part in _of_bytes(batch, pc.multiply(pc.list_value_length(batch.column(5)), 8), TEXT_BYTES):
            out: list[tuple[int, int]] = []
            *columns, sets = part.columns
            for id_, band, own, i, j, shingles in zip(*(c.to_pylist() for c in columns), sets):
                if (band, i, j) != key:
                    if len(group) > 1:
                        out += links(group, key[1], key[2])
                    key, group = (band, i, j), []
                # A copy, as a view would keep the whole batch.
                group.append((id_, own, shingles.values.to_numpy().view(np.uint64).copy()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
    out = links(group, key[1], key[2]) if len(group) > 1 else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])


def _cut_out(texts, cuts):
    import json

    import pandas as pd

    out = []
    for text, own in zip(texts, cuts):
        if text is None or own is None:
            out.append(text)
            continue
        kept, at = [], 0
        for cut in json.loads(own):
            if cut["start"] > at:
                kept.append(text[at : cut["start"]])
            at = max(at, cut["stop"])
        out.append("".join([*kept, text[at:]]))
    return pd.Series(out, dtype=object)
