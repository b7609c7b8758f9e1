"""Document fingerprints by I-Match over randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band: neither those
of very many documents nor those of hardly any. From it random subsets are taken, at several rates. A
document's distinct terms that are in a subset, sorted and hashed, are one part of its
fingerprint. Texts of which a part changed still agree in subsets that hold
none of the changed terms: in sparse subsets if they are long, in dense ones if they are short.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import in_parts, text_or_empty, worker_cache
from shelfspark.session import written

#: Terms in more than this share of all documents are left out, and those in less than the other.
MOST_SHARE, LEAST_SHARE = 0.1, 1e-4
#: So many terms of the lexicon are sent to all tasks at most (16 MB of hashes).
LEXICON = 2_000_000
#: A subset of rate r has a term with probability 2**-r; so many subsets of each rate.
RATES, SUBSETS = (1, 3, 5, 7, 9), 16
#: A rate tells of likeness if so many of its subsets hold a term of either document.
TELLING = 3
#: Terms that a task counts or remembers at a time.
REMEMBERED = 300_000
#: ASCII that is no letter or digit ends a term; all other characters are part of terms.
SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
COMPARED = (
    "part int, kind string, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, "
    "edited_fingerprint binary, near_edited double, near_next double, text string"
)


def terms(text: str) -> set[bytes]:
    """Distinct runs of letters, digits and other characters beyond ASCII, in lower case."""
    return set(text.lower().encode("utf-8", "replace").translate(SPACED).split())


def lexicon(
    docs: DataFrame,
    text_col: str = "text",
    least_share: float = LEAST_SHARE,
    most_share: float = MOST_SHARE,
    most_terms: int = LEXICON,
) -> bytes:
    """Sorted 64-bit hashes of the terms whose document frequency lies in the band.

    A term of the lexicon is in two documents at least, and in ``least_share`` to ``most_share``
    of all. There are then at most as many as the mean number of distinct terms
    of a document, divided by ``least_share``; if that is more than ``most_terms``,
    the band begins higher, so that what is sent to all tasks is bounded.
    """
    spark = docs.sparkSession
    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(_counted, "term string, df long")
    # The empty term stands for the documents themselves.
    counts = written(counted.groupBy("term").agg(F.sum("df").alias("df")), "terms")
    total = counts.filter("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    least, most = max(2.0, least_share * total), most_share * total
    band = counts.filter((F.col("term") != "") & F.col("df").between(least, most))
    if band.count() > most_terms:
        # Steps of a sixteenth of a power of two: some hundreds of rows at most.
        step = F.floor(16 * F.log2("df")).alias("step")
        kept = 0
        for row in sorted(band.groupBy(step).count().collect(), reverse=True):
            kept += row["count"]
            if kept > most_terms:
                band = band.filter(F.floor(16 * F.log2("df")) > row.step)
                break
    return _sorted_hashes(band.select(F.xxhash64("term").alias("hash")).toPandas()["hash"])


def _sorted_hashes(hashes) -> bytes:
    import numpy as np

    return np.unique(hashes.to_numpy("int64").view("uint64")).tobytes()


def fingerprinted(docs: DataFrame, words: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row: a hash of two bytes per subset, as one binary.

    A subset without a term of the document is zero. A text without any term of the lexicon
    has a hash of all its terms (of itself, if it has none) in all places. Null text is
    empty text; equal texts have equal fingerprints, repeated rows too. Only the two
    named columns are read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def batches(rows: Iterator) -> Iterator:
        import pyarrow as pa

        sign = _signer(shared)
        for batch in in_parts(rows):
            prints = [sign(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.binary())], names=["doc_id", "fingerprint"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, fingerprint binary")


def likeness(a: list[bytes], b: list[bytes]) -> list[float]:
    """How alike the fingerprints of two lists are, one by one, from 0 to 1.

    Per rate, the share of subsets in which they agree, of those where either has a term. The
    largest share counts, of rates with ``TELLING`` such subsets, or else of the rates
    with the most of them.
    """
    import numpy as np

    x, y = (np.frombuffer(b"".join(prints), "<u2").reshape(-1, len(RATES), SUBSETS) for prints in (a, b))
    some = (x != 0) | (y != 0)
    held = some.sum(axis=2)
    agreed = ((x == y) & some).sum(axis=2)
    telling = held >= np.minimum(TELLING, held.max(axis=1, keepdims=True))
    return np.where(telling, agreed / np.maximum(held, 1), 0).max(axis=1).tolist()


def compared_with_next(docs: DataFrame, words: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document beside its edited text and beside the next document.

    Documents are in order of id (nulls first, equal ids by a hash of the text; after the last
    comes the first). The edited text has the first ``n_chars / 4`` characters of the next
    document, or all it has, in place of its own last ones. Columns: ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint`` (binary), ``near_edited, near_next``. Nulls, empty
    tables and other columns as in ``fingerprinted``.

    Texts are range-partitioned by id and pass a task in order. The first and the last
    document of each partition, two texts a partition, are matched in a second step.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    compared = written(ordered.mapInArrow(_compared(shared), COMPARED), "compared")
    # One number per partition that has rows.
    parts = sorted(row.part for row in compared.filter("kind = 'head'").select("part").collect())
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    heads = compared.filter("kind = 'head'").select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    pairs = compared.filter("kind = 'tail'").join(following, "part").join(heads, "next")
    closed = pairs.select("doc_id", "text", "next_text").mapInArrow(_pairs(shared), COMPARED)
    return compared.filter("kind = 'row'").unionByName(closed).drop("part", "kind", "text")


def _counted(batches: Iterator) -> Iterator:
    """Document frequencies of the terms of a task, at most ``REMEMBERED`` (and those of a part) at a time."""
    import pyarrow as pa

    counts: Counter = Counter()

    def out():
        names, numbers = list(counts), list(counts.values())
        counts.clear()
        for start in range(0, len(names), 50_000):
            part = slice(start, start + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[part], pa.binary()).view(pa.string()), pa.array(numbers[part], pa.int64())],
                names=["term", "df"],
            )

    for batch in in_parts(batches):
        for text in batch.column(0).to_pylist():
            counts.update(terms(text))
        counts[b""] += batch.num_rows
        if len(counts) > REMEMBERED:
            yield from out()
    yield from out()


class _Hashes(dict):
    """XXH64 of terms, as ``xxhash64`` has it."""

    def __missing__(self, term: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[term] = number = xxhash.xxh64_intdigest(term, seed=42)
        return number


def _mixed(numbers):
    """Hashes with every bit dependent on all of them (the finaliser of SplitMix64)."""
    import numpy as np

    numbers = (numbers ^ (numbers >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    numbers = (numbers ^ (numbers >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return numbers ^ (numbers >> np.uint64(31))


def _members(known):
    """In which subsets each term of the lexicon is: a bit per subset, two bytes per rate."""
    import numpy as np

    n = len(RATES) * SUBSETS
    seeds = _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = np.zeros((len(known), len(RATES)), "<u2")
    for at, seed in enumerate(seeds):
        inside = _mixed(known ^ seed) >> np.uint64(64 - RATES[at // SUBSETS]) == 0
        bits[:, at // SUBSETS] |= inside.astype("<u2") << np.uint16(at % SUBSETS)
    return bits


def _signer(shared):
    """A function from texts to fingerprints."""
    import numpy as np
    import xxhash

    cache = worker_cache()
    hash_of = cache.setdefault("imatch_hashes", _Hashes())
    known = np.frombuffer(shared.value, np.uint64)
    if cache.get("imatch_known") != shared.value:
        cache["imatch_known"], cache["imatch_members"] = shared.value, _members(known)
    members = cache["imatch_members"]
    n = len(RATES) * SUBSETS
    digest = xxhash.xxh64_intdigest

    def sign(text: str) -> bytes:
        found = terms(text)
        hashes = np.fromiter(map(hash_of.__getitem__, found), np.uint64, len(found))
        hashes.sort()
        at = np.searchsorted(known, hashes)
        if len(known):
            at[at == len(known)] = 0
            at = at[known[at] == hashes]
        else:
            at = at[:0]
        if not len(at):
            whole = digest(hashes.tobytes() if found else text.encode("utf-8", "replace"))
            return np.full(n, whole % 0xFFFF + 1, "<u2").tobytes()
        bits = np.unpackbits(members[at].view("u1"), axis=1, bitorder="little")
        places = np.flatnonzero(np.ascontiguousarray(bits.T)) % len(at)
        data = known[at[places]].tobytes()
        ends = (8 * np.cumsum(bits.sum(axis=0, dtype=np.int64))).tolist()
        out = [digest(data[i:j]) % 0xFFFF + 1 if j > i else 0 for i, j in zip([0, *ends], ends)]
        return np.array(out, "<u2").tobytes()

    return sign


def _beside(rows: list[tuple], sign) -> list[list]:
    """From (id, text, fingerprint, next text, next fingerprint) to rows of the result."""
    import hashlib

    out = []
    for doc_id, text, print_, after, _ in rows:
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
        out.append([None, "row", doc_id, len(text), sha, print_, print_ if edited == text else sign(edited)])
    prints = [row[5] for row in out]
    near_edited = likeness(prints, [row[6] for row in out])
    near_next = likeness(prints, [row[4] for row in rows])
    return [[*row, *near, None] for row, *near in zip(out, near_edited, near_next)]


def _batch(rows: list[list]):
    import pyarrow as pa

    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
    kinds += [pa.float64(), pa.float64(), pa.string()]
    names = [column.split()[0] for column in COMPARED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _compared(shared):
    def compared(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        sign, part, last = _signer(shared), TaskContext.get().partitionId(), None
        for batch in in_parts(batches):
            rows = []
            for doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
                now = (doc_id, text, sign(text))
                if last is None:
                    yield _batch([[part, "head", doc_id, *[None] * 6, text]])
                else:
                    rows.append((*last, *now[1:]))
                last = now
            if rows:
                yield _batch(_beside(rows, sign))
        if last is not None:
            yield _batch([[part, "tail", last[0], *[None] * 6, last[1]]])

    return compared


def _pairs(shared):
    def pairs(batches: Iterator) -> Iterator:
        sign = _signer(shared)
        for batch in in_parts(batches, 50):
            columns = (column.to_pylist() for column in batch.columns)
            rows = [(i, text, sign(text), after, sign(after)) for i, text, after in zip(*columns)]
            if rows:
                yield _batch(_beside(rows, sign))

    return pairs
