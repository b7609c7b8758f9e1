"""Phrase collocations, counted in burstable tries.

Words are counted first. Then a task counts the phrases that begin at each place, up to three
words, in a trie over word ids: one hash container holds those of all first words until it
is large; then words with many phrases in it burst out into containers of their own, and these by
their second word. A phrase of three words stands for its first two and its first as well.
When a task holds too many, its largest subtrees leave whole, as sorted runs: word numbers in
columns, compressed, with the words themselves, a run per prefix partition. The runs of a
partition (first two words by hash) are merged; only phrases that are frequent come out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import in_parts, text_or_empty
from shelfspark.session import written

#: A container with more phrases bursts; a word with this share of them gets its own.
BURST, SHARE = 8192, 64
#: Phrases, and words, that a task holds before subtrees leave (all of them for words).
HELD, WORDS = 1_000_000, 1_000_000
#: Places of text counted at a time.
PLACES = 400_000
#: Places of text of a prefix partition, which is merged in memory.
MERGED = 2_000_000
#: Prefixes of two words that each are one in ``COMMON`` words or more (at most so many words) are
#: split into ``SLICES`` by the next word, as one such prefix may hold much of the text.
COMMON, SLICES = 1000, 8
#: The language of rows without one.
UNKNOWN = "und"
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Bits of a word number in a phrase; numbers of what ends a piece, and of nothing between two spaces.
BITS, END, NOTHING = 21, 0, 1
LOW = (1 << BITS) - 1


class Trie:
    """Hash containers of packed phrases: of all words, of burst words, of burst prefixes of two."""

    def __init__(self, burst: int = BURST) -> None:
        import numpy as np

        self.burst = burst
        self.boxes: list[Counter] = [Counter()]
        self.limits = [burst]
        #: Bits that tell the word by which a container bursts; none below second words.
        self.shifts: list[int | None] = [2 * BITS]
        self.words, self.word_boxes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.pair_boxes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def size(self) -> int:
        return sum(map(len, self.boxes))

    def _places(self, keys):
        """The container of each phrase."""
        import numpy as np

        boxes = np.zeros(len(keys), np.int64)
        for known, theirs, shift in ((self.words, self.word_boxes, 2 * BITS), (self.pairs, self.pair_boxes, BITS)):
            if len(known):
                prefix = keys >> shift
                at = np.minimum(np.searchsorted(known, prefix), len(known) - 1)
                boxes = np.where(known[at] == prefix, theirs[at], boxes)
        return boxes

    def add(self, keys, counts=None) -> None:
        import numpy as np

        boxes = self._places(keys)
        order = np.argsort(boxes, kind="stable")
        found, starts = np.unique(boxes[order], return_index=True)
        for box, part in zip(found.tolist(), np.split(order, starts[1:])):
            if counts is None:
                self.boxes[box].update(keys[part].tolist())
            else:
                self.boxes[box].update(dict(zip(keys[part].tolist(), counts[part].tolist())))
            if len(self.boxes[box]) > self.limits[box] and self.shifts[box] is not None:
                self._burst(box)

    def _burst(self, box: int) -> None:
        """Give the words that hold much of a full container their own."""
        import numpy as np

        keys, counts = arrays(self.boxes[box])
        shift = self.shifts[box]
        heads, sizes = np.unique(keys >> shift, return_counts=True)
        apart = heads[sizes * SHARE >= len(keys)]
        new = len(self.boxes) + np.arange(len(apart))
        deeper = BITS if shift == 2 * BITS else None
        for _ in apart:
            self.boxes.append(Counter())
            self.limits.append(self.burst)
            self.shifts.append(deeper)
        if shift == 2 * BITS:
            self.words, self.word_boxes = _merged(self.words, self.word_boxes, apart, new)
        else:
            self.pairs, self.pair_boxes = _merged(self.pairs, self.pair_boxes, apart, new)
        stays = ~np.isin(keys >> shift, apart)
        self.boxes[box] = Counter(dict(zip(keys[stays].tolist(), counts[stays].tolist())))
        self.limits[box] = max(self.burst, 2 * int(stays.sum()))
        self.add(keys[~stays], counts[~stays])

    def largest(self, enough: int) -> list[Counter]:
        """Containers taken out, largest first, until they hold enough phrases."""
        gone = []
        for box in sorted(range(len(self.boxes)), key=lambda box: -len(self.boxes[box])):
            if enough <= 0:
                break
            enough -= len(self.boxes[box])
            gone.append(self.boxes[box])
            self.boxes[box], self.limits[box] = Counter(), self.burst
        return gone


def _merged(known, boxes, more, theirs):
    import numpy as np

    known, boxes = np.append(known, more), np.append(boxes, theirs)
    order = np.argsort(known)
    return known[order], boxes[order]


def arrays(box: Counter):
    """Packed phrases and counts of a container."""
    import numpy as np

    return np.fromiter(box.keys(), np.int64, len(box)), np.fromiter(box.values(), np.int64, len(box))


def phrases_at(ids):
    """The packed phrase at every word of texts, given as word numbers with ends between pieces."""
    import numpy as np

    ids = ids[ids != NOTHING]
    second = np.append(ids[1:], [END] * min(1, len(ids)))
    third = np.append(second[1:], [END] * min(1, len(ids)))
    third = np.where(second == END, END, third)
    return ((ids << 2 * BITS) | (second << BITS) | third)[ids != END]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _numbers() -> _Numbers:
    return _Numbers({b"\n": END, b"": NOTHING})


def _table() -> bytes:
    """Lower case A-Z, a newline for what ends pieces, a space for tabs."""
    table = bytearray(range(256)).lower()
    for byte in PIECE_ENDS:
        table[byte] = 10
    table[9] = 32
    return bytes(table)


def _split(text: bytes, table: bytes) -> list[bytes]:
    """Words, newlines at the ends of pieces, and nothing where spaces meet."""
    return (text.translate(table) + b"\n").replace(b"\n", b" \n ").split(b" ")


def _texts(batches: Iterator) -> Iterator[list[tuple[str, bytes]]]:
    import pyarrow as pa

    for batch in in_parts(batches, 200):
        yield list(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()))


def _word_counts(most: int):
    """Words of a task by language, and under nothing the number of all."""

    def batches(counts: dict[str, Counter]) -> Iterator:
        import pyarrow as pa

        for lang, words in counts.items():
            total = sum(n for word, n in words.items() if word not in (b"", b"\n"))
            words.pop(b"\n", None)
            words[b""] = total
            names, numbers = list(words), list(words.values())
            for start in range(0, len(names), 50_000):
                part = slice(start, start + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(names[part]), pa.string()),
                        pa.array(names[part], pa.binary()).view(pa.string()),
                        pa.array(numbers[part], pa.int64()),
                    ],
                    names=["lang", "phrase", "f"],
                )

    def word_counts(rows: Iterator) -> Iterator:
        table, counts = _table(), {}
        for texts in _texts(rows):
            for lang, text in texts:
                counts.setdefault(lang, Counter()).update(_split(text, table))
            if sum(map(len, counts.values())) > most:
                yield from batches(counts)
                counts = {}
        yield from batches(counts)

    return word_counts


def _usual(lang: str, words: list[bytes], common: set[tuple[str, str]]):
    import numpy as np

    return np.fromiter(((lang, w.decode("utf-8", "replace")) in common for w in words), bool, len(words))


def _runs(common: set[tuple[str, str]], partitions: int, held: int, most_words: int):
    """From rows (lang, text) to runs (partition, lang, words, phrases)."""

    def run(lang: str, boxes: list[Counter], names: list[bytes]) -> Iterator:
        import numpy as np
        import pyarrow as pa

        keys, counts = (np.concatenate(parts) for parts in zip(*map(arrays, boxes)))
        columns = np.stack([keys >> 2 * BITS, (keys >> BITS) & LOW, keys & LOW])
        used, local = np.unique(columns, return_inverse=True)
        words = [names[at] for at in used.tolist()]
        local = local.reshape(columns.shape)
        hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        usual = _usual(lang, words, common)
        a, b, c = local
        piece = np.where(usual[a] & usual[b], hashes[c] % SLICES + 1, 0)
        mixed = (hashes[a] * 0x9E3779B1 + hashes[b]) * 0x85EBCA77 + piece * 0xC2B2AE3D
        part = ((mixed ^ (mixed >> 29)) & (1 << 60) - 1) % partitions
        order = np.lexsort((c, b, a, part))
        found, starts = np.unique(part[order], return_index=True)
        out = []
        for number, rows in zip(found.tolist(), np.split(order, starts[1:])):
            here, theirs = np.unique(local[:, rows], return_inverse=True)
            theirs = theirs.reshape(3, -1)
            own = b" ".join([words[at] if used[at] != END else b"" for at in here.tolist()])
            out.append((number, lang, own, pack(theirs, counts[rows])))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(column, kind)
                for column, kind in zip(zip(*out), (pa.int64(), pa.string(), pa.binary(), pa.binary()))
            ],
            names=["part", "lang", "words", "phrases"],
        )

    def runs(batches: Iterator) -> Iterator:
        import numpy as np

        table, numbers, tries, waiting = _table(), _numbers(), {}, {}

        def count(lang: str) -> None:
            ids, waiting[lang] = np.concatenate(waiting[lang]), []
            tries.setdefault(lang, Trie()).add(phrases_at(ids))

        for texts in _texts(batches):
            for lang, text in texts:
                parts = _split(text, table)
                ids = waiting.setdefault(lang, [])
                ids.append(np.fromiter(map(numbers.__getitem__, parts), np.int64, len(parts)))
                if sum(map(len, ids)) > PLACES if len(ids) % 100 == 0 else len(parts) > PLACES:
                    count(lang)
            full = len(numbers) > most_words
            if full:
                for lang in [lang for lang, ids in waiting.items() if ids]:
                    count(lang)
            size = sum(trie.size() for trie in tries.values())
            if full or size > held:
                names = list(numbers)
                for lang, trie in tries.items():
                    share = trie.size() if full else trie.size() - held * trie.size() // (2 * size)
                    if boxes := trie.largest(share):
                        yield from run(lang, boxes, names)
                if full:
                    numbers = _numbers()
        names = None
        for lang in [lang for lang, ids in waiting.items() if ids]:
            count(lang)
        names = list(numbers)
        for lang, trie in tries.items():
            if trie.size():
                yield from run(lang, trie.boxes, names)

    return runs


def pack(columns, counts) -> bytes:
    """Sorted columns of word numbers and counts, byte by byte, compressed."""
    import numpy as np
    import zstandard

    first, second, third = columns
    first = np.diff(first, prepend=0)
    planes = [c.astype("<u4").view("u1").reshape(-1, 4).T.tobytes() for c in (first, second, third)]
    planes.append(counts.astype("<u8").view("u1").reshape(-1, 8).T.tobytes())
    return zstandard.compress(b"".join(planes), 3)


def unpack(data: bytes):
    """What ``pack`` packed: three columns and counts."""
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), "u1").reshape(20, -1)
    columns = [np.ascontiguousarray(planes[4 * k : 4 * k + 4].T).view("<u4").ravel().astype(np.int64) for k in range(3)]
    counts = np.ascontiguousarray(planes[12:].T).view("<u8").ravel().astype(np.int64)
    return np.cumsum(columns[0]), columns[1], columns[2], counts


def _summed(keys, counts):
    """Distinct keys, the sums of their counts, and where each key went."""
    import numpy as np

    found, back = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, back, counts)
    return found, sums, back


def _frequent(common: set[tuple[str, str]], least: int):
    """From the runs of a task, partition by partition, to frequent phrases of two and three words."""

    def merged(lang: str, runs: list[tuple]) -> Iterator:
        import numpy as np
        import pyarrow as pa

        numbers = _Numbers({b"": END})
        parts = []
        for words, data in runs:
            to = np.fromiter(map(numbers.__getitem__, words.split(b" ")), np.int64)
            *columns, counts = unpack(data)
            parts.append([*(to[column] for column in columns), counts])
        a, b, c, counts = (np.concatenate(column) for column in zip(*parts))
        names = list(numbers)
        pairs, sums, back = _summed((a << 32) | b, counts)
        # Of two usual words only a slice may be here, so their count can be any.
        usual = _usual(lang, names, common)
        sliced = usual[pairs >> 32] & usual[pairs & 0xFFFFFFFF]
        chosen = ((sums >= least) | sliced) & (pairs & 0xFFFFFFFF != END)
        phrases = [names[p >> 32] + b" " + names[p & 0xFFFFFFFF] for p in pairs[chosen].tolist()]
        found = sums[chosen].tolist()
        threes, sums, _ = _summed((back << 32) | c, counts)
        chosen = (sums >= least) & (threes & 0xFFFFFFFF != END)
        for key in threes[chosen].tolist():
            pair = int(pairs[key >> 32])
            phrases.append(b" ".join((names[pair >> 32], names[pair & 0xFFFFFFFF], names[key & 0xFFFFFFFF])))
        found += sums[chosen].tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(phrases), pa.string()),
                pa.array(phrases, pa.binary()).view(pa.string()),
                pa.array(found, pa.int64()),
            ],
            names=["lang", "phrase", "f"],
        )

    def frequent(batches: Iterator) -> Iterator:
        now, held = None, []
        for batch in in_parts(batches, 100):
            for part, lang, *run in zip(*(column.to_pylist() for column in batch.columns)):
                if held and (part, lang) != now:
                    yield from merged(now[1], held)
                    held = []
                now = (part, lang)
                held.append(run)
        if held:
            yield from merged(now[1], held)

    return frequent


def phrase_counts(
    docs: DataFrame,
    least: int = 10,
    text_col: str = "text",
    lang_col: str = "lang",
    held: int = HELD,
    words: int = WORDS,
) -> DataFrame:
    """``lang, phrase, f``: how often each phrase of one to three words occurs within pieces.

    Phrases that occur ``least`` times or more, and under the empty phrase all words. Texts are
    lower-cased (A-Z), cut at ``. , ; : ! ?`` and line ends into pieces and these at spaces and
    tabs into words; phrases are joined by spaces. Null text is empty, a null language
    ``und``; other columns aren't read. Languages without words, and an empty table, give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(text_col).alias("text")
    )
    schema = "lang string, phrase string, f long"
    singles = written(
        rows.mapInArrow(_word_counts(words), schema)
        .groupBy("lang", "phrase")
        .agg(F.sum("f").alias("f"))
        .filter((F.col("f") >= least) | ((F.col("phrase") == "") & (F.col("f") > 0))),
        "words",
    )
    total = singles.filter("phrase = ''").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    # At most COMMON words, as each has that share of all.
    often = singles.filter((F.col("phrase") != "") & (F.col("f") * COMMON >= total)).collect()
    common = {(row.lang, row.phrase) for row in often}
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // MERGED)
    runs = rows.mapInArrow(
        _runs(common, partitions, held, words), "part long, lang string, words binary, phrases binary"
    )
    merged = runs.repartition("part").sortWithinPartitions("part", "lang").mapInArrow(_frequent(common, least), schema)
    longer = merged.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return singles.unionByName(longer)


def collocations(
    docs: DataFrame,
    least: int = 10,
    most: int = 2000,
    percent: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Each language's best phrases of two and three words: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is how often a phrase occurs (``least`` times or more), ``l`` and ``r`` its two
    parts, ``n`` all words of the language. The score is floor(1,000,000 a a / (l r)), of
    the lowest-scoring cut, the first of equal ones. A phrase is left out where a longer
    one that holds it occurs ``percent`` % as often or more. The best ``most`` are by score,
    then ``a``, then the phrase in byte order. Nulls, empty texts and tables as in ``phrase_counts``.
    """
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    counts = written(phrase_counts(docs, least, text_col, lang_col).withColumn("words", size), "phrases")
    found = counts.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def joined(*places: int) -> Column:
        return F.array_join(F.array(*[F.get("w", F.lit(place)) for place in places]), " ")

    def cut(k: int, left: Column, right: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))

    two = F.array(cut(1, joined(0), joined(1)))
    three = F.array(cut(1, joined(0), joined(1, 2)), cut(2, joined(0, 1), joined(2)))
    cuts = found.select("lang", "phrase", "a", F.inline(F.when(F.size("w") == 2, two).otherwise(three)))
    part = counts.filter("words BETWEEN 1 AND 2")
    scored = (
        cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .withColumn("score", _score())
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    )
    longer = (
        found.filter(F.size("w") == 3)
        .select("lang", "a", F.explode(F.array(joined(0, 1), joined(1, 2))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "best.*").withColumn("rank", F.row_number().over(order))
    total = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return (
        ranked.filter(F.col("rank") <= most)
        .join(total, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


def _score() -> Column:
    """Exact: products of counts of up to 15 digits have 38 digits."""
    a, left, right = (F.col(name).cast("decimal(15,0)") for name in ("a", "l", "r"))
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", a * a * million, left * right)
