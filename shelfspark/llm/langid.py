"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is parsed from
left to right into phrases, each the longest match with the language's text from
where the last one ended; the walk through the automaton gives all match lengths in one
pass. Fewer phrases, each costing the logarithm of the training length, mean a smaller
cross entropy, and the language with the smallest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import among, text_or_empty, worker_cache
from shelfspark.session import written

#: The bounded sample that a language is learnt from: documents, and characters of each, in segments
#: all over its text. 48,000 characters a language, as every worker holds a table of steps that grows with them.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SEGMENTS = 120, 400, 4
#: Symbols of a window. Windows are parsed side by side; a phrase ends with its window.
WINDOW = 2048
#: Characters parsed at a time.
AT_A_TIME = 2_000_000
UNDETERMINED = "und"
#: Marks a step at which a phrase begins.
BEGINS = 1 << 30


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def learnt(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> list[tuple[str, int, bytes]]:
    """Automata of the languages in ``labelled``: name, training length, its edges.

    Rows without text or language teach nothing. Each language is learnt from
    ``SAMPLE_DOCS`` documents, those with the smallest hash of their id: from each
    ``SAMPLE_CHARS`` characters, a segment at a hashed place in each of as many equal parts
    of its text as there are segments; shorter texts are taken whole.
    """
    rows = labelled.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
    ).filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = rows.select("doc_id", "lang").withColumn("rank", F.row_number().over(by_hash))
    chosen = written(ranked.filter(F.col("rank") <= SAMPLE_DOCS).select("doc_id"), "sample")
    sample = among(rows, chosen, "doc_id").select(
        "lang", "doc_id", _segments(F.col("text")).alias("text")
    )
    automata = sample.groupBy("lang").applyInPandas(_automaton, "lang string, length long, edges binary")
    # A row per language, of a size that the sample bounds.
    return sorted((r.lang, r.length, bytes(r.edges)) for r in automata.collect() if r.length)


def _segments(text: Column) -> Column:
    """``SAMPLE_CHARS`` characters from all over a longer text, by a hash of ``doc_id``."""
    size = SAMPLE_CHARS // SAMPLE_SEGMENTS
    part = F.floor(F.length(text) / SAMPLE_SEGMENTS).cast("int")
    segments = [
        text.substr(
            (k * part + F.pmod(F.xxhash64("doc_id", F.lit(k)), part - size + 1) + 1).cast("int"), F.lit(size)
        )
        for k in range(SAMPLE_SEGMENTS)
    ]
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.concat_ws(" ", *segments))


def identified(
    docs: DataFrame,
    automata: list[tuple[str, int, bytes]],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, lang_pred, score, n_symbols`` for every row of ``docs``.

    Texts are lower-cased; what is no letter counts as one space. ``score`` is by how
    much, as a share, the best language's entropy lies below the next one's (one where
    there is no other). A text that is null or has no letter is ``und``, score 0, as all are if
    nothing was learnt. Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automata)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    ).mapInArrow(_identify(shared), "doc_id long, lang_pred string, score double, n_symbols long")


def _letters():
    """Whether a code point is a letter."""
    import numpy as np

    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return cache["letters"]


def _code_points(texts: list[str]):
    """Lower-case code points of texts, one after the other, non-letters 0; and their lengths."""
    import numpy as np

    lower = [text.lower() for text in texts]
    chars = np.frombuffer("".join(lower).encode("utf-32-le", "replace"), "<u4")
    chars = np.where(_letters()[chars], chars, 0)
    return chars, np.fromiter(map(len, lower), np.int64, len(lower))


def _automaton(sample):
    """Suffix automaton of the sampled texts of a language, as edges (state, character, next)."""
    import numpy as np
    import pandas as pd

    texts = sample.sort_values("doc_id", kind="stable")["text"].tolist()
    chars, _ = _code_points([" ".join(texts)])
    keep = (chars != 0) | np.r_[False, chars[:-1] != 0]
    chars = chars[keep].tolist()
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in chars:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    edges = np.array([(s, c, t) for s, out in enumerate(nexts) for c, t in out.items()], "<i4")
    return pd.DataFrame(
        {"lang": sample["lang"].iloc[:1], "length": [len(chars)], "edges": [edges.reshape(-1, 3).tobytes()]}
    )


class _Parser:
    """All automata in one table of steps: ``table[state * width + symbol]``."""

    def __init__(self, automata: list[tuple[str, int, bytes]]):
        import numpy as np

        self.names = [name for name, _, _ in automata]
        self.cost = np.log2(np.array([n for _, n, _ in automata], float) + 1)
        edges = [np.frombuffer(e, "<i4").reshape(-1, 3) for _, _, e in automata]
        known = np.unique(np.concatenate([e[:, 1] for e in edges] + [np.zeros(1, np.int32)]))
        # Symbol 0 is the space, the last one any letter that no language has.
        self.width = len(known) + 1
        self.symbol = np.full(0x110000, len(known), np.int32)
        self.symbol[known] = np.arange(len(known))
        tables, self.start, base = [], [], 0
        for e in edges:
            states = int(e[:, [0, 2]].max()) + 1
            begin = base + states  # from here every step begins a phrase
            step = np.full((states + 1, self.width), -1, np.int64)
            step[e[:, 0], self.symbol[e[:, 1]]] = e[:, 2] + base
            root = np.where(step[0] >= 0, step[0], begin) + BEGINS
            step = np.where(step >= 0, step, root)
            tables.append(step)
            self.start.append(begin)
            base = begin + 1
        self.table = np.concatenate(tables).astype(np.int32).ravel()

    def phrases(self, symbols, owner, n_docs: int):
        """Phrases by language and document, of windows given as rows of ``symbols``."""
        import numpy as np

        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(owner)])
        # Cut documents into windows.
        per = -(-sizes // WINDOW)
        w_doc = np.repeat(np.arange(len(starts)), per)
        w_no = np.arange(len(w_doc)) - np.repeat(np.cumsum(per) - per, per)
        w_start = starts[w_doc] + w_no * WINDOW
        w_len = np.minimum(sizes[w_doc] - w_no * WINDOW, WINDOW)
        order = np.argsort(-w_len, kind="stable")
        w_start, w_len, w_doc = w_start[order], w_len[order], w_doc[order]
        counts = np.zeros((len(self.names), len(w_doc)), np.int64)
        state = np.repeat(np.array(self.start)[:, None], len(w_doc), axis=1)
        active = np.searchsorted(-w_len, -np.arange(WINDOW + 1), side="left")
        for t in range(int(w_len[0]) if len(w_len) else 0):
            n = active[t]
            got = self.table.take(state[:, :n] * self.width + symbols[w_start[:n] + t])
            counts[:, :n] += got >> 30
            state = got & (BEGINS - 1)
        out = np.zeros((len(self.names), n_docs), np.int64)
        docs = owner[starts][w_doc] if len(starts) else np.zeros(0, int)
        for k in range(len(self.names)):
            out[k] = np.bincount(docs, counts[k], n_docs)[:n_docs]
        return out


def _identify(shared):
    def identify(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        automata = shared.value
        parser = _Parser(automata) if automata else None

        def judged(texts: list[str]):
            chars, lengths = _code_points(texts)
            owner = np.repeat(np.arange(len(texts)), lengths)
            first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
            # One space between words, none first.
            keep = (chars != 0) | ~(first | np.r_[True, chars[:-1] == 0][: len(chars)])
            letters = np.bincount(owner[chars != 0], minlength=len(texts))
            chars, owner = chars[keep], owner[keep]
            n = np.bincount(owner, minlength=len(texts))
            if parser is None:
                return [UNDETERMINED] * len(texts), np.zeros(len(texts)), n
            entropy = parser.phrases(parser.symbol[chars], owner, len(texts)) * parser.cost[:, None]
            best = entropy.argmin(axis=0)
            low = entropy.min(axis=0)
            if len(entropy) > 1:
                second = np.partition(entropy, 1, axis=0)[1]
                score = 1 - low / np.where(second > 0, second, 1)
            else:
                score = np.ones(len(texts))
            names = [parser.names[b] if k else UNDETERMINED for b, k in zip(best, letters)]
            return names, np.where(letters > 0, score, 0.0), n

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= AT_A_TIME):
                    size += len(texts[stop])
                    stop += 1
                names, score, n = judged(texts[start:stop])
                yield pa.RecordBatch.from_arrays(
                    [ids[start:stop], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64())],
                    names=["doc_id", "lang_pred", "score", "n_symbols"],
                )
                start = stop

    return identify
