"""A hidden Markov language model of whole documents.

A frequent word is a symbol of its own, the others share symbols by a hash (classes);
within a class a word has its smoothed share of the class's counts. Baum-Welch trains
latent states over the symbols: each task sums expected counts of its documents, and the
sums over all tasks give the next parameters. The scaled forward recursion then gives the
exact likelihood of every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import text_or_empty
from shelfspark.session import written

STATES, ROUNDS = 6, 4
#: A word with one in so many of all tokens or more is sent to all tasks: at most so many words.
COMMON = 262_144
#: Likewise, a word that is a symbol of its own.
OWN = 8192
CLASSES = 256
#: Added to each count, and to that of words never seen, which count as one.
ADDED = 0.1
#: Tokens of a window: Baum-Welch takes windows of documents, scoring takes whole ones.
WINDOW = 128
#: Documents whose forward recursions run side by side, and tokens, whichever is reached first.
SIDE_DOCS, SIDE_TOKENS = 4096, 4_000_000
#: Words counted in a task before their counts are handed on.
COUNTED_WORDS = 2_000_000
END = ""


def scored(
    docs: DataFrame,
    held_out,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = STATES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``held_out`` is a boolean column of ``docs`` (null counts as false); the others train
    the model. Tokens are lower-case (A-Z) words and one end. ``base_score`` is the log10
    likelihood of smoothed token counts, ``score`` that of the model. Null text is empty:
    only the end. With no training rows all tokens have probability one.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        text_or_empty(text_col).alias("text"),
    )
    counts = written(
        rows.filter("NOT held_out")
        .select("text")
        .mapInArrow(_count, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n")),
        "counts",
    )
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = facts.n, facts.v
    # At most COMMON words have so large a count.
    common = {
        r.word: r.n
        for r in counts.filter((F.col("n") * COMMON >= n) | (F.col("word") == END)).collect()
    }
    common.setdefault(END, 0)
    own = {w: k for k, w in enumerate(sorted(w for w, c in common.items() if c * OWN >= n or w == END))}
    grouped = counts.filter((F.col("n") * OWN < n) & (F.col("word") != END))
    per_class = {
        r["class"]: (r.n, r.v)
        for r in grouped.groupBy((F.crc32(F.col("word").cast("binary")) % CLASSES).alias("class"))
        .agg(F.sum("n").alias("n"), F.count("*").alias("v"))
        .collect()
    }
    sizes = [per_class.get(k, (0, 0)) for k in range(CLASSES)]
    context = rows.sparkSession.sparkContext
    coding = context.broadcast((common, own, sizes))
    encoded = written(
        rows.mapInArrow(
            _encode(coding),
            "row long, doc_id long, held_out boolean, n_tokens long, n_known long, "
            "counts_log double, shares_log double, symbols binary, rare map<string, long>",
        ),
        "encoded",
    )
    # Words that are not common meet their counts by word. None of them is a hot key: each
    # has fewer than one in COMMON of the training tokens, or was never seen.
    rare = (
        encoded.select("row", F.explode("rare").alias("word", "times")).join(counts, "word", "left")
    )
    in_class = F.array(*[F.lit(float(c + ADDED * (d + 1))) for c, d in sizes])
    plus = F.coalesce("n", F.lit(0)) + ADDED
    crc = (F.crc32(F.col("word").cast("binary")) % CLASSES).cast("int")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(plus)).alias("rare_counts"),
        F.sum(F.col("times") * F.log10(plus / F.get(in_class, crc))).alias("rare_shares"),
    )
    symbols = [common[w] for w in own] + [c for c, _ in sizes]
    trained = train(encoded.filter("NOT held_out"), symbols, states, rounds)
    model = context.broadcast(trained)
    forward = encoded.select("row", "symbols").mapInArrow(_forward(model), "row long, path_log double")
    total = n + ADDED * (v + 1)
    all_ = encoded.drop("symbols", "rare").join(forward, "row").join(rare, "row", "left")
    zero = F.lit(0.0)
    return all_.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (
            F.col("counts_log") + F.coalesce("rare_counts", zero) - F.col("n_tokens") * F.log10(F.lit(total))
        ).alias("base_score"),
        (F.col("path_log") + F.col("shares_log") + F.coalesce("rare_shares", zero)).alias("score"),
    )


def train(encoded: DataFrame, symbols: list[int], states: int, rounds: int) -> tuple:
    """Start, transition and emission probabilities, from written rows with ``symbols``.

    ``symbols`` has the training count of each symbol; its length is bounded, and so is
    what tasks send: expected counts by symbol and state.
    """
    import numpy as np

    chance = np.random.default_rng(0)
    counts = np.array(symbols, float) + ADDED
    emit = counts[:, None] * np.exp(chance.normal(0, 0.5, (len(counts), states)))
    emit /= emit.sum(axis=0)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    start = np.full(states, 1 / states)
    context = encoded.sparkSession.sparkContext
    names = [f"s{k}" for k in range(states)]
    schema = "i int, " + ", ".join(f"{name} double" for name in names)
    for _ in range(rounds):
        model = context.broadcast((start, move, emit))
        sums = (
            encoded.select("symbols")
            .mapInArrow(_expect(model, states), schema)
            .groupBy("i")
            .agg(*[F.sum(name).alias(name) for name in names])
            .collect()
        )
        if not sums:
            break
        expected = np.zeros((1 + states + len(counts), states))
        for r in sums:
            expected[r.i] = [r[name] for name in names]
        expected += 1e-3
        start = expected[0] / expected[0].sum()
        move = expected[1 : 1 + states]
        move = move / move.sum(axis=1, keepdims=True)
        # Each symbol keeps a share in each state, in proportion to its count.
        emit = expected[1 + states :] + ADDED * counts[:, None] / counts.sum()
        emit = emit / emit.sum(axis=0)
        model.unpersist()
    return start, move, emit


def _count(batches: Iterator) -> Iterator:
    from collections import Counter

    import pyarrow as pa

    def handed(counts: Counter):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"],
        )

    counts: Counter = Counter()
    ends = 0
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            counts.update(text.lower().split())
            ends += 1
            if len(counts) > COUNTED_WORDS:
                yield handed(counts)
                counts.clear()
    if ends:
        counts[END.encode()] = ends
    yield handed(counts)


def _encode(coding):
    def encode(batches: Iterator) -> Iterator:
        import zlib
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        common, own, sizes = coding.value
        in_class = [c + ADDED * (d + 1) for c, d in sizes]
        # Of each common word: its place in the tables below.
        place = {w.encode(): k for k, w in enumerate(common)}
        symbol = np.array(
            [own[w] if w in own else len(own) + zlib.crc32(w.encode()) % CLASSES for w in common]
        )
        counts = np.array(list(common.values()), float)
        known = counts > 0
        counts_log = np.log10(counts + ADDED)
        shares_log = np.array(
            [0.0 if w in own else np.log10((c + ADDED) / in_class[zlib.crc32(w.encode()) % CLASSES]) for w, c in common.items()]
        )
        end = place[END.encode()]
        row = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "counts_log", "shares_log", "symbols", "rare"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.map_(pa.string(), pa.int64())]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            ids, held = (batch.column(k).to_pylist() for k in (0, 1))
            for doc_id, aside, text in zip(ids, held, batch.column(2).cast(pa.binary()).to_pylist()):
                words = text.lower().split()
                at = np.fromiter(map(place.get, words, _minus_ones()), np.int64, len(words))
                at = np.append(at, end)
                odd = np.flatnonzero(at < 0)
                rare = [words[k] for k in odd.tolist()]
                symbols = symbol[at]
                if rare:
                    symbols[odd] = [len(own) + zlib.crc32(w) % CLASSES for w in rare]
                fine = at[at >= 0]
                values = (
                    row, doc_id, aside, len(at), int(known[fine].sum()), float(counts_log[fine].sum()),
                    float(shares_log[fine].sum()), symbols.astype("<u2").tobytes(), [(w.decode(), n) for w, n in Counter(rare).items()],
                )
                for column, value in zip(out, values):
                    column.append(value)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(out, kinds)], names=names
            )

    return encode


def _minus_ones():
    from itertools import repeat

    return repeat(-1)


def _expect(model, states: int):
    """Expected counts of a task: row 0 of starts, then of moves from a state, then of symbols."""

    def expect(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        start, move, emit = model.value
        starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros(emit.shape)
        anywhere = np.full(states, 1 / states)  # for windows inside a document
        seen = False

        def add(sequences: list) -> None:
            nonlocal starts, moves
            sizes = np.array([len(s) for s in sequences])
            joined = np.concatenate(sequences).astype(np.int64)
            begin = np.cumsum(sizes) - sizes
            per = -(-sizes // WINDOW)
            doc = np.repeat(np.arange(len(sizes)), per)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            length = np.minimum(sizes[doc] - number * WINDOW, WINDOW)
            order = np.argsort(-length, kind="stable")
            begin, length, number = (begin[doc] + number * WINDOW)[order], length[order], number[order]
            steps = int(length[0])
            active = np.searchsorted(-length, -np.arange(steps + 1), side="left")
            alphas, scales, seen_emit = [], [], []
            before = np.where((number == 0)[:, None], start, anywhere)
            for t in range(steps):
                m = active[t]
                e = emit.take(joined[begin[:m] + t], axis=0)
                a = (before if t == 0 else alphas[-1][:m] @ move) * e
                c = a.sum(axis=1, keepdims=True)
                a /= c
                alphas.append(a)
                scales.append(c)
                seen_emit.append(e)
            beta = np.zeros((0, states))
            for t in range(steps - 1, -1, -1):
                m = active[t]
                full = np.ones((m, states))
                if t + 1 < steps:
                    later = active[t + 1]
                    ahead = seen_emit[t + 1] * beta / scales[t + 1]
                    moves += (alphas[t][:later].T @ ahead) * move
                    full[:later] = ahead @ move.T
                beta = full
                gamma = alphas[t] * beta
                gamma /= gamma.sum(axis=1, keepdims=True)
                alphas[t] = gamma
                if t == 0:
                    starts += gamma[number == 0].sum(axis=0)
            at = np.concatenate([joined[begin[: active[t]] + t] for t in range(steps)])
            gammas = np.concatenate(alphas)
            for k in range(states):
                emits[:, k] += np.bincount(at, gammas[:, k], len(emits))

        for held in _side_by_side(batches, 500_000):
            add([s for _, s in held])
            seen = True
        if seen:
            table = np.concatenate([starts[None], moves, emits])
            some = np.flatnonzero(table.sum(axis=1) > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), *[pa.array(table[some, k]) for k in range(states)]],
                names=["i", *[f"s{k}" for k in range(states)]],
            )

    return expect


def _side_by_side(batches: Iterator, tokens: int = SIDE_TOKENS) -> Iterator:
    """Lists of (row, symbols) of a bounded size; one longer sequence alone may exceed it."""
    import numpy as np

    held, size = [], 0
    for batch in batches:
        rows = batch.column(0).to_pylist() if batch.num_columns > 1 else [None] * batch.num_rows
        for row, data in zip(rows, batch.column(batch.num_columns - 1).to_pylist()):
            symbols = np.frombuffer(data, "<u2")
            held.append((row, symbols))
            size += len(symbols)
            if len(held) >= SIDE_DOCS or size >= tokens:
                yield held
                held, size = [], 0
    if held:
        yield held


def _forward(model):
    """log10 probability of the symbols of each row, by the scaled forward recursion."""

    def forward(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        start, move, emit = model.value
        for held in _side_by_side(batches):
            held.sort(key=lambda x: -len(x[1]))
            sizes = np.array([len(s) for _, s in held])
            joined = np.concatenate([s for _, s in held]).astype(np.int64)
            begin = np.cumsum(sizes) - sizes
            logs = np.zeros(len(held))
            steps = int(sizes[0])
            active = np.searchsorted(-sizes, -np.arange(steps + 1), side="left")
            alpha = np.broadcast_to(start, (len(held), len(start)))
            for t in range(steps):
                m = active[t]
                a = (alpha if t == 0 else alpha[:m] @ move) * emit.take(joined[begin[:m] + t], axis=0)
                c = a.sum(axis=1)
                logs[:m] += np.log10(c)
                alpha = a / c[:, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in held], pa.int64()), pa.array(logs)], names=["row", "path_log"]
            )

    return forward
