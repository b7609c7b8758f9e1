"""Conversation structure repair by a square-root checkpointed dynamic programme.

A conversation should be an optional system turn, then pairs of user and assistant. The
cheapest edits to that shape are paths through a small automaton. For a row, four numbers say
what the rest of the conversation costs from each state; they are found from the last row
backwards and kept at checkpoints only. Walking forward, the rows between two checkpoints
get theirs again, and the first edit by name among the tight ones is taken.

Conversations are cut into blocks of rows, spread over all tasks however long one is. A block
is worth a matrix (cost from each state before it to each after it), so the vectors at
block ends need the matrices only; within a block every square root of its length is a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfspark.session import dropped, written

#: Costs of edits; keeping a row is free. An undeleted truncated row costs its own on top.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Distinct rows of a block, which a task has at a time.
BLOCK_ROWS = 4096
#: Kinds of rows by their first fault.
SOUND, CUT, BLANK, REPEATED = range(4)
#: States: nothing yet, after system, after user, after assistant (an end, like nothing yet).
#: Where the next added role leads, and where a kept row with the initial s, u, a or another.
NEXT = (2, 2, 3, 2)
KEEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
ENDS = (0, 3)
LEGAL = ((0, 1), (1, 2), (2, 1))
#: More than any path costs.
NEVER = 1 << 50
WHITE = " \t\n\x0b\x0c\r"

ROW = ["conv_id", "turn", "digest"]
KEY = "conv_id long, turn long, digest binary"
BLOCK = (
    f"{KEY}, alone boolean, turns array<long>, digests array<binary>, copies array<long>, kinds array<int>, "
    "initials array<int>, blank long, duplicate long, truncated long, illegal long, n_turns long, "
    "first_turn long, last_turn long, first_initial int, last_initial int, matrix array<long>"
)
ENDING = f"{KEY}, head boolean, last boolean, ending array<long>, more_illegal long, same_turns long"
WALKED = f"{KEY}, cost long, exits array<int>, sizes array<long>, audits array<string>"
ENTRY = f"{KEY}, entry int, before long"
PLACED = f"{KEY}, place long, new_role string"


def repaired(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(audits, rows): what is wrong with each conversation, and the repaired rows.

    Rows of a conversation are taken by turn (nulls first), those of one turn by a hash of
    role and text, so equal rows are neighbours. A null role or text is one space; a null
    conversation id is an id of its own. Columns other than ``conv_id, turn, role, text`` aren't read.

    Audits hold a row per ``conv_id``: ``gaps``, ``blank``, ``duplicate``, ``truncated`` (by a row's
    first fault), ``illegal`` neighbours, ``cost`` and ``audit``, the initials of the cheapest
    edits (Delete, Insert, Keep, Rerole), the ASCII-least of equal costs. Rows are ``conv_id,
    place`` (from 1), ``role, text``. An empty table gives none of either.

    Equal rows of a turn travel as one with a count. What a task sees whole of a
    conversation is one row per block, and its audit, which is a value of the result.
    """
    rows = _rows(conversations)
    lines = written(_lines(rows), "lines")
    coded = _with_repeats(lines).repartitionByRange(*ROW).sortWithinPartitions(*ROW)
    blocks = written(_mapped(coded, _blocks(block_rows), BLOCK, 500), "blocks")
    dropped(lines)
    spine = blocks.filter("NOT alone").repartition("conv_id").sortWithinPartitions(*ROW)
    needed = [*ROW, "matrix", "first_initial", "last_initial", "first_turn", "last_turn"]
    endings = written(_mapped(spine.select(needed), _endings, ENDING), "endings")
    alone = blocks.filter("alone").withColumns(
        {
            "head": F.lit(True),
            "last": F.lit(True),
            "ending": F.array(*map(F.lit, _final())).cast("array<long>"),
            "more_illegal": F.lit(0).cast("long"),
            "same_turns": F.lit(0).cast("long"),
        }
    )
    ended = alone.unionByName(_met(blocks.filter("NOT alone"), endings, ROW))
    sides = ["head", "last", "ending", "copies", "kinds", "initials"]
    walked = written(_mapped(ended.select(*ROW, *sides), _walks, WALKED, 500), "walked")
    heads = ended.select(*ROW, "alone", "head")
    spine = _met(walked.select(*ROW, "exits", "sizes"), heads.filter("NOT alone").drop("alone"), ROW)
    spine = spine.repartition("conv_id").sortWithinPartitions(*ROW)
    entries = written(_mapped(spine, _entries, ENTRY), "entries")
    chosen = heads.filter("alone").select(*ROW, F.lit(0).alias("entry"), F.lit(0).cast("long").alias("before"))
    chosen = _met(walked, chosen.unionByName(entries), ROW).select(
        *ROW, "cost", "entry", "before", F.get("audits", "entry").alias("audit")
    )
    chosen = written(chosen, "chosen")
    return _audits(ended, chosen), _repaired_rows(blocks, chosen, rows)


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys that may be null."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_{k}" for k in keys])


def _rows(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    both = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("digest", F.unhex(F.sha2(both, 256)))


def _lines(rows: DataFrame) -> DataFrame:
    """Distinct rows of a turn with their number, the initial of the role, and blank or cut text."""
    body = F.rtrim("text", F.lit(WHITE))
    kind = (
        F.when(body == "", BLANK)
        .when(F.substring(body, -1, 1).isin(".", "!", "?"), SOUND)
        .otherwise(CUT)
    )
    initial = F.substring("role", 1, 1)
    initial = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (
        rows.select(*ROW, kind.alias("kind"), initial.alias("initial"))
        .groupBy(*ROW)
        .agg(F.count("*").alias("copies"), F.first("kind").alias("kind"), F.first("initial").alias("initial"))
    )


def _with_repeats(lines: DataFrame) -> DataFrame:
    """Rows whose role and text an earlier turn has are repeated, unless they are blank."""
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    often = (
        lines.groupBy("conv_id", "digest")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    later = F.coalesce(place > F.col("first"), F.lit(False)) & (F.col("kind") != BLANK)
    return _met(lines, often, ["conv_id", "digest"], "left").select(
        *ROW, "copies", F.when(later, REPEATED).otherwise(F.col("kind")).alias("kind"), "initial"
    )


def _closed(costs: list[int]) -> list[int]:
    """With roles added before going on."""
    nothing, system, user, assistant = costs
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return [min(nothing, INSERT + user), min(system, INSERT + user), user, assistant]


def _final() -> list[int]:
    return _closed([0 if state in ENDS else NEVER for state in range(4)])


def _step(kind: int, initial: int, copies: int, after: list[int]) -> list[int]:
    """Costs before ``copies`` rows of a kind (several only of those that must go)."""
    if kind >= BLANK:
        return _closed([cost + DELETE * copies for cost in after])
    extra = TRUNCATED if kind == CUT else 0
    before = []
    for state in range(4):
        cost = min(DELETE + after[state], REROLE + extra + after[NEXT[state]])
        kept = KEEP[state][initial]
        before.append(cost if kept is None else min(cost, extra + after[kept]))
    return _closed(before)


def _items(kinds: list[int], initials: list[int], copies: list[int]) -> Iterator[tuple[int, int, int]]:
    """Rows of a block; the copies of one beyond the first are blank or repeated, and must go."""
    for kind, initial, n in zip(kinds, initials, copies):
        if kind >= BLANK:
            yield kind, initial, n
        else:
            yield kind, initial, 1
            if n > 1:
                yield REPEATED, initial, n - 1


def walk(items: list, ending: list[int], entries: list[int], last: bool) -> list[tuple[str, int, int]]:
    """From each entry state the edits as initials, the state that they end in, and their cost.

    The cost includes ``ending``, what comes after. Cost vectors are kept at checkpoints,
    a square root of the length apart, and made again for the rows between two of them.
    """
    apart = max(1, isqrt(len(items)))
    checkpoints = {len(items): ending}
    costs = ending
    for at in range(len(items) - 1, -1, -1):
        costs = _step(*items[at], costs)
        if at % apart == 0:
            checkpoints[at] = costs
    states, letters = list(entries), [[] for _ in entries]
    for start in range(0, len(items), apart):
        end = min(start + apart, len(items))
        vectors = [checkpoints[end]]
        for at in range(end - 1, start - 1, -1):
            vectors.append(_step(*items[at], vectors[-1]))
        vectors.reverse()
        for which, state in enumerate(states):
            edits = letters[which]
            for at in range(start, end):
                here, after = vectors[at - start], vectors[at - start + 1]
                kind, initial, copies = items[at]
                extra = TRUNCATED if kind == CUT else 0
                while True:
                    if here[state] == DELETE * copies + after[state]:
                        edits.append("D" * copies)
                        break
                    if here[state] == INSERT + here[NEXT[state]]:
                        edits.append("I")
                        state = NEXT[state]
                        continue
                    kept = KEEP[state][initial]
                    if kept is not None and here[state] == extra + after[kept]:
                        edits.append("K")
                        state = kept
                    else:
                        edits.append("R")
                        state = NEXT[state]
                    break
            states[which] = state
    for which in range(len(entries) if last else 0):
        while states[which] not in ENDS:
            letters[which].append("I")
            states[which] = NEXT[states[which]]
    return [("".join(a), s, checkpoints[0][e]) for a, s, e in zip(letters, states, entries)]


def _matrix(items: list) -> list[int]:
    """Cost from each state before a block (rows) to each one after it, row by row."""
    columns = []
    for state in range(4):
        costs = [0 if s == state else NEVER for s in range(4)]
        for item in reversed(items):
            costs = _step(*item, costs)
        columns.append(costs)
    return [min(columns[to][at], NEVER) for at in range(4) for to in range(4)]


def _batches(rows: Iterator[list], schema, size: int) -> Iterator:
    """Record batches of up to ``size`` rows."""
    import pyarrow as pa

    held: list[list] = []

    def batch():
        columns = [pa.array(column, field.type) for column, field in zip(zip(*held), schema)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _mapped(frame: DataFrame, rows: Callable, ddl: str, size: int = 5000) -> DataFrame:
    """``rows`` makes an iterator of rows from the one of a partition's rows."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return frame.mapInArrow(lambda batches: _batches(rows(_tuples(batches)), schema, size), ddl)


def _tuples(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            yield from zip(*(column.to_pylist() for column in batch.slice(start, 1000).columns))


def _blocks(size: int):
    """Sorted rows as blocks. A conversation that lies within the partition is known to be alone in it."""

    def block(held: list[tuple], alone: bool) -> list:
        _, turns, digests, copies, kinds, initials = (list(column) for column in zip(*held))
        items = list(_items(kinds, initials, copies))
        counts = [0] * 4
        for kind, _, n in items:
            counts[kind] += n
        illegal = sum(n - 1 for n in copies)
        illegal += sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
        given = [turn for turn in turns if turn is not None]
        return [
            *held[0][:3], alone, turns, digests, copies, kinds, initials,
            counts[BLANK], counts[REPEATED], counts[CUT], illegal, len(set(given)),
            given[0] if given else None, given[-1] if given else None, initials[0], initials[-1],
            [] if alone else _matrix(items),
        ]

    def blocks(rows):
        held: list[tuple] = []
        inner = first = True
        for row in rows:
            if held and (row[0] != held[0][0] or len(held) == size):
                ends = row[0] != held[0][0]
                yield block(held, ends and inner and not first)
                # Before the first row of a partition there may be more of its conversation.
                first, inner = first and not ends, ends
                held = []
            held.append(row)
        if held:
            yield block(held, False)

    return blocks


def _conversations(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Neighbouring rows with the same id."""
    held: list[tuple] = []
    for row in rows:
        if held and row[0] != held[0][0]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _endings(rows: Iterator[tuple]) -> Iterator[list]:
    """What comes after each block costs, from the last one backwards; and what crosses its start."""
    for blocks in _conversations(rows):
        costs, found = _final(), []
        for at in range(len(blocks) - 1, -1, -1):
            *key, matrix, first_initial, _, first_turn, _ = blocks[at]
            illegal = same = 0
            if at:
                *_, last_initial, _, last_turn = blocks[at - 1]
                illegal = int((last_initial, first_initial) not in LEGAL)
                same = int(first_turn is not None and first_turn == last_turn)
            found.append([*key, at == 0, at == len(blocks) - 1, costs, illegal, same])
            costs = [min(matrix[4 * s + t] + costs[t] for t in range(4)) for s in range(4)]
        yield from found


def _walks(rows: Iterator[tuple]) -> Iterator[list]:
    for *key, head, last, ending, copies, kinds, initials in rows:
        items = list(_items(kinds, initials, copies))
        walks = walk(items, ending, [0] if head else [0, 1, 2, 3], last)
        audits = [audit for audit, _, _ in walks]
        sizes = [len(audit) - audit.count("D") for audit in audits]
        yield [*key, walks[0][2] if head else None, [state for _, state, _ in walks], sizes, audits]


def _entries(rows: Iterator[tuple]) -> Iterator[list]:
    """In which state each block is entered, and how many repaired rows come before it."""
    for blocks in _conversations(rows):
        state = before = 0
        for *key, exits, sizes, _ in blocks:
            yield [*key, state, before]
            state, before = exits[state], before + sizes[state]


def _audits(ended: DataFrame, chosen: DataFrame) -> DataFrame:
    numbers = ["blank", "duplicate", "truncated", "illegal", "more_illegal", "n_turns", "same_turns"]
    sums = ended.groupBy("conv_id").agg(
        *[F.sum(name).alias(name) for name in numbers],
        F.min("first_turn").alias("first_turn"),
        F.max("last_turn").alias("last_turn"),
    )
    # The blocks of a conversation, in order; a byte per row, as the audit itself.
    parts = F.array_sort(F.collect_list(F.struct(F.struct(F.col("turn").isNotNull(), "turn", "digest"), "audit")))
    audits = chosen.groupBy("conv_id").agg(
        F.max("cost").alias("cost"), F.array_join(F.transform(parts, lambda part: part["audit"]), "").alias("audit")
    )
    gaps = F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns") + F.col("same_turns")
    return _met(sums, audits, ["conv_id"]).select(
        "conv_id",
        F.coalesce(gaps, F.lit(0)).alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        (F.col("illegal") + F.col("more_illegal")).alias("illegal"),
        "cost",
        "audit",
    )


def _placed(rows: Iterator[tuple]) -> Iterator[list]:
    """The rows that edits leave: where each goes, and its new role if it has one."""
    for *key, turns, digests, copies, initials, entry, before, audit in rows:
        state, place, edits = entry, before, iter(audit)
        conv_id = key[0]
        for turn, digest, initial, n in zip(turns, digests, initials, copies):
            while n:
                edit = next(edits)
                n -= edit != "I"
                if edit == "D":
                    continue
                place += 1
                kept = edit == "K"
                state = KEEP[state][initial] if kept else NEXT[state]
                role = None if kept else ("user" if state == 2 else "assistant")
                yield [conv_id, *((None, None) if edit == "I" else (turn, digest)), place, role]
        for _ in edits:
            place, state = place + 1, NEXT[state]
            yield [conv_id, None, None, place, "user" if state == 2 else "assistant"]


def _repaired_rows(blocks: DataFrame, chosen: DataFrame, rows: DataFrame) -> DataFrame:
    listed = _met(blocks, chosen.drop("cost"), ROW).select(
        *ROW, "turns", "digests", "copies", "initials", "entry", "before", "audit"
    )
    placed = written(_mapped(listed, _placed, PLACED), "placed")
    texts = rows.dropDuplicates(ROW)
    kept = _met(placed.filter("digest IS NOT NULL"), texts, ROW).select(
        "conv_id", "place", F.coalesce("new_role", "role").alias("role"), "text"
    )
    added = placed.filter("digest IS NULL").select("conv_id", "place", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return kept.unionByName(added)


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of the ``role:text`` of repaired rows, joined by newlines.

    The hash goes from row to row, so the rows of one conversation stream through one task in order;
    the task holds a batch of them at a time.
    """
    lines = rows.select("conv_id", "place", F.concat_ws(":", "role", "text").alias("line"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line")
    return _mapped(lines, _hashed, "conv_id long, repaired_sha256 string")


def _hashed(rows: Iterator[tuple]) -> Iterator[list]:
    import hashlib
    state, of = None, None
    for conv_id, line in rows:
        line = line.encode()
        if state is not None and conv_id == of:
            state.update(b"\n")
        else:
            if state is not None:
                yield [of, state.hexdigest()]
            state, of = hashlib.sha256(), conv_id
        state.update(line)
    if state is not None:
        yield [of, state.hexdigest()]