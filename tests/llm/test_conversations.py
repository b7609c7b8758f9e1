import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from shelfspark.llm import conversations
from shelfspark.llm.queries import damaged, op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, digest int, place long"


def plain_faults(rows):
    """First fault of each (role, text)."""
    faults, seen = [], set()
    for row in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", row[1])
        fault = None
        if not body:
            fault = "blank"
        elif row in seen:
            fault = "duplicate"
        elif body[-1] not in ".!?":
            fault = "truncated"
        seen.add(row)
        faults.append(fault)
    return faults


def plain_repair(rows):
    """Cheapest edits by searching all of them, cheapest first and then by their initials."""
    faults = plain_faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, shape, out = heapq.heappop(heap)
        if (at, shape) in done:
            continue
        done.add((at, shape))
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", shape):
            return cost, audit, out
        if not re.fullmatch(r"s?(ua)*u?", shape):
            continue
        steps = [(3, "I", at, role, (role, "")) for role in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            steps.append((4, "D", at + 1, "", None))
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 if faults[at] else 0
                steps.append((extra, "K", at + 1, role, (role, text)))
                steps += [(3 + extra, "R", at + 1, new, (new, text)) for new in ("user", "assistant")]
        for more, edit, to, role, row in steps:
            # A row without a role has no initial, which no shape allows.
            added = "" if row is None else (role[:1] or "?")
            kept = out if row is None else (*out, row)
            heapq.heappush(heap, (cost + more, audit + edit, to, shape + added, kept))


def plain(rows):
    """All columns of the query for rows (turn, role, text) of a conversation, in order."""
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(r, x) for _, r, x in rows]
    faults = plain_faults(pairs)
    cost, audit, out = plain_repair(pairs)
    initials = [r[:1] for r, _ in pairs]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{name: faults.count(name) for name in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
    }


def in_order(rows):
    """Rows as the operator takes them: by turn, nulls first, then by its hash."""

    def key(row):
        both = f"{len(row[1])}:{row[1]}{row[2]}"
        return (row[0] is not None, row[0] or 0, hashlib.sha256(both.encode()).digest())

    return sorted(rows, key=key)


def found(spark, rows, **options):
    audits, repaired = conversations.repaired(spark.createDataFrame(rows, SCHEMA), **options)
    hashes = {r.conv_id: r.repaired_sha256 for r in conversations.digests(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {}
    for r in audits.collect():
        assert r.conv_id not in got
        got[r.conv_id] = {k: v for k, v in r.asDict().items() if k != "conv_id"}
        got[r.conv_id]["repaired_sha256"] = hashes.get(r.conv_id, empty)
    return got


def invented(n, seed=5):
    chance = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "What?", "cut", "cut ", "", " \t", "é.\n", "End. \x0b", None, "x. "]
    rows = []
    for conv_id in [None, *range(n)]:
        for _ in range(chance.randint(1, 7)):
            turn = chance.choice([None, 0, 1, 2, 3, 5, 9])
            rows.append((conv_id, turn, chance.choice(roles), chance.choice(texts), 1, 2))
    return rows


@pytest.mark.parametrize("block_rows", [4096, 2, 1])
def test_equals_search_of_all_edits(spark, block_rows):
    """Also where blocks of a conversation meet in one task or in several."""
    rows = invented(60)
    groups = defaultdict(list)
    for conv_id, turn, role, text, _, _ in rows:
        groups[conv_id].append((turn, " " if role is None else role, " " if text is None else text))
    assert found(spark, rows, block_rows=block_rows) == {conv_id: plain(in_order(group)) for conv_id, group in groups.items()}


def test_one_conversation_over_all_partitions(spark):
    """A conversation that is nearly the whole table, in blocks of 100 rows."""
    texts = [f"Text {k}." if k % 7 else f"cut {k}" for k in range(3000)]
    roles = ["user" if k % 2 == 0 else "assistant" for k in range(3000)]
    roles[::101] = ["tool"] * len(roles[::101])
    rows = [(1, k, r, t, 0, 0) for k, (r, t) in enumerate(zip(roles, texts))]
    rows += [(1, 5000, "user", "Same.", 0, 0)] * 500 + [(2, 0, "user", "Hi.", 0, 0)]
    got = found(spark, rows, block_rows=100)
    pairs = [(r, t) for _, _, r, t, _, _ in rows if t != "Hi."]
    faults = plain_faults(pairs)
    items = [
        ({"blank": 2, "duplicate": 3, "truncated": 1, None: 0}[f], {"u": 1, "a": 2}.get(r[0], 3), 1)
        for f, (r, _) in zip(faults, pairs)
    ]
    ((audit, _, cost),) = conversations.walk(items, conversations._final(), [0], True)
    assert got[1]["audit"] == audit and got[1]["cost"] == cost
    assert got[1]["duplicate"] == 499 and got[1]["truncated"] == faults.count("truncated")
    assert got[2]["audit"] == "KI"


def test_empty_table(spark):
    audits, repaired = conversations.repaired(spark.createDataFrame([], SCHEMA))
    assert audits.count() == 0 and repaired.count() == 0


def test_query_equals_plain_version(spark, tmp_path):
    gone = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [r[:4] for r in invented(40, seed=8)] + [(gone, 0, "user", "Gone.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    groups = {conv_id: [] for conv_id, *_ in rows}
    for conv_id, turn, role, text in rows:
        show = lambda value: " " if value is None else str(value)
        hit = zlib.crc32(f"{show(conv_id)}:{show(turn)}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        row = (turn, "user" if hit == 4 else role, text)
        groups[conv_id] += [] if hit == 0 else [row] * (2 if hit == 3 else 1)
    expected = {c: plain(in_order(group)) for c, group in groups.items()}
    got = {}
    for r in op11_conversation_repair(spark, str(tmp_path)).collect():
        got[r.conv_id] = {k: v for k, v in r.asDict().items() if k != "conv_id"}
    assert got == expected
    assert any(not group for group in groups.values())
    assert damaged(spark.createDataFrame([], SCHEMA)).count() == 0
