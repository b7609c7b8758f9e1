import hashlib
import os
import re
from itertools import combinations

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import exact_dedup, simhash, substrings
from shelfspark.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 11), (11, 3), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = roots_of({x for p in links[:-1] for x in p}, links[:-1])
    assert got == {n: r for n, r in expected.items() if n != 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_long_chain_is_one_component(spark):
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in components(links).collect()} == {0}


def test_exact_groups(corpus):
    rows = corpus.collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    expected = []
    for r in rows:
        same = [x.doc_id for x in rows if norm(x.text) == norm(r.text)]
        keep = min((x for x in same if x is not None), default=None)
        sha = hashlib.sha256(norm(r.text).encode()).hexdigest()
        expected.append((r.doc_id, keep, len(same), sha))
    got = exact_dedup.exact_groups(corpus, block_chars=64).collect()
    found = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got]
    in_order = lambda rows: sorted(rows, key=lambda x: (str(x[0]), x[3]))
    assert in_order(found) == in_order(expected)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({norm(r.text) for r in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_keeps_one_row_of_each_text(corpus, nothing):
    got = exact_dedup.exact_dedup(corpus).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert len(got) == len({norm(r.text) for r in got}) == len({norm(r.text) for r in corpus.collect()})
    assert exact_dedup.exact_dedup(corpus).columns == corpus.columns
    assert exact_dedup.exact_groups(nothing).count() == 0 == exact_dedup.exact_dedup(nothing).count()


def test_near_groups(corpus, nothing):
    rows = corpus.collect()
    prints = {(r.doc_id, r.text): plain_fingerprint(r.text) for r in rows}
    links = [(a, b) for a, b in combinations(set(prints.values()), 2) if (a ^ b).bit_count() <= 2]
    root = roots_of(set(prints.values()), links)
    smallest = {}
    for (doc_id, _), f in prints.items():
        if doc_id is not None:
            smallest[root[f]] = min(doc_id, smallest.get(root[f], doc_id))
    got = simhash.near_groups(corpus).collect()
    assert len(got) == len(rows)
    expected = sorted((str(r.doc_id), prints[r.doc_id, r.text], smallest[root[prints[r.doc_id, r.text]]]) for r in rows)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in got) == expected
    assert simhash.near_groups(nothing).count() == 0
    kept = simhash.near_dedup(corpus).collect()
    assert {r.doc_id for r in kept} == {r.component_id for r in got} | {None}


def test_links_of_all_close_fingerprints(spark):
    """All pairs within two bits end in one component, in small cells and in large ones."""
    import random

    chance = random.Random(1)
    prints = {chance.getrandbits(64) for _ in range(50)}
    for f in list(prints)[:6]:
        for _ in range(40):
            prints.add(f ^ (1 << chance.randrange(64)) ^ (1 << chance.randrange(64)) ^ (chance.random() < 0.3) * (1 << chance.randrange(64)))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    links = [(signed(a), signed(b)) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2]
    expected = roots_of({signed(f) for f in prints}, links)
    for paired in (1000, 3):
        got = {r.node: r.root for r in components(simhash.links(nodes, paired)).collect()}
        assert {n: got.get(n, n) for n in expected} == expected


def test_the_embedding_is_a_lower_bound(spark):
    from pyspark.sql import functions as F

    rows = spark.range(500).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"))
    rows = rows.union(rows.select("a", F.col("a").bitwiseXOR(F.lit(5)).alias("b")))
    bound = simhash.manhattan(simhash.embedded(F.col("a")), simhash.embedded(F.col("b")))
    for r in rows.select("a", "b", bound.alias("bound")).collect():
        counts = [[(x % (1 << 64) >> 2 * k & 3).bit_count() for k in range(32)] for x in (r.a, r.b)]
        assert r.bound == sum(abs(x - y) for x, y in zip(*counts))
        assert r.bound <= ((r.a ^ r.b) % (1 << 64)).bit_count()


def words(chance, n):
    return ["".join(chance.choices("abcdefghij", k=5)) for _ in range(n)]


def test_repeated_passages(spark, corpus, nothing):
    import random

    chance = random.Random(2)
    passages = [" ".join(words(chance, 52)) for _ in range(30)]
    rows = []
    for k, passage in enumerate(passages):
        for copy in range(2):
            before, after = (" ".join(words(chance, chance.randint(20, 90))) for _ in range(2))
            rows.append((2 * k + copy, f"{before} {passage} {after}"))
    line = words(chance, 60)
    near = line[:30] + ["other"] + line[31:]
    rows += [(100, "x\n" + " ".join(line)), (101, " ".join(near) + "\ny")]
    rows += [(200 + k, " ".join(words(chance, 120))) for k in range(40)]
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_doc_id) for r in got if r.removed} >= {(2 * k + 1, 2 * k) for k in range(30)} | {(101, 100)}
    assert all(r.doc_id < 200 for r in got)
    text = dict(rows)
    assert all(text[r.doc_id][r.start : r.stop].split() and r.words == len(text[r.doc_id][r.start : r.stop].split()) for r in got)
    assert substrings.repeats(nothing).count() == 0
    odd = substrings.repeats(corpus).collect()
    assert {r.doc_id for r in odd} >= {7, 8, 9, None}


def plain_units(text):
    """Characters, words and kind of a text's units, one window at a time."""
    found = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    lower = text.encode().lower().split()
    if not lower:
        return set()
    shingles = substrings._shingles(lower).tolist()
    least = set()
    for k in range(len(shingles) - substrings.ANCHOR_WINDOW + 1):
        window = shingles[k : k + substrings.ANCHOR_WINDOW]
        least.add(k + window.index(min(window)))
    cuts, before = [], None
    for k in sorted(least):
        if before is None or shingles[k] != shingles[before] or k - cuts[-1] >= substrings.ANCHOR_WINDOW:
            cuts.append(k)
        before = k
    edges = sorted({0, *cuts, len(lower)})
    units = {(a, b, False) for a, b in zip(edges, edges[1:])}
    line_of = [text.count("\n", 0, start) for start, _ in found]
    for line in set(line_of):
        own = [k for k, other in enumerate(line_of) if other == line]
        if len(own) >= substrings.LINE_WORDS:
            units.add((own[0], own[-1] + 1, True))
    return {(found[a][0], found[b - 1][1], a, b, line) for a, b, line in units}


def test_texts_are_taken_apart_as_if_alone(spark):
    import random

    chance = random.Random(9)
    texts = ["", " \n", "a", "a b c d", "é ü " * 30, "same " * 60, "\n".join(["same " * 5] * 30), "A\x0bB\tC " * 9]
    for _ in range(150):
        parts = [" ".join(chance.choices(["a", "B", "cé"], k=chance.randint(0, 70))) for _ in range(3)]
        texts.append(chance.choice(["\n", " ", "\n \n"]).join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = substrings.paragraphs(docs).collect()
    alike = {}
    for r in got:
        key = " ".join(texts[r.doc_id][r.start : r.stop].lower().split()), r.bands is not None
        alike.setdefault(key, set()).add((r.h1, r.h2, str(r.bands)))
    assert all(len(hashes) == 1 for hashes in alike.values())
    for k, text in enumerate(texts):
        own = [r for r in got if r.doc_id == k]
        assert {(r.start, r.stop, r.first, r["last"], r.bands is not None) for r in own} == plain_units(text)


def test_pieces_that_occur_once_go_no_further(spark, monkeypatch):
    import random

    tables, write = {}, substrings.written

    def noted(rows, name):
        tables[name] = write(rows, name)
        return tables[name]

    monkeypatch.setattr(substrings, "written", noted)
    chance = random.Random(6)
    passage = " ".join(words(chance, 60))
    rows = [(k, f"{' '.join(words(chance, 30))} {passage} {' '.join(words(chance, 30))}") for k in range(3)]
    rows += [(k, "\n".join(" ".join(words(chance, 15)) for _ in range(20))) for k in range(3, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    units = substrings.paragraphs(docs).collect()
    times = {}
    for unit in units:
        times[unit.h1, unit.h2] = times.get((unit.h1, unit.h2), 0) + 1
    want = sorted((u.doc_id, u.start, u.stop, u.h2) for u in units if u.bands is not None or times[u.h1, u.h2] > 1)
    assert substrings.repeats(docs).filter("removed").select("doc_id").distinct().count() == 2
    # Of the tables on the way there stay those that the result reads.
    assert {name for name, rows in tables.items() if os.path.isdir(rows.written_to)} == {"kept", "repeated"}
    assert sorted(map(tuple, tables["kept"].select("doc_id", "start", "stop", "h2").collect())) == want
    assert 0 < len(want) < len(units) / 2


def test_pieces_leave_the_key_of_their_text(spark):
    import random

    chance = random.Random(7)
    passage, line = (" ".join(words(chance, 60)) for _ in range(2))
    rows = [(k, f"{' '.join(words(chance, 30))} {passage}\n{line}") for k in range(3)]
    units = substrings.paragraphs(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = substrings._kept(units).collect()
    assert {r.text_key is None for r in kept if r.bands is None} == {True}
    assert {(r.doc_id, r.text_key) for r in kept if r.bands is not None} == {(r.doc_id, r.text_key) for r in units.collect()}


def test_shingles_and_comparisons_hold_little_at_a_time():
    import random
    import struct
    import tracemalloc

    import pyarrow as pa

    chance = random.Random(8)
    texts = [" ".join(words(chance, 3000)) for _ in range(60)]
    of_text = [
        [dict(zip(("id", "start", "stop", "h1", "h2"), (k, 0, len(text), *struct.unpack("<2q", xxhash.xxh3_128_digest(text)))))]
        for k, text in enumerate(texts)
    ]
    got = list(substrings._shingle_sets(iter([pa.RecordBatch.from_pydict({"text": texts, "_wanted": of_text})])))
    assert len(got) > 3 and max(part.nbytes for part in got) < 2 * substrings.TEXT_BYTES
    sets = {r["id"]: r["shingles"] for part in got for r in part.to_pylist()}
    assert all(
        [n % 2**64 for n in sets[k]] == sorted(set(substrings._shingles(text.encode().split()).tolist()))
        for k, text in enumerate(texts)
    )

    # Of each seven sets three are alike; numbers above 2**63 are negative as longs.
    group = []
    for k in range(70):
        base = range(k // 7 << 20, (k // 7 << 20) + 20_000)
        own = set(base[k % 7 * 1000 :] if k % 7 < 3 else base[k % 7 * 3000 :]) | {2**64 - 1 - k}
        group.append((k, sorted(own)))
    columns = {"id": [k for k, _ in group], "band": [1] * 70, "own": [0] * 70, "i": [0] * 70, "j": [0] * 70}
    longs = pa.array([[n - (n >> 63 << 64) for n in own] for _, own in group], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_pydict(columns | {"shingles": longs})
    tracemalloc.start()
    links = [(r["a"], r["b"]) for part in substrings._compared(iter([batch])) for r in part.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * batch.nbytes
    near = [
        (a, b)
        for (a, x), (b, y) in combinations([(k, set(own)) for k, own in group], 2)
        if len(x & y) >= substrings.SIMILARITY * len(x | y)
    ]

    def joined(pairs):
        root = list(range(70))
        for a, b in pairs:
            root = [root[a] if r == root[b] else r for r in root]
        return [root.index(r) for r in root]

    assert joined(links) == joined(near) and set(links) <= set(near) and len(links) >= 20


def test_repeats_are_cut_out(spark):
    import random

    chance = random.Random(4)
    line = " ".join(words(chance, 60))
    docs = spark.createDataFrame([(1, "start\n" + line), (2, line + "\nend"), (3, None)], "doc_id long, text string")
    found = substrings.repeats(docs)
    got = {r.doc_id: r.text for r in substrings.without_repeats(docs, found).collect()}
    assert got[1] == "start\n" + line and got[3] is None
    assert got[2].endswith("end") and len(got[2].split()) < 30


@settings(max_examples=30, deadline=None)
@given(st.floats(0.5, 0.95), st.floats(0.5, 0.999))
def test_bands_reach_the_recall(similarity, recall):
    bands, rows = substrings.bands_for(similarity, recall, 64)
    assert 1 - (1 - similarity**rows) ** bands >= recall - 1e-9


def test_ids_that_rows_share_and_names_that_clash(spark):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(1, base, "p", "a"), (2, base, "q", "b"), (2, "another text of its own", "r", "c")]
    rows += [(None, base, "s", "d"), (None, "none has this text", "t", "e"), (3, base, "u", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_key string, _Print string")
    want = [("another text of its own", "r", "c"), (base, "p", "a"), ("none has this text", "t", "e")]
    # The near stage leaves rows without an id alone.
    for kept, more in ((exact_dedup.exact_dedup(docs), []), (simhash.near_dedup(docs), [(base, "s", "d")])):
        assert kept.columns == docs.columns
        assert sorted(tuple(r)[1:] for r in kept.collect()) == sorted(want + more)
