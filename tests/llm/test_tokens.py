import os
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfspark.llm import mixing, packing, rollups
from shelfspark.llm.tokens import Encoder
from shelfspark.session import new_path

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True
ENCODER = Encoder("byte_bpe_50k.tiktoken")


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é1.,'s\n\t 🙂  "), max_size=40))
def test_ids_are_the_tokenizers(text):
    assert list(array("I", ENCODER.encode(text))) == plain_ids(text)


def test_ids_of_odd_texts():
    for text in ("", " ", "a  b", "a \n b", " a", "a ", "<|endoftext|> x", "don't I'll", "x\n\ny", "a  b", "a\x1c b"):
        assert list(array("I", ENCODER.encode(text))) == plain_ids(text), text


def check_packing(rows, pieces, limit):
    """Every piece once and whole; sequences gapless from 0 and no longer than the limit."""
    expected = []
    for doc_id, text in rows:
        ids = [*plain_ids(text), 2]
        first = len(ids) % limit or limit
        starts = [0, *range(first, len(ids), limit)]
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            own = b"".join(x.to_bytes(4, "little") for x in ids[a:b])
            expected.append((str(doc_id), n, a, b - a, zlib.crc32(own)))
    assert sorted((str(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == sorted(expected)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_packing(corpus, nothing):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    for limit in (64, 1024):
        got = packing.packed(corpus, limit).collect()
        used = check_packing(rows, got, limit)
        assert used <= 1.1 * sum(p.length for p in got) / limit + 2
    assert packing.packed(nothing).count() == 0


def sequential_best_fit(sizes, limit):
    gaps = []
    for size in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - size)
        else:
            gaps.append(limit - size)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120))
def test_sweeps_place_all_and_pack_like_best_fit(sizes):
    plan = packing.best_fit(dict(Counter(sizes)), 30)
    sequences = defaultdict(list)
    ranks = defaultdict(set)
    for length, first, last, sequence, offset in plan:
        for k in range(first, last):
            assert k not in ranks[length]
            ranks[length].add(k)
            sequences[sequence + k - first].append((offset, length))
    assert {k: len(v) for k, v in ranks.items()} == Counter(sizes)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 30
    assert len(sequences) <= 1.1 * sequential_best_fit(sizes, 30) + 1


def plain_totals(rows, counts):
    out = defaultdict(lambda: [0, 0])
    for key, n in zip(rows, counts):
        out[key][0] += 1
        out[key][1] += n
    return {k: tuple(v) for k, v in out.items()}


def test_rollups(spark, corpus, nothing):
    from pyspark.sql import functions as F

    rows = corpus.collect()
    names = ["byte_bpe_50k.tiktoken"]
    counted = rollups.token_counts(corpus, names)
    n = [len(plain_ids(r.text)) for r in rows]
    assert sorted((str(r.doc_id), r.n_0) for r in counted.collect()) == sorted((str(r.doc_id), k) for r, k in zip(rows, n))
    root = new_path(spark, "rollup")
    assert rollups.totals(spark, root).count() == 0
    change = lambda old, new, rows=counted: rows.select("source", "lang", F.lit("t").alias("tokenizer"), F.lit(old).cast("long").alias("old_tokens"), F.lit(new).cast("long").alias("new_tokens"))
    key = lambda r: (r.source, r.lang)
    read = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollups.totals(spark, root).collect()}
    assert rollups.commit(change(None, F.col("n_0")), root, "load")
    assert read() == plain_totals(map(key, rows), n)
    assert not rollups.commit(change(None, F.col("n_0")), root, "load")
    assert read() == plain_totals(map(key, rows), n)
    assert rollups.commit(change(F.col("n_0"), F.col("n_0") + 1), root, "revise")
    gone = counted.filter("doc_id < 20")
    assert rollups.commit(change(F.col("n_0") + 1, None, gone), root, "delete")
    left = [(key(r), k + 1) for r, k in zip(rows, n) if r.doc_id is None or r.doc_id >= 20]
    assert read() == plain_totals([k for k, _ in left], [k for _, k in left])
    assert rollups.commit(change(None, F.col("n_0"), rollups.token_counts(nothing, names)), root, "empty")
    assert read() == plain_totals([k for k, _ in left], [k for _, k in left])


WEIGHTS = {"good": 0.9, "low": 0.05, "toxic": 0.05}


def test_posteriors_and_rates(spark, corpus, nothing, labels):
    got = mixing.mixing_rates(corpus, labels, WEIGHTS).collect()
    assert len(got) == corpus.count()
    for r in got:
        assert abs(r.p_good + r.p_low + r.p_toxic - 1) < 1e-9 and r.rate >= 0 and abs(r.copies - r.rate) <= 1
        assert r.tokens >= 0
    tokens = {r.doc_id: len((r.text or "").split()) for r in corpus.collect()}
    assert all(r.tokens == tokens[r.doc_id] for r in got if r.doc_id is not None)
    assert mixing.mixing_rates(nothing, labels, WEIGHTS).count() == 0
    alone = mixing.mixing_rates(corpus, labels.limit(0), WEIGHTS).collect()
    assert all(r.p_good == 1 and r.rate == pytest.approx(1, abs=1e-3) for r in alone)


def test_naive_bayes_is_that_of_the_formula(spark):
    import math

    rows = [(k, "bad bad word" if k % 3 == 0 else "fine word", "x") for k in range(60)] + [(60, "bad fine", "x"), (61, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    labelled = spark.createDataFrame([(k, "toxic" if k % 3 == 0 else "good") for k in range(60)], "doc_id long, domain string")
    got = {r.doc_id: r for r in mixing.posteriors(docs, labelled, list(WEIGHTS)).collect()}
    # Every document has "word", so it is no evidence and no feature.
    have = {"good": {"fine": 40}, "toxic": {"bad": 20}}
    size = {"good": 40, "toxic": 20}

    def score(d, words):
        return math.log(size[d] / 60) + sum(math.log((have[d].get(w, 0) + 0.5) / (size[d] + 1)) for w in words)

    for doc_id, text, _ in rows:
        words = {"fine", "bad"} & set((text or "").split())
        s = {d: math.exp(score(d, words)) for d in size}
        assert got[doc_id].p_toxic == pytest.approx(s["toxic"] / sum(s.values()))
        assert got[doc_id].p_low == 0


@pytest.mark.parametrize("broadcast", [200_000, 10])
def test_every_word_with_evidence_is_a_feature(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_WORDS", broadcast)
    rows = [(k, f" word w{k // 8} ") for k in range(800)] + [(k, "word") for k in range(800, 3200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(k, "low" if k < 800 else "good") for k, _ in rows], "doc_id long, domain string")
    got = mixing.posteriors(docs, labelled, ["good", "low"]).collect()
    assert len(got) == len(rows) and all(r.tokens == (2 if r.doc_id < 800 else 1) for r in got)
    assert all(r.p_low == pytest.approx(1 / (1 + 3 * (0.5 / 2401) / (8.5 / 801))) for r in got if r.doc_id < 800)
    assert all(r.p_low == pytest.approx(0.25) for r in got if r.doc_id >= 800)


def test_rates_meet_targets(spark):
    from pyspark.sql import functions as F

    base = spark.range(1000).select((F.col("id") % 50 + 1).alias("tokens"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("p_a"))
    members = base.withColumn("p_b", 1 - F.col("p_a"))
    for share in (0.3, 0.5, 0.7):
        got = mixing.rates(members, {"a": share, "b": 1 - share}, total_tokens=10_000.0)
        a, b = got.agg(F.sum(F.expr("rate * tokens * p_a")), F.sum(F.expr("rate * tokens * p_b"))).first()
        assert a == pytest.approx(10_000 * share, abs=2) and b == pytest.approx(10_000 * (1 - share), abs=2)
        assert got.filter("rate < 0").count() == 0
    bounded = mixing.rates(members, {"a": 0.9, "b": 0.1}, max_rate=1.0)
    assert bounded.filter("rate < 0 OR rate > 1").count() == 0
    for share in (0.3, 0.8):
        bounded = mixing.rates(members, {"a": share, "b": 1 - share}, max_rate=1.0)
        a, b = bounded.agg(F.sum(F.expr("rate * tokens * p_a")), F.sum(F.expr("rate * tokens * p_b"))).first()
        assert a / (a + b) == pytest.approx(share, abs=0.001)
        assert bounded.filter("rate < 0 OR rate > 1").count() == 0
    # No document has less than 0.4 of b: the total may not fall to nothing for it.
    even = base.select("tokens", F.lit(0.6).alias("p_a"), F.lit(0.4).alias("p_b"))
    kept = mixing.rates(even, {"a": 0.99, "b": 0.01}, max_rate=1.0).agg(F.avg("rate")).first()[0]
    assert 0.1 < kept <= 1


def test_names_that_clash_with_the_copies(spark, corpus, labels):
    from pyspark.sql import functions as F

    docs = corpus.withColumn("_copies", F.lit(7)).withColumn("_Copy", F.lit("x"))
    drawn = mixing.mixed(docs, labels, {"good": 0.2, "low": 0.4, "toxic": 0.4})
    assert drawn.columns == docs.columns and drawn.filter("_copies != 7 OR _Copy != 'x'").count() == 0


def test_drawn_documents(spark, corpus, labels):
    drawn = mixing.mixed(corpus, labels, WEIGHTS)
    copies = {r.doc_id: r.copies for r in mixing.mixing_rates(corpus, labels, WEIGHTS).collect()}
    got = Counter(r.doc_id for r in drawn.collect())
    rows = Counter(r.doc_id for r in corpus.collect())
    assert drawn.columns == corpus.columns
    assert all(got[k] == copies[k] * n for k, n in rows.items() if k is not None)
    assert got[None] == rows[None]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.written(out, name)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.3 * seen[0]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = [" ".join(t.split()) for _, t in rows]
    assert len(set(texts)) == len(texts)
    check_packing(rows, corpus_pipeline.run(spark, folder).collect(), 1024)


def test_pipeline_without_documents(spark, nothing, tmp_path):
    import corpus_pipeline

    nothing.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
