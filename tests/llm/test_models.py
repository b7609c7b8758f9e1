import math
import random
import re
import zlib

import numpy as np
import pytest

from shelfspark.llm import hmm, langid, neighbours, quality


def test_language_of_texts(spark, corpus, nothing):
    chance = random.Random(5)
    syllables = {"aa": ["an", "ter", "ou", "the"], "bb": ["zu", "sch", "ein", "och"]}
    prose = lambda l, n: " ".join("".join(chance.choices(syllables[l], k=2)) for _ in range(n))
    rows = [(k, prose(l, 40), l) for k, l in enumerate(["aa", "bb"] * 20)]
    automata = langid.learnt(spark.createDataFrame([*rows, (99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string"))
    assert [a[0] for a in automata] == ["aa", "bb"]
    ask = [(0, prose("aa", 3)), (1, prose("bb", 2000)), (2, None), (3, "12 !? \n"), (4, ""), (5, "ЖЖЖ"), (0, prose("bb", 3))]
    got = langid.identified(spark.createDataFrame(ask, "doc_id long, text string"), automata).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == [(0, "aa"), (0, "bb"), (1, "bb"), (2, "und"), (3, "und"), (4, "und"), (5, "aa")]
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identified(corpus, []).collect()} == {"und"}
    assert langid.identified(nothing, automata).count() == 0 and langid.learnt(nothing) == []
    assert langid.identified(corpus, automata).count() == corpus.count()


def test_a_language_is_learnt_from_behind_a_foreign_header(spark):
    chance = random.Random(8)
    bits = {"aa": ["an", "ter", "ou", "the"], "bb": ["zu", "sch", "ein", "och"]}
    prose = lambda l, n: " ".join("".join(chance.choices(bits[l], k=2)) for _ in range(n))
    header = {"aa": prose("bb", 100), "bb": prose("aa", 100)}
    rows = [(k, f"{header[l]}\n{prose(l, 400)}", l) for k, l in enumerate(["aa", "bb"] * 20)]
    automata = langid.learnt(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(length <= 120 * 404 for _, length, _ in automata)
    ask = [(k, prose("aa" if k < 10 else "bb", 30)) for k in range(20)]
    got = langid.identified(spark.createDataFrame(ask, "doc_id long, text string"), automata).collect()
    assert all(r.lang_pred == ("aa" if r.doc_id < 10 else "bb") for r in got)


def test_phrases_are_longest_matches(spark):
    import pandas as pd

    training = "abra cadabra abracadabra"
    edges = langid._automaton(pd.DataFrame({"lang": ["x"], "doc_id": [1], "text": [training]}))
    parser = langid._Parser([("x", int(edges["length"][0]), edges["edges"][0])])
    chance = random.Random(6)
    for _ in range(100):
        text = "".join(chance.choices("abrcdz ", k=30)).strip() or "a"
        text = " ".join(text.split())
        at, expected = 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and text[at : at + n + 1] in training:
                n += 1
            at, expected = at + n, expected + 1
        chars, lengths = langid._code_points([text])
        got = parser.phrases(parser.symbol[chars], np.zeros(lengths[0], int), 1)
        assert got.tolist() == [[expected]]


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over character trigrams, as the formulas have it."""
    from collections import Counter

    grams = Counter()
    for t in texts:
        s = "\x02\x02" + t + "\x03"
        grams.update(s[i : i + 3] for i in range(len(s) - 2))
    two = Counter(g[1:] for g in grams)
    one = Counter(g[1:] for g in two)

    def discounts(counts):
        t = [sum(v == k for v in counts.values()) for k in range(5)]
        out = []
        for k in (1, 2, 3):
            d = k - 0.5
            if t[1] and t[2] and t[k]:
                x = k - (k + 1) * t[1] / (t[1] + 2 * t[2]) * t[k + 1] / t[k]
                d = x if 0.05 <= x <= k else d
            out.append(d)
        return lambda c: out[min(c, 3) - 1]

    tables = [(grams, discounts(grams)), (two, discounts(two)), (one, discounts(one))]

    def p(gram):
        counts, d = tables[3 - len(gram)] if gram else (None, None)
        if not gram:
            return 1 / (len(one) + 1)
        own = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        c = own.get(gram, 0)
        return (c - d(c) if c else 0) / total + sum(map(d, own.values())) / total * p(gram[1:])

    def log_prob(text):
        s = "\x02\x02" + text + "\x03"
        return sum(math.log(p(s[i : i + 3])) for i in range(len(s) - 2))

    return log_prob


def test_perplexity_is_that_of_the_formulas(spark):
    chance = random.Random(7)
    texts = ["".join(chance.choices("aabbc de", k=chance.randint(1, 60))) for _ in range(30)]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(50, "zz aa", "fr"), (51, "", "en"), (52, None, None), (53, "a" * 1500, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(20)] + [(19, 0), (None, 1)], "doc_id long, quality int")
    log_prob = plain_kneser_ney(texts[:19])
    got = {r.doc_id: r for r in quality.perplexities(docs, labels).collect()}
    assert set(got) == {r[0] for r in rows}
    for doc_id, text, _ in rows:
        if text:
            assert got[doc_id].perplexity == pytest.approx(math.exp(-log_prob(text) / (len(text) + 1)), rel=1e-9)
        else:
            assert got[doc_id].perplexity is None


def test_classifier_on_odd_rows(corpus, nothing, labels):
    got = quality.classified(corpus, labels).collect()
    assert len(got) == corpus.count()
    assert not any(r.keep for r in got if not r.n_chars)
    assert quality.good_quality(corpus, labels).columns == corpus.columns
    assert quality.classified(nothing, labels).count() == 0
    unlabelled = quality.classified(corpus, labels.limit(0)).collect()
    assert all(r.keep == (r.n_chars > 0) for r in unlabelled)


def syllables(chance, alphabet, n):
    return " ".join("".join(chance.choices(alphabet, k=chance.randint(1, 3))) for _ in range(n))


def test_planted_bad_documents_go_and_clean_ones_stay(spark):
    chance = random.Random(11)
    alphabet = ["an", "ter", "ou", "the", "is", "re", "and", "lo", "mi", "ka"]
    clean = [syllables(chance, alphabet, chance.choice([8, 40, 200])) for _ in range(300)]
    # Symbols after some of the words: worse than any clean text, better than the wrongly trusted junk.
    bad = [re.sub(r" ", lambda m: "# " if chance.random() < 0.3 else " ", syllables(chance, alphabet, 100)) for _ in range(20)]
    junk = ["".join(chance.choices("#$%&*+=@", k=200)) for _ in range(3)]
    rows = [*enumerate(clean), *enumerate(bad, 1000), *enumerate(junk, 2000)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string")
    labels = [(k, 1, 0) for k in range(200)] + [(2000 + k, 1, 0) for k in range(3)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    keep = {r.doc_id: r.keep for r in quality.classified(docs, labels).collect()}
    assert not any(keep[1000 + k] for k in range(20))
    assert sum(not keep[k] for k in range(300)) <= 3


@pytest.mark.parametrize("trusted", [1, 3])
def test_a_language_with_few_trusted_documents(spark, trusted):
    chance = random.Random(13)
    alphabets = {"en": ["an", "ter", "ou", "the", "is"], "el": ["αν", "τε", "ου", "και"], "da": ["an", "te", "ou", "æg"]}
    sizes = {"en": 120, "el": 60, "da": 12}
    rows = [
        (1000 * j + k, syllables(chance, alphabets[lang], 80), lang)
        for j, (lang, n) in enumerate(sizes.items())
        for k in range(n)
    ]
    bad = [(5000 + k, "".join(chance.choices("#$%&*+=@", k=200)), lang) for k, lang in enumerate(["en", "el", "da"] * 2)]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    labels = [(k, 1, 0) for k in range(100)] + [(1000 * j + k, 1, 0) for j in (1, 2) for k in range(trusted)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classified(docs, labels).collect()}
    for lang, n in sizes.items():
        assert sum(not r.keep for r in got.values() if r.lang == lang and r.doc_id < 5000) <= 0.05 * n
    assert not any(r.keep for r in got.values() if r.doc_id >= 5000)


def test_toxic_documents_are_not_trusted(spark):
    labels = [(1, 1, 0), (2, 1, 1), (3, 1, None), (4, 1, 0), (4, None, 1), (5, 0, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality.trusted_ids(labels).collect()} == {1, 3}


def plain_forward(symbols, start, move, emit):
    total, alpha = 0.0, start
    for t, s in enumerate(symbols):
        a = (alpha if t == 0 else alpha @ move) * emit[s]
        total += math.log10(a.sum())
        alpha = a / a.sum()
    return total


def test_base_score_and_counts(spark, corpus, nothing):
    rows = corpus.collect()
    crc = lambda r: zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"")
    from collections import Counter

    tokens = [[*(r.text or "").encode().lower().split(), None] for r in rows]
    counts = Counter(w for r, t in zip(rows, tokens) if crc(r) % 10 for w in t)
    # A null id counts as empty text, whose crc is zero: held out.
    n, v = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t) for t in tokens]
    expected = sorted((str(r.doc_id), crc(r) % 10 == 0, len(t), sum(counts[w] > 0 for w in t), n, round(b, 6)) for r, t, b in zip(rows, tokens, base))
    got = hmm.scored(corpus, langid.fold("doc_id", 10) == 0).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 for r in got)
    assert hmm.scored(nothing, langid.fold("doc_id", 10) == 0).count() == 0
    untrained = hmm.scored(corpus, langid.fold("doc_id", 1) == 0).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 for r in untrained)


def test_training_raises_the_likelihood_and_scores_are_forward_sums(spark):
    chance = np.random.default_rng(8)
    sequences = [np.r_[chance.integers(0, 4, 40) + 4 * (k % 2), 8] for k in range(60)]
    rows = [(k, s.astype("<u2").tobytes()) for k, s in enumerate(sequences)]
    encoded = spark.createDataFrame(rows, "row long, symbols binary")
    counts = np.bincount(np.concatenate(sequences), minlength=9).tolist()
    totals = []
    for rounds in (0, 1, 3, 8):
        model = hmm.train(encoded, counts, 3, rounds)
        shared = spark.sparkContext.broadcast(model)
        got = encoded.mapInArrow(hmm._forward(shared), "row long, path_log double").collect()
        for r in got[:5]:
            assert r.path_log == pytest.approx(plain_forward(sequences[r.row], *model))
        totals.append(sum(r.path_log for r in got))
    assert totals == sorted(totals) and totals[-1] > totals[0] + 100


def brute(rows, queries, k):
    out = []
    for q, x in queries:
        hits = []
        for v, y in rows:
            if v != q:
                x_, y_ = np.array(x, float), np.array(y, float)
                hits.append((-(x_ @ y_) / math.sqrt((x_ @ x_) * (y_ @ y_)), v))
        out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(sorted(hits)[:k])]
    return out


def test_neighbours_are_those_of_brute_force(spark):
    chance = np.random.default_rng(9)
    vectors = chance.normal(size=(700, 8)).round(3)
    vectors[100:200] = vectors[50]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, [None] * 8), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    valid = neighbours.valid_vectors(table)
    assert valid.count() == 700
    queries = valid.filter("vec_id % 50 = 0")
    expected = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    for shard_rows in (10_000, 200):
        got = neighbours.nearest(valid, queries, shard_rows=shard_rows, leaf_rows=16)
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())
        # Cosines of equal vectors may differ in the last digit where each is summed in another way.
        assert [g[:3] for g in got] == [e[:3] for e in expected]
        assert all(abs(g[3] - e[3]) < 1e-12 for g, e in zip(got, expected))
    relaxed = neighbours.nearest(valid, queries, relax=1.5, leaf_rows=16)
    found = {(r.query_id, r.vec_id) for r in relaxed.collect()}
    assert len(found & {(e[0], e[2]) for e in expected}) >= 0.5 * len(expected)


def test_ties_of_parallel_vectors_go_to_the_smaller_ids(spark):
    """Equal scores beyond the number of neighbours, over one shard and several, and powers of two as factors."""
    rows = [(k, [float(2 ** (k * 17 % 23)), 0.0, 0.0]) for k in range(41)] + [(k, [1.0, k / 50, 1.0]) for k in range(41, 300)]
    table = neighbours.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for shard_rows in (10_000, 20):
        got = neighbours.nearest(table, table.filter("vec_id in (0, 40)"), shard_rows=shard_rows, leaf_rows=4).collect()
        found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
        assert found == [(0, k, k, 1.0) for k in range(1, 6)] + [(40, k + 1, k, 1.0) for k in range(5)]


def test_repeated_ids_and_other_widths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.2]), (2, [0.0, 1.0]), (3, [1.0]), (4, [1.0, 1.0, 1.0]), (5, [1.0, 0.9])]
    table = neighbours.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = neighbours.nearest(table, table.filter("vec_id in (1, 3)")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 5), (1, 2, 2)]
    assert got[1].score == 0.0


def test_few_or_no_vectors(spark):
    table = neighbours.valid_vectors(spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>"))
    got = neighbours.nearest(table, table.filter("vec_id = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 7)]
    assert neighbours.nearest(table.limit(0), table).count() == 0 == neighbours.nearest(table, table.limit(0)).count()
