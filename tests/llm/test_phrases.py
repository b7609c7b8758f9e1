import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfspark.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase long, f long, a long, rank int"


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def plain_counts(rows):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for words in pieces(text):
            for n in (1, 2, 3):
                for at in range(len(words) - n + 1):
                    counts[lang or "und"][" ".join(words[at : at + n])] += 1
            if words:
                counts[lang or "und"][""] += len(words)
    return counts


def plain_collocations(rows, least, most):
    out = []
    for lang, f in plain_counts(rows).items():
        found = {p: n for p, n in f.items() if p.count(" ") and n >= least}
        best = []
        for phrase, a in found.items():
            words = phrase.split(" ")
            cuts = []
            for k in range(1, len(words)):
                left, right = f[" ".join(words[:k])], f[" ".join(words[k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            longer = [n for p, n in found.items() if p != phrase and f" {phrase} " in f" {p} "]
            if not any(100 * n >= 50 * a for n in longer):
                score, _, left, right = min(cuts)
                best.append((-score, -a, phrase.encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, f[""], -score))
    return sorted(out)


def invented(n=400):
    """Texts of few words, so that phrases repeat, with odd separators, case and white space."""
    chance = random.Random(9)
    words = ["New", "york", "the", "cat", "É", "é", "straße", "İ", "k" * 3000, "a_b", "-", "\x00", " ", "x\xa0y"] * 3
    words += [f"w{k}" for k in range(30)]
    seps = [" "] * 12 + ["\t", "  ", ". ", ", ", "\n", "\x0b", "!", " ?"]
    rows = []
    for k in range(n):
        text = "".join(chance.choice(words) + chance.choice(seps) for _ in range(chance.randint(0, 60)))
        rows.append((k, text + "new york city " * chance.randint(0, 2), chance.choice(["en", "de", None]), 1, 2, 3, 4))
    rows += [(None, None, None, 1, 2, 3, 4), (1, "", "", 1, 2, 3, 4), (1, "the cat sat. " * 5000, "en", 1, 2, 3, 4)]
    return rows


@pytest.mark.parametrize("held,words", [(phrases.HELD, phrases.WORDS), (50, 1000), (1000, 20)])
@pytest.mark.parametrize("least", [1, 4])
def test_counts_equal_plain_version(spark, held, words, least):
    """Also where subtrees, or all words, leave after every part of the rows."""
    rows = invented()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = phrases.phrase_counts(docs, least, held=held, words=words).collect()
    expected = {
        (lang, p, n)
        for lang, f in plain_counts([r[1:3] for r in rows]).items()
        for p, n in f.items()
        if n >= least or not p
    }
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_tries_that_burst():
    """Containers of first words and prefixes of two, in memory and when the largest leave."""
    chance = random.Random(1)
    trie, whole = phrases.Trie(burst=40), Counter()
    for _ in range(40):
        ids = [min(int(chance.paretovariate(0.7)), 50) + 1 if chance.random() < 0.9 else 0 for _ in range(300)]
        keys = phrases.phrases_at(np.array(ids + [0]))
        trie.add(keys)
        whole.update(keys.tolist())
        plain = [tuple(x) for x in zip(ids, [*ids[1:], 0], [*ids[2:], 0, 0]) if x[0] > 1]
        plain = [(a, b, c if b else 0) for a, b, c in plain]
        if 1 not in ids:
            assert [(k >> 42, k >> 21 & phrases.LOW, k & phrases.LOW) for k in keys.tolist()] == plain
    assert len(trie.words) and len(trie.pairs) and sum(trie.boxes, Counter()) == whole
    size = trie.size()
    gone = trie.largest(size // 2)
    assert 0 < trie.size() < size and sum([*gone, *trie.boxes], Counter()) == whole


def test_packed_runs():
    chance = np.random.default_rng(3)
    columns = np.sort(chance.integers(0, 2**21, (3, 1000)), axis=1)
    counts = chance.integers(1, 2**40, 1000)
    assert all((x == y).all() for x, y in zip([*columns, counts], phrases.unpack(phrases.pack(columns, counts))))


@pytest.mark.parametrize("least,most", [(10, 2000), (3, 15)])
def test_collocations_equal_plain_version(spark, least, most):
    rows = invented()
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least, most).collect()
    expected = plain_collocations([r[1:3] for r in rows], least, most)
    assert sorted(map(tuple, got)) == expected and len(expected) > 20


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 10**14 - 3, 3 * 10**14 + 1, 10**14 + 7
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert row.select(phrases._score()).first()[0] == 10**6 * a * a // (left * right)


def test_nothing(nothing):
    assert phrases.collocations(nothing.select("doc_id", "text", "lang")).count() == 0
