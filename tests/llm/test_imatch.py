import hashlib
import re
from collections import Counter

import xxhash

from shelfspark.llm import imatch
from shelfspark.llm.queries import op12_document_fingerprints

LOW64 = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & LOW64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & LOW64
    return x ^ (x >> 31)


def plain_terms(text):
    return set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower()))


def plain_lexicon(texts):
    counts = Counter(term for text in texts for term in plain_terms(text))
    most = imatch.MOST_SHARE * len(texts)
    return {t for t, n in counts.items() if max(2, imatch.LEAST_SHARE * len(texts)) <= n <= most}


def plain_print(text, lexicon):
    """One subset after the other: membership by a salted hash, then the hash of the sorted terms."""
    hashed = {term: xxhash.xxh64_intdigest(term, seed=42) for term in plain_terms(text)}
    inside = sorted(h for term, h in hashed.items() if term in lexicon)
    out, number = [], 0
    if not inside:
        data = b"".join(h.to_bytes(8, "little") for h in sorted(hashed.values())) or text.encode()
        return [xxhash.xxh64_intdigest(data) % 65535 + 1] * (len(imatch.RATES) * imatch.SUBSETS)
    for rate in imatch.RATES:
        for _ in range(imatch.SUBSETS):
            number += 1
            salt = mixed(number * 0x9E3779B97F4A7C15 & LOW64)
            chosen = [h for h in inside if mixed(h ^ salt) >> (64 - rate) == 0]
            data = b"".join(h.to_bytes(8, "little") for h in chosen)
            out.append(xxhash.xxh64_intdigest(data) % 65535 + 1 if chosen else 0)
    return out


def plain_likeness(a, b):
    rates = []
    for at in range(0, len(a), imatch.SUBSETS):
        pairs = [(x, y) for x, y in zip(a[at : at + imatch.SUBSETS], b[at : at + imatch.SUBSETS]) if x or y]
        rates.append((len(pairs), sum(x == y for x, y in pairs)))
    most = max(n for n, _ in rates)
    return max(same / n for n, same in rates if n and n >= min(imatch.TELLING, most))


def numbers(binary):
    return [int.from_bytes(binary[i : i + 2], "little") for i in range(0, len(binary), 2)]


def test_fingerprints_equal_plain_version(corpus):
    rows = corpus.collect()
    texts = [r.text or "" for r in rows]
    lexicon = plain_lexicon(texts)
    words = imatch.lexicon(corpus)
    assert len(words) == 8 * len(lexicon) > 800
    got = imatch.fingerprinted(corpus, words).collect()
    expected = [(r.doc_id, plain_print(r.text or "", lexicon)) for r in rows]
    found = [(r.doc_id, numbers(r.fingerprint)) for r in got]
    by = lambda row: (str(row[0]), row[1])
    assert sorted(found, key=by) == sorted(expected, key=by)


def test_compared_equals_plain_version(corpus):
    lexicon = plain_lexicon([r.text or "" for r in corpus.collect()])
    rows = [(r.doc_id, r.text or "") for r in corpus.collect()]
    signed = lambda text: xxhash.xxh64_intdigest(text, seed=42) - (1 << 64) * (xxhash.xxh64_intdigest(text, seed=42) >> 63)
    rows.sort(key=lambda row: (row[0] is not None, row[0] or 0, signed(row[1])))
    expected = []
    for at, (doc_id, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        one, two, three = (plain_print(x, lexicon) for x in (text, edited, after))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        expected.append((doc_id, len(text), sha, one, two, plain_likeness(one, two), plain_likeness(one, three)))
    got = imatch.compared_with_next(corpus, imatch.lexicon(corpus))
    found = [
        (r.doc_id, r.n_chars, r.edited_sha256, numbers(r.fingerprint), numbers(r.edited_fingerprint), r.near_edited, r.near_next)
        for r in got.collect()
    ]
    by = lambda row: (str(row[0]), row[1:5])
    assert sorted(found, key=by) == sorted(expected, key=by)


def test_bounded_lexicon_keeps_frequent_terms(spark):
    texts = [(k, " ".join(f"w{j}" for j in range(100) if k % (j + 2) == 0)) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    whole = len(imatch.lexicon(docs, most_share=0.9)) // 8
    fewer = len(imatch.lexicon(docs, most_share=0.9, most_terms=30)) // 8
    assert fewer <= 30 < whole


def test_nothing_and_a_single_document(spark, nothing):
    words = imatch.lexicon(nothing)
    assert words == b"" and imatch.compared_with_next(nothing, words).count() == 0
    one = spark.createDataFrame([(5, "ab cd ef gh")], "doc_id long, text string")
    (row,) = imatch.compared_with_next(one, imatch.lexicon(one)).collect()
    assert row.near_next == 1 and row.edited_sha256 == hashlib.sha256(b"ab cd ef ab").hexdigest()


def test_edited_texts_are_near_and_next_ones_are_not(spark):
    folder = "/root/testdata/sf0.001"
    rows = op12_document_fingerprints(spark, folder).collect()
    near = [r.near_edited for r in rows]
    assert sum(near) / len(near) > 0.4 and sum(r.near_next for r in rows) / len(rows) < 0.1
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)
