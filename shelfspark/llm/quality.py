"""Quality classifier: interpolated modified Kneser-Ney over characters.

A trigram model per language is trained on trusted text. Counts, continuation counts,
discounts and back-off weights are grouped sums. Documents are scored by a sharded count
join: per chunk of documents, each distinct trigram is one row with the documents that
hold it and how often; chunks meet the shard of the model that holds a trigram's middle
character, which its context and both lower orders share, and give each document a
partial log probability per shard. A document is rejected when its log perplexity lies
far from the median of the trusted documents of its language, in units of their median
deviation, which grows for short texts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import among, in_parts, text_or_empty, without
from shelfspark.session import written

#: Documents in a chunk (at most 65,536) and distinct (document, trigram) pairs that end one early.
CHUNK_DOCS, CHUNK_PAIRS = 4096, 1_500_000
#: Documents whose chunks meet one copy of a model shard, and shards of the model.
GROUP_DOCS, SHARDS = 32_768, 16
#: Languages with fewer trusted characters use the model of all trusted text.
LANGUAGE_CHARS = 20_000
#: Deviations from the median of log perplexity that a document may have, and a least deviation.
SPREAD, LEAST_DEVIATION = 5.0, 0.01
#: Fewer different texts are too few to take a median and deviations from.
LEAST_REFERENCES = 50
#: Median deviations times this are standard deviations of a normal distribution.
NORMAL = 1.4826
POOLED = "*"
START, END = 2, 3
SEGMENT = 1_000_000


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that are labelled of good quality, never of bad and never toxic.

    ``labels`` may have no column ``toxic``; a null in it says nothing.
    """
    toxic = F.col("toxic") if "toxic" in labels.columns else F.lit(0)
    return (
        labels.filter("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce(toxic, F.lit(0))).alias("toxic"))
        .filter("quality = 1 AND toxic = 0")
        .select("doc_id")
    )


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        text_or_empty(text_col).alias("text"),
    )


def model(trusted: DataFrame) -> DataFrame:
    """The model of rows ``lang, text``: ``lang, kind, a, b, c, value``.

    Kind 3 holds probabilities of trigrams a b c, kind 2 back-off weights of contexts
    a b, kind 1 probabilities of c after b, kind 0 back-off weights of b, kind -1
    probabilities of c alone; kind -2 that of a character never seen. Language
    ``*`` is all text together; others need ``LANGUAGE_CHARS`` characters.
    """
    counts = trusted.select("lang", "text").mapInArrow(_train, "lang string, code long, n long")
    counts = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = written(counts, "trigrams")
    pooled = counts.groupBy(F.lit(POOLED).alias("lang"), "code").agg(F.sum("n").alias("n"))
    large = counts.groupBy("lang").agg(F.sum("n").alias("chars")).filter(
        (F.col("chars") >= LANGUAGE_CHARS) & (F.col("lang") != POOLED)
    )
    own = counts.join(F.broadcast(large.select("lang")), "lang")  # a row per language
    char = (1 << 21) - 1
    three = written(
        own.unionByName(pooled).select(
            "lang",
            F.shiftright("code", 42).alias("a"),
            F.shiftright("code", 21).bitwiseAND(F.lit(char)).alias("b"),
            F.col("code").bitwiseAND(F.lit(char)).alias("c"),
            "n",
        ),
        "trigrams",
    )
    two = three.groupBy("lang", "b", "c").agg(F.count("*").alias("n"))
    two = written(two, "bigrams")
    one = written(two.groupBy("lang", "c").agg(F.count("*").alias("n")), "characters")
    p1, _ = _level(one, ["lang"])
    size = Window.partitionBy("lang")
    p1 = p1.withColumn("flat", F.col("weight") / (F.count("*").over(size) + 1))
    p1 = p1.select("lang", "c", (F.col("own") + F.col("flat")).alias("p"), "flat")
    p1 = written(p1, "p1")
    two_, g2 = _level(two, ["lang", "b"])
    p2 = two_.join(p1, ["lang", "c"]).select(
        "lang", "b", "c", (F.col("own") + F.col("weight") * F.col("p")).alias("p")
    )
    p2 = written(p2, "p2")
    three_, g3 = _level(three, ["lang", "a", "b"])
    p3 = three_.join(p2, ["lang", "b", "c"]).select(
        "lang", "a", "b", "c", (F.col("own") + F.col("weight") * F.col("p")).alias("p")
    )

    def part(rows: DataFrame, kind: int, value: str) -> DataFrame:
        return rows.select(
            "lang",
            F.lit(kind).alias("kind"),
            *[
                (F.col(x) if x in rows.columns else F.lit(0)).cast("long").alias(x)
                for x in ("a", "b", "c")
            ],
            F.col(value).alias("value"),
        )

    unseen = p1.groupBy("lang").agg(F.first("flat").alias("flat"))
    parts = [part(p3, 3, "p"), part(g3, 2, "weight"), part(p2, 1, "p"), part(g2, 0, "weight")]
    parts += [part(p1, -1, "p"), part(unseen, -2, "flat")]
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return written(result, "model")


def _level(rows: DataFrame, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """Discounted shares (``own``) with their context's back-off ``weight``; and the weights.

    Counts of counts of a language set its three discounts.
    """
    of = rows.groupBy("lang").agg(
        *[F.sum((F.col("n") == k).cast("double")).alias(f"t{k}") for k in (1, 2, 3, 4)]
    )
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))

    def discount(k: int) -> Column:
        usual = k - (k + 1) * y * F.try_divide(F.col(f"t{k + 1}"), F.col(f"t{k}"))
        fine = (F.col("t1") > 0) & (F.col("t2") > 0) & (F.col(f"t{k}") > 0)
        return F.when(fine & usual.between(0.05, k), usual).otherwise(k - 0.5).alias(f"d{k}")

    of = of.select("lang", discount(1), discount(2), discount(3))
    rows = rows.join(F.broadcast(of), "lang")  # a row per language
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    weights = rows.groupBy(*context).agg(
        (F.sum(cut) / F.sum("n")).alias("weight"), F.sum("n").alias("all")
    )
    shares = rows.join(weights, context).withColumn("own", (F.col("n") - cut) / F.col("all"))
    return shares, weights.drop("all")


def perplexities(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``doc_id, lang, n_chars, log_prob, perplexity`` of every row of ``docs``.

    Perplexity is per character and the end of the text. A null text is empty and
    has a perplexity of null, as have all where no text is trusted.
    """
    rows = _rows(docs, id_col, text_col, lang_col)
    good = written(trusted_ids(labels), "trusted")
    trusted = among(rows, good, "doc_id")
    table = model(trusted)
    languages = [r.lang for r in table.filter("kind = -2").select("lang").collect()]
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    postings = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.when(F.col("lang").isin(languages) & (F.col("lang") != POOLED), F.col("lang"))
        .otherwise(POOLED)
        .alias("use"),
        "lang",
        "text",
    ).mapInArrow(
        _chunks(groups),
        "shard int, grp long, use string, code long, base long, docs binary, times binary, "
        "row long, doc_id long, lang string, n_chars long",
    )
    everywhere = F.array(*[F.lit(k) for k in range(SHARDS)])
    shard = F.when(F.col("kind") < 0, everywhere).otherwise(
        F.array(F.pmod(F.col("b"), F.lit(SHARDS)).cast("int"))
    )
    sharded = table.withColumn("shard", F.explode(shard)).withColumn(
        "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    )
    parts = (
        postings.groupBy("shard", "grp")
        .cogroup(sharded.groupBy("shard", "grp"))
        .applyInPandas(
            _score, "row long, log_prob double, doc_id long, lang string, n_chars long"
        )
    )
    sums = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("lang").alias("lang"),
        F.max("n_chars").alias("n_chars"),
        F.sum("log_prob").alias("log_prob"),
    )
    mean = -F.col("log_prob") / (F.col("n_chars") + 1)
    fine = (F.col("n_chars") > 0) & F.lit(bool(languages))
    return sums.select(
        "doc_id", "lang", "n_chars", "log_prob", F.when(fine, F.exp(mean)).alias("perplexity")
    )


def classified(
    docs: DataFrame,
    labels: DataFrame,
    spread: float = SPREAD,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, low, high, keep`` of every row of ``docs``.

    A document is kept between ``low`` and ``high``, both included: the median log
    perplexity of the references of its language, less and plus ``spread`` deviations. A
    deviation is the median one of the references or, if that is more, the median one per
    square root of a character, over the root of the document's own characters, as means of
    few characters vary more. Half of the references would have to be wrong to move either.

    References are the trusted documents of the language, copies once. Where these are fewer
    than ``LEAST_REFERENCES``, all its documents are. Where even they are fewer, the bounds
    reach from its own to the common median, with the larger of its own deviations and those
    of all references from their languages' medians, or those from the common median. A language without a trusted document has the
    bounds around the common median. Empty texts are rejected; where nothing is trusted all
    others are kept.
    """
    scores = written(perplexities(docs, labels, id_col, text_col, lang_col), "scores")
    known = scores.filter("perplexity IS NOT NULL")
    trusted = known.join(trusted_ids(labels), "doc_id", "left_semi")
    trusted = written(_distinct(trusted), "trusted")
    support = trusted.groupBy("lang").agg(F.count("*").alias("n"))
    large = F.col("n") >= LEAST_REFERENCES
    # A row per language.
    enough, few = (F.broadcast(support.filter(x).select("lang")) for x in (large, ~large))
    references = trusted.join(enough, "lang", "left_semi").unionByName(
        _distinct(known.join(few, "lang", "left_semi"))
    )
    references = written(references, "references")
    centres = references.groupBy("lang").agg(F.count("*").alias("n"), _median("x").alias("centre"))
    middle = references.agg(_median("x").alias("x")).first().x
    middle = F.lit(middle).cast("double")
    away = written(references.join(F.broadcast(centres), "lang"), "away")  # a row per language
    by_language = away.groupBy("lang").agg(
        F.first("n").alias("n"), F.first("centre").alias("centre"), *_deviations(F.col("centre"))
    )
    within = [F.lit(x).cast("double") for x in away.agg(*_deviations(F.col("centre"))).first()]
    common = [F.lit(x).cast("double") for x in away.agg(*_deviations(middle)).first()]
    joined = scores.join(F.broadcast(by_language), "lang", "left")  # a row per language
    own = _bounds(F.col("centre"), F.col("flat"), F.col("per_root"), spread)
    larger = [F.greatest(F.col(name), x) for name, x in zip(("flat", "per_root"), within)]
    near = _bounds(F.col("centre"), *larger, spread)
    shared = _bounds(middle, *common, spread)
    low, high = (
        F.when(large, x).when(F.col("n") > 0, reach(y, z)).otherwise(z)
        for x, y, z, reach in zip(own, near, shared, (F.least, F.greatest))
    )
    limits = joined.select(
        "doc_id", "lang", "n_chars", "perplexity", low.alias("low"), high.alias("high")
    )
    inside = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return limits.withColumn("keep", (F.col("n_chars") > 0) & inside)


def _distinct(scores: DataFrame) -> DataFrame:
    """``lang, n_chars, x`` with ``x`` the log perplexity, copies once."""
    return scores.select("lang", "n_chars", F.round(F.log("perplexity"), 9).alias("x")).distinct()


def _median(column: Column | str) -> Column:
    return F.percentile_approx(column, 0.5, 100_000)


def _deviations(centre: Column) -> list[Column]:
    """Median deviations from a centre: ``flat``, and ``per_root`` of a character."""
    away = F.abs(F.col("x") - centre)
    root = F.sqrt(F.col("n_chars") + 1)
    return [
        (NORMAL * _median(away)).alias("flat"),
        (NORMAL * _median(away * root)).alias("per_root"),
    ]


def _bounds(centre: Column, flat: Column, per_root: Column, spread: float) -> tuple[Column, Column]:
    """Perplexities that a document of its length lies between."""
    deviation = F.greatest(flat, per_root / F.sqrt(F.col("n_chars") + 1), F.lit(LEAST_DEVIATION))
    return F.exp(centre - spread * deviation), F.exp(centre + spread * deviation)


def good_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns. Rows without an id stay."""
    verdict = classified(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col)
    gone = written(
        verdict.filter("NOT keep").select(F.col("doc_id").alias(id_col)).distinct(), "rejected"
    )
    return without(docs, gone, id_col)


def _codes(text: str):
    """Trigram codes of a text in segments: 21 bits a character, start and end marked."""
    import numpy as np

    tail = np.array([START, START], np.int64)
    last = (len(text) - 1) // SEGMENT if text else 0
    for k in range(last + 1):
        piece = text[k * SEGMENT : (k + 1) * SEGMENT]
        chars = np.frombuffer(piece.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        chars[(chars >= 9) & (chars <= 13)] = 32
        chars = np.concatenate([tail, chars, np.array([END] * (k == last), np.int64)])
        yield (chars[:-2] << 42) | (chars[1:-1] << 21) | chars[2:]
        tail = chars[-2:]


def _train(batches: Iterator) -> Iterator:
    """Counts of trigrams by language, summed over about a million characters at a time."""
    import numpy as np
    import pyarrow as pa

    def summed(lang: str, held: list):
        codes, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))],
            names=["lang", "code", "n"],
        )

    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for batch in in_parts(batches):
        for lang, text in zip(*(column.to_pylist() for column in batch.columns)):
            for codes in _codes(text):
                held.setdefault(lang, []).append(codes)
                size[lang] = size.get(lang, 0) + len(codes)
            if size[lang] > 4 * SEGMENT:
                yield summed(lang, held.pop(lang))
                size[lang] = 0
    for lang, codes in held.items():
        yield summed(lang, codes)


def _chunks(groups: int):
    def chunks(batches: Iterator) -> Iterator:
        """A row per trigram and chunk, and one per document, for each chunk of documents."""
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        grp = TaskContext.get().partitionId() % groups
        schema = pa.schema(
            [("shard", pa.int32()), ("grp", pa.int64()), ("use", pa.string()), ("code", pa.int64()),
             ("base", pa.int64()), ("docs", pa.binary()), ("times", pa.binary()), ("row", pa.int64()),
             ("doc_id", pa.int64()), ("lang", pa.string()), ("n_chars", pa.int64())]
        )

        def rows(n: int, **columns):
            arrays = [
                pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type)
                for f in schema
            ]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        def closed(heads: list, held: dict):
            n = len(heads)
            ids, docs, langs, sizes = zip(*heads)
            yield rows(
                n, shard=[-1] * n, grp=[grp] * n, row=ids, doc_id=docs, lang=langs, n_chars=sizes
            )
            for use, parts in held.items():
                codes, places, times = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(codes, kind="stable")
                codes, places, times = codes[order], places[order], times[order]
                starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                ends = np.r_[starts[1:], len(codes)].astype(np.int64)
                firsts = codes[starts]
                # Lists as slices of one buffer.
                as_list = lambda a: pa.Array.from_buffers(
                    pa.binary(),
                    len(starts),
                    [None, pa.py_buffer((np.r_[0, ends] * a.itemsize).astype(np.int32)), pa.py_buffer(a)],
                )
                n = len(starts)
                yield rows(
                    n,
                    shard=((firsts >> 21) & ((1 << 21) - 1)) % SHARDS,
                    grp=np.full(n, grp),
                    use=[use] * n,
                    code=firsts,
                    base=np.full(n, ids[0]),
                    docs=as_list(places.astype("<u2")),
                    times=as_list(times.astype(np.uint8)),
                )

        heads, held, pairs = [], {}, 0
        for batch in in_parts(batches):
            for row, doc_id, use, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                place = len(heads)
                heads.append((row, doc_id, lang, len(text)))
                for codes in _codes(text):
                    codes, times = np.unique(codes, return_counts=True)
                    while True:
                        held.setdefault(use, []).append(
                            (codes, np.full(len(codes), place, np.uint16), np.minimum(times, 255))
                        )
                        pairs += len(codes)
                        if not (times > 255).any():
                            break
                        codes, times = codes[times > 255], times[times > 255] - 255
                if len(heads) >= CHUNK_DOCS or pairs >= CHUNK_PAIRS:
                    yield from closed(heads, held)
                    heads, held, pairs = [], {}, 0
        if heads:
            yield from closed(heads, held)

    return chunks


def _score(postings, model):
    """Partial log probabilities of the documents of a group against one shard."""
    import numpy as np
    import pandas as pd

    heads = postings[postings["shard"] < 0]
    if len(heads):
        return heads[["row", "doc_id", "lang", "n_chars"]].assign(log_prob=0.0)[
            ["row", "log_prob", "doc_id", "lang", "n_chars"]
        ]
    out = []
    for use, own in postings.groupby("use"):
        trained = model[model["lang"] == use]

        def lookup(kind: int, keys, wanted):
            rows = trained[trained["kind"] == kind]
            key = keys(rows["a"].to_numpy(), rows["b"].to_numpy(), rows["c"].to_numpy())
            order = np.argsort(key)
            key, value = key[order], rows["value"].to_numpy()[order]
            if not len(key):
                return np.full(len(wanted), np.nan)
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            return np.where(key[at] == wanted, value[at], np.nan)

        code = own["code"].to_numpy()
        ab, bc, char = code >> 21, code & ((1 << 42) - 1), (1 << 21) - 1
        b, c = ab & char, code & char
        unseen = trained.loc[trained["kind"] == -2, "value"]
        flat = unseen.iloc[0] if len(unseen) else 1.0

        def filled(values, otherwise):
            return np.where(np.isnan(values), otherwise, values)

        p1 = filled(lookup(-1, lambda a, b, c: c, c), flat)
        p2 = filled(
            lookup(1, lambda a, b, c: (b << 21) | c, bc), filled(lookup(0, lambda a, b, c: b, b), 1.0) * p1
        )
        p3 = filled(
            lookup(3, lambda a, b, c: (a << 42) | (b << 21) | c, code),
            filled(lookup(2, lambda a, b, c: (a << 21) | b, ab), 1.0) * p2,
        )
        logs = np.log(p3)
        times = np.frombuffer(b"".join(own["times"]), np.uint8)
        places = np.frombuffer(b"".join(own["docs"]), "<u2")
        lengths = own["times"].str.len().to_numpy()
        rows = np.repeat(own["base"].to_numpy(), lengths) + places
        rows, at = np.unique(rows, return_inverse=True)
        sums = np.bincount(at, np.repeat(logs, lengths) * times, len(rows))
        out.append(pd.DataFrame({"row": rows, "log_prob": sums}))
    result = pd.concat(out) if out else pd.DataFrame({"row": [], "log_prob": []})
    return result.assign(doc_id=None, lang=None, n_chars=None).astype(
        {"row": "int64", "doc_id": "Int64", "n_chars": "Int64"}
    )
