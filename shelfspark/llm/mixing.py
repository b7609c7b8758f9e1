"""Mixing sources to target weights, with soft membership of documents in domains.

A naive Bayes classifier learnt from a labelled table gives each document a posterior
over domains. Nonnegative rates per document are fitted by projected gradient least
squares, so that the expected tokens of each domain (rate x tokens x posterior) match its
target. All of it is DataFrame work; only sums by domain reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import BROADCAST_IDS, free_name, text_or_empty, without
from shelfspark.session import written

#: About so many labelled rows train the classifier, chosen by a hash of their id.
SAMPLE_ROWS = 20_000
#: So many of the commonest features are broadcast (about 100 bytes each); the others are joined by word.
BROADCAST_WORDS = 200_000
#: Longer words are no features.
FEATURE_CHARS = 64
#: Documents of the sample that a feature occurs in, at least.
FEATURE_ROWS = 5
#: Least evidence (G statistic) that a word and a domain go together; chance rarely gives so much.
EVIDENCE = 20.0
ROUNDS, TOLERANCE = 20, 1e-4
#: Sums over all documents that bounded rates may take to find their total.
BOUNDED_ROUNDS = 60
#: Least part of the wished total that bounded rates may fall to.
LEAST_TOTAL = 0.25
ANY = ""


def label_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labelled table: toxic, else low or good by quality.

    Of repeated labels the worst counts; rows without an id or a label are left out.
    """
    return (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' ELSE 'good' END").alias("domain"),
        )
    )


def words(text: Column) -> Column:
    """Lower-case words; may hold empty strings at its ends."""
    return F.split(F.lower(text), r"[\x20\x09-\x0D]+")


def posteriors(
    docs: DataFrame,
    labelled: DataFrame,
    domains: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``doc_id, tokens, p_<domain>...`` for every row of ``docs``, posteriors adding to one.

    ``labelled`` has ``doc_id, domain``, one row per id. Features are all words of the
    sample with enough evidence of some domain. A domain without a labelled
    document has posterior zero; without any, all belong to the first domain. Tokens are
    words. Null text has none, and the posterior that no feature word gives.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), words(text_or_empty(text_col)).alias("words")
    )
    n_labelled = max(1, labelled.count())
    share = min(1.0, sample_rows / n_labelled)
    sample = labelled.filter(F.col("domain").isin(domains)).filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < math.ceil(share * 1_000_003)
    )
    sample = written(
        rows.join(F.broadcast(sample), "doc_id").select(
            "domain", F.array_distinct("words").alias("words")
        ),
        "sample",
    )
    n = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    known = [d for d in domains if n.get(d)]
    tokens = (
        F.size("words")
        - (F.col("words")[0] == "").cast("int")
        - ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    )
    if len(known) < 2:
        sure = known[0] if known else domains[0]
        return rows.select(
            "doc_id",
            tokens.cast("long").alias("tokens"),
            *[F.lit(float(d == sure)).alias(f"p_{d}") for d in domains],
        )
    total = sum(n.values())
    seen = [F.sum((F.col("domain") == d).cast("long")).alias(f"n_{d}") for d in known]
    counts = (
        sample.select("domain", F.explode("words").alias("word"))
        .filter((F.col("word") != "") & (F.length("word") <= FEATURE_CHARS))
        .groupBy("word")
        .agg(F.count("*").alias("n"), *seen)
        .filter(F.col("n") >= FEATURE_ROWS)
    )
    counts = written(counts, "word_counts")
    evidence = F.greatest(
        *[2 * total * _information(F.col("n"), F.col(f"n_{d}"), n[d], total) for d in known]
    )
    # Only words that occur count: the lack of words says little of a short text.
    features = written(
        counts.filter(evidence >= EVIDENCE).select(
            "word", "n", *[F.log((F.col(f"n_{d}") + 0.5) / (n[d] + 1)).alias(f"w_{d}") for d in known]
        ),
        "features",
    )
    n_features = features.count()
    # The rest are words with many commoner ones before them, so none of them is a hot key.
    common = features if n_features <= BROADCAST_WORDS else features.orderBy(F.desc("n"), "word").limit(BROADCAST_WORDS)
    schema = "word string, " + ", ".join(f"`w_{d}` double" for d in known)
    prior = docs.sparkSession.createDataFrame([(ANY, *[math.log(n[d] / total) for d in known])], schema)
    common = common.drop("n").unionByName(prior)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    found = numbered.select(
        "row",
        "doc_id",
        tokens.cast("long").alias("tokens"),
        F.explode(F.array_distinct(F.concat(F.array(F.lit(ANY)), F.col("words")))).alias("word"),
    )
    weighed = found.join(F.broadcast(common), "word")
    if n_features > BROADCAST_WORDS:
        rest = features.drop("n").join(common, "word", "left_anti")
        weighed = weighed.unionByName(found.join(rest, "word"))
    sums = (
        weighed.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("tokens").alias("tokens"),
            *[F.sum(f"w_{d}").alias(f"s_{d}") for d in known],
        )
    )
    top = F.greatest(*[F.col(f"s_{d}") for d in known])
    scaled = sums.select("doc_id", "tokens", *[F.exp(F.col(f"s_{d}") - top).alias(f"e_{d}") for d in known])
    all_ = sum((F.col(f"e_{d}") for d in known), F.lit(0.0))
    return scaled.select(
        "doc_id",
        "tokens",
        *[(F.col(f"e_{d}") / all_ if d in known else F.lit(0.0)).alias(f"p_{d}") for d in domains],
    )


def _information(n_word: Column, n_both: Column, n_domain: int, total: int) -> Column:
    """Mutual information of having a word and being of a domain."""

    def part(both: Column, a: Column, b: float) -> Column:
        return F.when(both > 0, both / total * F.log(both * float(total) / (a * float(b)))).otherwise(0.0)

    rest = total - n_word
    return (
        part(n_both, n_word, n_domain)
        + part(n_word - n_both, n_word, total - n_domain)
        + part(F.lit(n_domain) - n_both, rest, n_domain)
        + part(rest - (F.lit(n_domain) - n_both), rest, total - n_domain)
    )


def rates(
    members: DataFrame,
    weights: dict[str, float],
    total_tokens: float | None = None,
    max_rate: float | None = None,
) -> DataFrame:
    """``members`` with ``rate``: how often a document is to be drawn, zero or more.

    ``members`` has ``tokens, p_<domain>...`` and is read in every round, so it should be
    a written table. Targets are ``weights`` (any positive scale) of ``total_tokens``;
    by default as many as keep the domain of the largest weight whole. Domains
    without tokens are left out and the other weights fill their place. Each round moves
    the rates against the gradient of the squared misses, scaled by the normal equations
    of the documents that are free to move, and projects them to zero or more; a round
    that doesn't come nearer is taken back and the step cut. ``max_rate`` bounds rates from
    above as well. Where no total is given it then falls as far as the targets need (see
    ``_with_total``), but not below ``LEAST_TOTAL`` of the wished one: where even that is out
    of reach, the rates are those nearest to the targets of that total. Only sums by domain
    reach the driver.
    """
    import numpy as np

    sums = [F.sum(F.col("tokens") * F.col(f"p_{d}")).alias(d) for d in weights]
    have = {d: v or 0.0 for d, v in members.agg(*sums).first().asDict().items()}
    used = [d for d in weights if have[d] > 0 and weights[d] >= 0]
    scale = sum(weights[d] for d in used)
    if not used or scale <= 0:
        return members.withColumn("rate", F.lit(1.0))
    share = np.array([weights[d] / scale for d in used])
    main = int(share.argmax())
    total = have[used[main]] / share[main] if total_tokens is None else total_tokens
    if max_rate is not None and total_tokens is None:
        found = _with_total(members, used, share, total, max_rate)
        if found is not None:
            return found
        total *= LEAST_TOTAL
    # Rates at the upper bound can still fall, and all begin there where it is one.
    free = (F.col("rate") > 0).cast("double")
    p = [F.col(f"p_{d}") for d in used]
    needed = [F.sum(F.col("rate") * F.col("tokens") * x) for x in p]
    needed += [F.sum(free * F.col("tokens") * x * y) for x in p for y in p]

    def state(rated: DataFrame) -> tuple:
        got = np.array(rated.agg(*needed).first(), float)
        return got[: len(p)] - share * total, got[len(p) :].reshape(len(p), len(p))

    current = members.withColumn("rate", F.lit(1.0))
    miss, normal = state(current)
    step = 1.0
    for _ in range(ROUNDS):
        if np.abs(miss).max() <= TOLERANCE * total:
            break
        # Gradients of documents that are free to move, in the metric of their normal equations.
        ridge = 1e-3 * sum(have.values()) * np.eye(len(p))
        move = step * np.linalg.solve(normal + ridge, miss)
        moved = F.col("rate") - sum((F.lit(float(m)) * x for m, x in zip(move, p)), F.lit(0.0))
        moved = F.greatest(moved, F.lit(0.0))
        if max_rate is not None:
            moved = F.least(moved, F.lit(float(max_rate)))
        nearer = current.withColumn("rate", moved)
        missed, normal_ = state(nearer)
        if (missed**2).sum() < (miss**2).sum():
            current, miss, normal, step = nearer, missed, normal_, min(1.0, 2 * step)
        else:
            step /= 4
            if step < 1e-3:
                break
    return current


def _with_total(
    members: DataFrame, domains: list[str], share, wished: float, max_rate: float
) -> DataFrame | None:
    """``members`` with rates up to ``max_rate`` that meet ``share`` of a total, itself fitted.

    Of all rates and totals that meet the targets, those nearest to keeping each document
    once and to the ``wished`` total: squared distances weighted by tokens, and of the total
    by itself. They are one minus multipliers times posteriors, projected to the bounds, so
    a round is one sum over the documents: the misses are the gradient for the multipliers,
    scaled by the normal equations of the documents that are free to move, and a step that
    doesn't raise the dual is cut. None where the total would fall below ``LEAST_TOTAL`` or
    the targets aren't met in ``BOUNDED_ROUNDS`` rounds.
    """
    import numpy as np

    p = [F.col(f"p_{d}") for d in domains]
    tokens = F.col("tokens")

    def rate(by) -> Column:
        cut = sum((F.lit(float(m)) * x for m, x in zip(by, p)), F.lit(0.0))
        return F.least(F.greatest(F.lit(1.0) - cut, F.lit(0.0)), F.lit(float(max_rate)))

    def state(by) -> tuple:
        total = max(wished * (1 + share @ by), 0.0)
        free = ((F.col("rate") > 0) & (F.col("rate") < max_rate)).cast("double")
        sums = [F.sum(tokens * (F.col("rate") - 1) * (F.col("rate") - 1))]
        sums += [F.sum(F.col("rate") * tokens * x) for x in p]
        sums += [F.sum(free * tokens * x * y) for x in p for y in p]
        got = np.array(members.withColumn("rate", rate(by)).agg(*sums).first(), float)
        miss = got[1 : 1 + len(p)] - share * total
        dual = (got[0] + wished * (total / wished - 1) ** 2) / 2 + by @ miss
        return dual, miss, got[1 + len(p) :].reshape(len(p), len(p)), total

    current = np.zeros(len(p))
    dual, miss, normal, total = state(current)
    step = 1.0
    for _ in range(BOUNDED_ROUNDS):
        if np.abs(miss).max() <= TOLERANCE * total:
            break
        metric = normal + wished * (np.outer(share, share) + 1e-9 * np.eye(len(p)))
        move = np.linalg.solve(metric, miss)
        ahead = state(current + step * move)
        if ahead[0] > dual + 1e-4 * step * (miss @ move):
            current = current + step * move
            dual, miss, normal, total = ahead
            step = 1.0
        else:
            step /= 4
    if total < LEAST_TOTAL * wished or np.abs(miss).max() > 10 * TOLERANCE * total:
        return None
    return members.withColumn("rate", rate(current))


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    max_rate: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, tokens, p_<domain>..., rate, copies`` for every row of ``docs``.

    ``copies`` rounds the rate up or down by a hash of the id, in proportion, so that the
    expected number is the rate. An empty table gives no rows.
    """
    members = written(
        posteriors(docs, label_domains(labels), list(weights), id_col, text_col), "members"
    )
    fitted = rates(members, weights, max_rate=max_rate)
    chance = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return fitted.withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    max_rate: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` drawn by their rates: left out, kept, or repeated. Rows without an id stay."""
    times, nth = free_name(docs, "copies"), free_name(docs, "copy")
    drawn = mixing_rates(docs, labels, weights, max_rate, id_col, text_col)
    copies = written(
        drawn.filter("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias(id_col))
        .agg(F.max("copies").alias(times))
        .filter(F.col(times) != 1),
        "copies",
    )
    kept = without(docs, copies.filter(F.col(times) == 0), id_col)
    more = copies.filter(F.col(times) > 1)
    extra = more.limit(BROADCAST_IDS + 1).count()
    if not extra:
        return kept
    again = docs.join(F.broadcast(more) if extra <= BROADCAST_IDS else more, id_col)
    again = again.withColumn(nth, F.explode(F.sequence(F.lit(2), F.col(times))))
    return kept.unionByName(again.select(*docs.columns))
