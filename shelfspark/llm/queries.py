"""The registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import conversations, exact_dedup, hmm, imatch, langid, mixing, neighbours
from shelfspark.llm import packing, phrases, quality, rollups, simhash, substrings
from shelfspark.llm.common import table
from shelfspark.session import new_path, written

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    LLM_QUERIES[function.__name__] = function
    return function


@query
def op3_simhash_near_dedup(spark, sf_dir):
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


@query
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


LLM_ORACLES["op7_exact_dedup"] = r"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""


@query
def op10_best_fit_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


#: Shares of tokens: nearly all good text, a little of the rest.
MIXTURE = {"good": 0.96, "low": 0.02, "toxic": 0.02}


@query
def op8_quality_classifier(spark, sf_dir):
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_source_mixing(spark, sf_dir):
    return mixing.mixing_rates(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIXTURE
    )


@query
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold("doc_id", 4) == 2
    automata = langid.learnt(docs.filter(~held_out))
    found = langid.identified(docs, automata).drop("n_symbols")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_nearest_neighbours(spark, sf_dir):
    rows = neighbours.valid_vectors(table(spark, sf_dir, "embeddings"))
    return neighbours.nearest(rows, rows.filter("vec_id % 50 = 0"))


@query
def op6_hmm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return hmm.scored(docs, langid.fold("doc_id", 10) == 0)


@query
def op2_token_counts(spark, sf_dir):
    """Loads all documents under two tokenizers, adds end tokens to one, takes low quality out, replays."""
    tokenizers = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
    counts = written(rollups.token_counts(table(spark, sf_dir, "documents"), tokenizers), "token_counts")

    def changes(k: int, old, new, rows=counts) -> DataFrame:
        return rows.select(
            "source",
            "lang",
            F.lit(tokenizers[k].partition(".")[0]).alias("tokenizer"),
            F.lit(old).cast("long").alias("old_tokens"),
            F.lit(new).cast("long").alias("new_tokens"),
        )

    root = new_path(spark, "rollup")
    n = [F.col("n_0"), F.col("n_1")]
    low = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    gone = counts.join(low, "doc_id", "left_semi")
    batches = {
        "load-0": changes(0, None, n[0]),
        "load-1": changes(1, None, n[1]),
        "end-token": changes(0, n[0], n[0] + 1),
        "low-quality": changes(0, n[0] + 1, None, gone).unionByName(changes(1, n[1], None, gone)),
    }
    for batch in [*batches, "load-0", "low-quality"]:
        rollups.commit(batches[batch], root, batch)
    return rollups.totals(spark, root)


@query
def op4_substring_dedup(spark, sf_dir):
    return substrings.repeats(table(spark, sf_dir, "documents"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with one row in 20 each dropped, emptied, cut short, repeated, or given to the user."""
    space = F.lit(" ")
    conv_id, turn = (F.coalesce(F.col(name).cast("string"), space) for name in ("conv_id", "turn"))
    hit = F.crc32(F.concat(conv_id, F.lit(":"), turn).cast("binary")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(hit == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


@query
def op11_conversation_repair(spark, sf_dir):
    """Damaged conversations, audited and repaired; those without rows left are whole and empty."""
    rows = table(spark, sf_dir, "conversations")
    audits, repaired = conversations.repaired(damaged(rows))
    found = audits.join(
        conversations.digests(repaired).withColumnRenamed("conv_id", "of"), F.expr("conv_id <=> of"), "left"
    ).drop("of")
    every = rows.select(F.col("conv_id").alias("of")).distinct()
    return (
        every.join(found, F.expr("conv_id <=> of"), "left")
        .select(F.col("of").alias("conv_id"), *found.columns[1:])
        .fillna({name: 0 for name in found.columns[1:-2]} | {"audit": ""})
        .withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
    )


# The cheapest edits row by row: of all ways to a state the least by cost, then by initials; a billion is never.
LLM_ORACLES["op11_conversation_repair"] = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                          lambda ch: ascii(ch)::BIGINT) AS bytes
    FROM conversations
), hits AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda x, y:
        list_reduce(list_prepend(xor(x, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z:
            CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 20 AS hit
    FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
           CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM hits
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
           regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body
    FROM damaged
), lines AS (
    SELECT conv_id, turn, role, text, i, left(role, 1) AS ini,
           CASE WHEN body = '' THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS kind,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM placed
), walk AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS f0, {'c': 1000000000::BIGINT, 'a': ''} AS f1,
           {'c': 3::BIGINT, 'a': 'I'} AS e2, {'c': 6::BIGINT, 'a': 'II'} AS e3
    FROM conversations
    UNION ALL
    SELECT conv_id, i, f0, f1, e2, least(f3, {'c': e2.c + 3, 'a': e2.a || 'I'}) AS e3
    FROM (
        SELECT conv_id, i, f0, f1, f3, least(f2, {'c': near.c + 3, 'a': near.a || 'I'}) AS e2
        FROM (
            SELECT *, least(f0, f1, f3) AS near
            FROM (
                SELECT w.conv_id, r.i,
                       {'c': f0.c + 4, 'a': f0.a || 'D'} AS f0,
                       least({'c': f1.c + 4, 'a': f1.a || 'D'},
                             {'c': f0.c + x + CASE ini WHEN 's' THEN 0 ELSE 1000000000 END, 'a': f0.a || 'K'}) AS f1,
                       least({'c': e2.c + 4, 'a': e2.a || 'D'},
                             {'c': p.c + x + CASE ini WHEN 'u' THEN 0 ELSE 1000000000 END, 'a': p.a || 'K'},
                             {'c': p.c + x + 3, 'a': p.a || 'R'}) AS f2,
                       least({'c': e3.c + 4, 'a': e3.a || 'D'},
                             {'c': e2.c + x + CASE ini WHEN 'a' THEN 0 ELSE 1000000000 END, 'a': e2.a || 'K'},
                             {'c': e2.c + x + 3, 'a': e2.a || 'R'}) AS f3
                FROM (SELECT *, least(f0, f1, e3) AS p FROM walk) w
                JOIN (SELECT *, CASE kind WHEN 'sound' THEN 0 WHEN 'truncated' THEN 3 ELSE 1000000000 END AS x FROM lines) r
                  ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
            )
        )
    )
), ends AS (
    SELECT conv_id, least(f0, e3).c AS cost, least(f0, e3).a AS audit
    FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), letters AS (
    SELECT conv_id, p, substr(audit, p, 1) AS edit
    FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM ends)
), edits AS (
    SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS i, count(*) FILTER (WHERE edit <> 'D') OVER w AS place
    FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), kept AS (
    SELECT e.conv_id, e.p, e.edit, e.place, r.role, CASE edit WHEN 'I' THEN '' ELSE r.text END AS text,
           max(CASE WHEN e.place = 1 AND edit = 'K' AND r.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
    FROM edits e LEFT JOIN lines r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i AND e.edit <> 'I'
    WHERE edit <> 'D'
), repaired AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
                               || ':' || text, chr(10) ORDER BY p) AS whole
    FROM kept GROUP BY conv_id
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (WHERE kind = 'blank') AS blank, count(*) FILTER (WHERE kind = 'duplicate') AS duplicate,
           count(*) FILTER (WHERE kind = 'truncated') AS truncated,
           count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM lines GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
       sha256(coalesce(whole, '')) AS repaired_sha256
FROM ends e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query
def op13_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


LLM_ORACLES["op13_phrase_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), listed AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), placed AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed
), grams AS (
    SELECT lang, w[i] AS phrase, 1 AS words FROM placed
    UNION ALL SELECT lang, w[i] || ' ' || w[i + 1], 2 FROM placed WHERE i + 1 <= len(w)
    UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 3 FROM placed WHERE i + 2 <= len(w)
), f AS (
    SELECT lang, phrase, words, count(*) AS f FROM grams GROUP BY ALL
), total AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang
), found AS (
    SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10
), cuts AS (
    SELECT lang, phrase, a, 1 AS k, w[1] AS left_part, array_to_string(w[2:], ' ') AS right_part FROM found
    UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM found WHERE words = 3
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
           ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.left_part
    JOIN f y ON y.lang = c.lang AND y.phrase = c.right_part
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ones AS (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM found WHERE words = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM found WHERE words = 3
), longer AS (
    SELECT lang, phrase, max(a) AS most FROM inner_ones GROUP BY ALL
), ranked AS (
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank,
           b.phrase, a, l, r, score
    FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
    WHERE o.most IS NULL OR 100 * o.most < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query
def op12_document_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = imatch.compared_with_next(docs, imatch.lexicon(docs))
    text = lambda name: F.lower(F.hex(name)).alias(name)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next"
    )
