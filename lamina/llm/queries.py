"""The operators applied to their whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import collocations, decontaminate, divergence, exact_dedup, jaccard, lm, packing, pii, quality, secret_scan, suffix_dedup, token_counts, toxicity
from lamina.llm.common import LOWER, UPPER, fold, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.dedup_table(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    is_base = lambda s: s["kind"].isin(*pii.BASE_KINDS)
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return pii.pii_spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count(k) for k in pii.BASE_KINDS),
        F.sha2(F.array_join(F.transform(F.filter(spans, is_base), one), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, one), ",").alias("spans"),
        F.transform(spans, lambda s: s["score"]).alias("scores"),
    )


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    """A null doc_id has no remainder and is not held out."""
    return scores.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), quality.THRESHOLD)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), toxicity.THRESHOLD)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    spans, base = F.col("spans"), F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan.find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count(kind) for kind in secret_scan.KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, one), ",").alias("spans"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (op1_suffix_dedup, op2_exact_dedup, op3_pii, op4_quality, op5_packing, op6_lm, op7_toxicity, op8_decontaminate, op9_jaccard, op10_secrets, op11_collocations, op12_divergence, op13_token_counts)}

_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

ORACLES = {
    "op2_exact_dedup": f"""
        WITH rows AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
        FROM rows WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op8_decontaminate": f"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        items AS (
            SELECT item_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), {decontaminate.WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {decontaminate.WINDOW}) - 1], ' ') AS run
            FROM items, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW} + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
        lengths AS (SELECT DISTINCT n FROM windows),
        runs AS (
            SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS run
            FROM words, lengths, unnest(range(1, len(w) - n + 2)) AS t(i)),
        hits AS (SELECT r.doc_id, r.i, r.n, x.item_id FROM runs r JOIN windows x ON r.n = x.n AND r.run = x.run),
        places AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
        found AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op11_collocations": f"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
        totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
        frequent AS (
            SELECT lang, len AS words, array_to_string(w[i : i + len - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
            FROM words, unnest(range(1, {collocations.LONGEST + 1})) AS s(len), unnest(range(1, len(w) - len + 2)) AS t(i)
            GROUP BY ALL HAVING count(*) >= {collocations.MIN_COUNT}),
        candidates AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM frequent WHERE words >= 2),
        cuts AS (
            SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, {collocations.SCALE} * c.a // (x.f + y.f) AS score
            FROM candidates c, unnest(range(1, words)) AS t(k)
            JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
            JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')),
        lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (
            SELECT c.lang, array_to_string(c.w[i : i + len - 1], ' ') AS phrase, max(a) AS longer
            FROM candidates c, unnest(range(2, words)) AS s(len), unnest(range(1, words - len + 2)) AS t(i) GROUP BY ALL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
               CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
        FROM lowest LEFT JOIN inside USING (lang, phrase) JOIN totals USING (lang)
        WHERE longer IS NULL OR 100 * longer < {collocations.SUBSUMED} * a QUALIFY rank <= {collocations.TOP}
    """,
    "op12_divergence": f"""
        WITH rows AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all({_LOWERED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        words AS (SELECT r, lang, source, unnest(w) AS term FROM rows),
        kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
        langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
        groups AS (SELECT lang, source, coalesce(CAST(sum(n) AS HUGEINT), 0) AS total FROM (SELECT DISTINCT lang, source FROM rows) LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
        shared AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + {divergence.SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p,
                   1 + {divergence.SCALE}::HUGEINT * (k.n + 1) // (l.total + l.v) AS q
            FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM shared a JOIN shared b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shared WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM parts QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}
    """,
}
