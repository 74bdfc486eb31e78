"""The operators of this folder over their whole tables, with SQL where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.decontamination import contamination
from ledgerloom.llm.filter_audit import audit
from ledgerloom.llm.lm_scoring import score_texts
from ledgerloom.llm.mixing import EXPONENT, PARTS, schedule
from ledgerloom.llm.mixing import BLOCK_ROWS as MIXED_BLOCK
from ledgerloom.llm.quality import quality_measures
from ledgerloom.llm.secret_scan import BASE_KINDS, scan
from ledgerloom.llm.simhash import near_duplicates
from ledgerloom.llm.spelling import counted_words, one_in_31, spelling_groups
from ledgerloom.llm.substrings import remove_repeats
from ledgerloom.llm.token_counts import count_tokens
from ledgerloom.llm.token_files import read_documents, write_tokens
from ledgerloom.llm.toxicity import score, train
from ledgerloom.llm.warc import read_records, write_archives
from ledgerloom.registry.base import Query
from ledgerloom.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_texts(table(spark, sf_dir, "documents"), nearest=True)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


OVER_LIMIT = 1024


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), scratch(spark, "secret-ledger"))

    def n(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(findings):
        return F.concat_ws(",", F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start_at"], f["end_at"])))

    base = F.filter("findings", lambda f: f["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *map(n, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_measures(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


FEWEST_OCCURRENCES = 2


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = counted_words(table(spark, sf_dir, "documents"), alter=one_in_31).where(F.col("n") >= FEWEST_OCCURRENCES)
    return spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "web-archive")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_records(spark, path, payloads=False).select(
        F.col("key").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP10_SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
spans AS (
    SELECT doc_id, i, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS had FROM words
    WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS times FROM spans WHERE had = 5),
repeats AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, unnest(range(5)) AS v(k) WHERE times > 1 GROUP BY doc_id
), m AS (
    SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
           coalesce(r.n, 0)::BIGINT AS n_repeat_words,
           len(regexp_extract_all(t, '[A-Z]')) AS upper, len(regexp_extract_all(t, '[A-Za-z]')) AS letters
    FROM d LEFT JOIN repeats r USING (doc_id)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > 2 * n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * upper > 6 * letters) AS kept
FROM b
"""

# Earliest deadline first in a recursive query: one row per slot, with every source's next block in a list.
OP4_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weights AS (SELECT source, n, pow(n, {EXPONENT}) / sum(pow(n, {EXPONENT})) OVER () AS w FROM counts),
shares AS (
    SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS number, (n + {MIXED_BLOCK} - 1) // {MIXED_BLOCK} AS n_blocks,
           greatest(1, floor({PARTS} * w / sum(w) OVER () + 0.5)::BIGINT)::HUGEINT AS share
    FROM weights
), whole AS (
    SELECT sum(share)::HUGEINT AS q, list(share ORDER BY number) AS k, list(n_blocks ORDER BY number) AS b, sum(n_blocks) AS blocks, count(*) AS m
    FROM shares
), slots AS (
    SELECT -1::HUGEINT AS t, 0::BIGINT AS picked, 0::HUGEINT AS i, list_transform(k, lambda x: 0::HUGEINT) AS following FROM whole
    UNION ALL
    SELECT t, picked, following[picked],
           list_transform(following, lambda x, s: CASE WHEN s = picked THEN x + 1 ELSE x END)
    FROM (
        SELECT now AS t, following,
               (list_min(list_transform(following, lambda x, s:
                   CASE WHEN x < b[s] AND (x * q) // k[s] <= now THEN (((x + 1) * q + k[s] - 1) // k[s]) * (m + 1) + s END
               )) % (m + 1))::BIGINT AS picked
        FROM (SELECT following, greatest(t + 1, list_min(list_transform(following, lambda x, s: CASE WHEN x < b[s] THEN (x * q) // k[s] END))) AS now,
                     k, b, q, m
              FROM slots, whole WHERE list_sum(following) < blocks))
), numbered AS (
    SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR) NULLS FIRST, doc_id) - 1 AS r FROM documents
), blocks AS (SELECT doc_id, source, r // {MIXED_BLOCK} AS block, r % {MIXED_BLOCK} AS place FROM numbered)
SELECT doc_id, b.source, block::BIGINT AS block, place::BIGINT AS place, ((block * q) // share)::BIGINT AS release,
       (((block + 1) * q + share - 1) // share)::BIGINT AS deadline, slots.t::BIGINT AS slot
FROM blocks b JOIN shares s ON b.source IS NOT DISTINCT FROM s.source, whole, slots
WHERE slots.picked = s.number AND slots.i = block
"""

OP7_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _matches_sql(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    return rf"""
    SELECT doc_id, {number} AS k, '{kind}' AS kind, m[i] AS found, g[i] AS value,
           list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a,
           {least} AS least
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g,
                 string_split_regex(t, '{pattern}') AS s FROM d), unnest(range(1, len(m) + 1)) AS u(i)"""


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_matches_sql("assign", 0, OP7_ASSIGN, 2, 6)}
    UNION ALL {_matches_sql("access", 1, "AKIA[A-Z0-9]+", 0, 20)}
    UNION ALL {_matches_sql("hex", 2, "[0-9a-f]{24,}", 0, 24)}
    UNION ALL {_matches_sql("pem", 3, "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=[:space:]:,\\\\-]+?-----END [A-Z ]{0,20}PRIVATE KEY-----", 0, 0)}
    UNION ALL {_matches_sql("web_token", 4, "eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}", 0, 0)}
), found AS (
    SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
           string_agg(concat(kind, ':', a::BIGINT, ':', (a + length(found))::BIGINT), ',' ORDER BY a, k) AS spans,
           string_agg(concat(kind, ':', a::BIGINT, ':', (a + length(found))::BIGINT), ',' ORDER BY a, k) FILTER (k < 3) AS base
    FROM f WHERE length(value) >= least GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (doc_id)
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
windows AS (
    SELECT doc_id, i, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS had FROM words
    WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), later AS (
    SELECT doc_id, i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS place FROM windows WHERE had = 20) WHERE place > 1
), gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, unnest(range(20)) AS v(k)),
kept AS (
    SELECT words.doc_id, count(gone.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL), '') AS t
    FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY words.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ALNUM_WORDS = r"regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8_SQL = f"""
WITH items AS (SELECT item_id, {ALNUM_WORDS} AS w FROM (SELECT item_id, {LOWER_AZ} AS lower_az FROM benchmark)),
windows AS (
    SELECT DISTINCT item_id::VARCHAR AS item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
    FROM items, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows),
d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM (SELECT doc_id, {LOWER_AZ} AS lower_az FROM documents)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
spans AS (
    SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS s,
           count(*) OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS had
    FROM words, sizes WHERE n = 13
    UNION ALL
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' '), n FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i) WHERE n < 13
), hits AS (SELECT doc_id, i, spans.n, item_id FROM spans JOIN windows ON spans.n = windows.n AND spans.s = windows.s WHERE had = spans.n),
per_doc AS (
    SELECT doc_id, (SELECT count(*) FROM (SELECT DISTINCT h.i + k FROM hits h, unnest(range(13)) AS v(k) WHERE h.doc_id = g.doc_id AND k < h.n)) AS n_hit,
           list_sort(list(DISTINCT item_id)) AS ids
    FROM hits g GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN per_doc USING (doc_id)
"""

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
    SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
           + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
           + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS fails
    FROM d LEFT JOIN marks ON d.doc_id = marks.doc_id
), cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
    FROM orders, unnest(range(1, 6)) AS u(step)
), r AS (
    SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (fails & (earlier | bit) = 0), 0) AS kept,
           coalesce(sum(n) FILTER (fails & bit > 0 AND fails & earlier = 0), 0) AS removed,
           coalesce(sum(n) FILTER (fails & bit > 0 AND fails & earlier > 0), 0) AS redundant,
           coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
           coalesce(sum(good) FILTER (fails & bit > 0 AND fails & earlier = 0), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (fails & bit > 0 AND fails & earlier = 0), 0) AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

OP13_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least
    FROM pages
), r AS (SELECT *, n >= 100 AND least IS NOT NULL AND (page_id IS NULL OR page_id > least) AS again FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN least END AS refers_to
FROM r
"""

QUERIES = [
    Query("op1_lm_scoring", op1_lm_scoring),
    Query("op2_token_counts", op2_token_counts),
    Query("op3_simhash_near_dedup", op3_simhash_near_dedup),
    Query("op4_source_mixing", op4_source_mixing, OP4_SQL),
    Query("op5_token_files", op5_token_files),
    Query("op6_substring_dedup", op6_substring_dedup, OP6_SQL),
    Query("op7_secret_scan", op7_secret_scan, OP7_SQL),
    Query("op8_decontamination", op8_decontamination, OP8_SQL),
    Query("op9_toxicity", op9_toxicity),
    Query("op10_quality_rules", op10_quality_rules, OP10_SQL),
    Query("op11_filter_audit", op11_filter_audit, OP11_SQL),
    Query("op12_spelling_variants", op12_spelling_variants),
    Query("op13_warc", op13_warc, OP13_SQL),
]
