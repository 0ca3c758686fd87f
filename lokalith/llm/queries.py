"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalith.llm import binids, conversations, decontam, exact_dedup, langid, licenses, oracle, packing, simhash, spelling, token_counts, toxicity, urls, warc
from lokalith.llm.shared import fold_of, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), width=3, distance=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out():
    return (fold_of("doc_id") == 2).alias("held_out")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs, fold_of("doc_id") != 2))
    return found.select("doc_id", _held_out(), "lang_pred", "score", "rejected")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0, with_ids=False)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binids.round_trip(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1, with_ids=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold_of("doc_id") != 2)
    return toxicity.score(docs, model, threshold=0.3).select("doc_id", _held_out(), "score", "predicted", "gain")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.planted_words(table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.whole_report(rows, conversations.damaged(rows))


#: The site rules of op13.
SITES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.rules_of(spark, SITES)
    return urls.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict", "pattern")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _OPERATORS}


_OPERATORS = (op1_decontamination, op2_simhash, op3_exact_dedup, op4_language_id, op5_warc, op6_best_fit_packing, op7_token_ids, op8_toxicity, op9_license_scan, op10_token_counts,
              op11_spelling_variants, op12_conversation_repair, op13_url_filters)

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT item, least(10, len(ws)) AS l, array_to_string(ws[i + 1:i + 10], ' ') AS w
       FROM (SELECT item, ws, unnest(range(0, greatest(len(ws) - 10, 0) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, l, array_to_string(ws[i + 1:i + l], ' ') AS w
       FROM (SELECT doc_id, ws, l, unnest(range(0, len(ws) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(ws) >= l)),
hit AS (SELECT doc_id, i, dw.l, item FROM dw JOIN bw USING (w)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
        "op5_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (digest)""",
        "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
        "op11_spelling_variants": oracle.SPELLING,
        "op12_conversation_repair": oracle.CONVERSATIONS,
        "op13_url_filters": oracle.URLS,
    }
