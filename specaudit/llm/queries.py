"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from specaudit.llm import toxicity
from specaudit.llm.conversation_repair import damaged, repaired
from specaudit.llm.decontamination import leaks
from specaudit.llm.embedding_dedup import near_duplicates
from specaudit.llm.language_id import identified
from specaudit.llm.license_scan import license_notices
from specaudit.llm.license_scan import oracle_sql as license_sql
from specaudit.llm.mixing import mixed
from specaudit.llm.mixing import oracle_sql as mixing_sql
from specaudit.llm.ngram_join import jaccard_components
from specaudit.llm.packing import pack
from specaudit.llm.prefix_trie import oracle_sql as trie_sql
from specaudit.llm.prefix_trie import paths, prefix_trie, rebuilt
from specaudit.llm.secret_scan import secret_spans
from specaudit.llm.token_counts import token_counts
from specaudit.llm.warc import payload_facts, read_chunks, write_archives
from specaudit.session import new_folder

BPE = "byte_bpe_50k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(_table(spark, folder, "documents"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_notices(_table(spark, folder, "documents"))


def op4_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    archives = write_archives(_table(spark, folder, "pages"), new_folder(spark, "warc"))
    return payload_facts(read_chunks(archives, payloads=False))


def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "embeddings"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identified(_table(spark, folder, "documents"))


def op7_cost_balanced_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"), public_tokenizers.path(BPE)).drop("ids")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.scored(docs, toxicity.learnt(docs, _table(spark, folder, "labels")))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_table(spark, folder, "documents"), public_tokenizers.path(BPE))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_spans(_table(spark, folder, "documents"))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(rebuilt(paths(_table(spark, folder, "conversations"))))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(damaged(_table(spark, folder, "conversations")))


def op13_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_benchmark_decontamination, op2_ngram_jaccard_join, op3_license_scan, op4_warc_chunks, op5_embedding_near_dedup, op6_language_id, op7_cost_balanced_packing, op8_toxicity, op9_token_counts, op10_secret_scan, op11_conversation_trie, op12_conversation_repair, op13_source_mix)
}
WARC_SQL = """
WITH facts AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages),
marked AS (SELECT *, sha256(payload) AS digest, min(page_id) OVER (PARTITION BY payload) AS first FROM facts)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to, TRUE AS verified, greatest(1, CASE WHEN n >= 100 AND page_id <> first THEN 1 ELSE CAST(ceil(n / 1048576.0) AS BIGINT) END) AS n_chunks
FROM marked
"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= 90 * (a.n + b.n - k)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON other = x)
SELECT r.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""
COSINE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, links.y FROM reach JOIN links ON other = x)
SELECT r.vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(other) AS component_id, r.vec_id = min(other) AS kept FROM reach r LEFT JOIN n ON r.vec_id = n.x GROUP BY r.vec_id
"""
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": JACCARD_SQL, "op3_license_scan": license_sql(), "op4_warc_chunks": WARC_SQL, "op5_embedding_near_dedup": COSINE_SQL, "op11_conversation_trie": trie_sql(), "op13_source_mix": mixing_sql(),
}
