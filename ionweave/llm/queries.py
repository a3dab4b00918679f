"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm import bpe, conversation_repair, decontaminate, lm_score, pii, quality_model, quality_rules, simhash, token_counts, token_files, top_k, url_filter, vector_codes
from ionweave.llm.common import fresh_folder, held_out, table
from ionweave.llm.twins import OP11_SQL, OP12_SQL, OP13_SQL

#: A document with more tokens than this doesn't fit a training window.
TOKEN_LIMIT = 1024


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text that they decode to."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.code(table(spark, sf_dir, "documents"), vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels of held-out rows are not learnt from."""
    docs = table(spark, sf_dir, "documents")
    vectors, network = quality_model.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    predicted = (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted")
    return quality_model.score(docs, vectors, network).select("doc_id", held_out().alias("held_out"), "score", predicted)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's losses under the models of good documents and of all, and their difference."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score(table(spark, sf_dir, "documents"), good)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over the limit."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds a benchmark item, with the item and what shows it."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition figures and the verdict of every document."""
    return quality_rules.repetition_rules(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates, and how many entities were replaced."""
    docs = table(spark, sf_dir, "documents")
    replaced = pii.replace(docs, pii.checked_key(docs))  # a key of this run: nobody can undo it later
    return replaced.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of three-word shingles and the least id of its component."""
    found = simhash.classes(table(spark, sf_dir, "documents"), size=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The id after each document.
END_ID = 2


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document lies in the token files, and the checksum of its ids as read back."""
    docs = table(spark, sf_dir, "documents")
    shards = token_files.shard_count(docs)
    folder = fresh_folder(spark, "tokens")
    return token_files.read(token_files.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), END_ID, shards))


#: A page is listed if a label of its host is one of these.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The block list of op10: the URLs of all pages on hosts with a listed label."""
    labels = F.array(*map(F.lit, LISTED_LABELS))
    return pages.where(F.arrays_overlap(F.split(url_filter.host(F.col("url")), r"\."), labels)).select("url")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, listed_urls(pages))


OP10_SQL = r"""
WITH seen AS (
    SELECT page_id, url,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
        list_filter(list_sort(string_split(coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), ''), '&')),
            lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')) AS asked
    FROM pages
), named AS (
    SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
        || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS canon,
        CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM seen
), listed AS (
    SELECT DISTINCT canon AS listed_url FROM named
    WHERE list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
         WHEN listed_url IS NOT NULL AND contains(url, '://') THEN 'block' ELSE 'allow' END AS verdict,
    rule IS NULL AND listed_url IS NOT NULL AND coalesce(contains(url, '://'), false) AS listed
FROM named LEFT JOIN listed ON canon = listed_url
"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, the cheapest edits and the digest of the repaired turns of every damaged conversation."""
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.report(conversation_repair.repair(damaged))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code and error, the errors of its label, and the digest of the codebooks."""
    coded, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    folder = fresh_folder(spark, "coded")
    coded.write.parquet(folder)  # it is read twice
    digest = F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256")
    found = vector_codes.with_label_errors(spark.read.schema(coded.schema).parquet(folder))
    return found.select("vec_id", "code", "error", "label_error", digest)


#: Queries of op13, by their ids, and how many vectors each gets.
QUERY_EVERY, QUERY_K = 50, 5


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with the highest inner products with every fiftieth one."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k.top_k(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0), QUERY_K)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_lm_score": op3_lm_score,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii": op7_pii,
    "op8_simhash": op8_simhash,
    "op9_token_files": op9_token_files,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_top_k": op13_top_k,
}
ORACLE_SQL: dict[str, str] = {"op10_url_filter": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_top_k": OP13_SQL}
