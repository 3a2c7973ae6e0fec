"""The registered queries of this package: thin calls of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe, compression, conversations, exact, langid, lexical, packing, simhash, substring, token_files, toxicity, url_rules, warc
from loomwright.session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def url_given_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.given(table(spark, sf_dir, "pages")).drop("url")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.judge(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"))
    return token_files.read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.summaries(conversations.repair(conversations.damage(rows), rows))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_url_rules,
        url_given_rules,
        op3_warc,
        op4_simhash,
        op5_packing,
        op6_langid,
        op7_compression_bands,
        op8_bpe,
        op9_substring,
        op10_exact_dedup,
        op11_token_files,
        op12_lexical_search,
        op13_conversation_repair,
    )
}

ORACLES = {
    "url_given_rules": r"""
        WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (
            SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest),
        rules(given, top, start) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                            ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fits AS (
            SELECT p.*, top || start AS rule, given,
                   row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(top) + length(start) DESC NULLS LAST) AS k
            FROM parts p LEFT JOIN rules ON (host = top OR ends_with(host, '.' || top)) AND starts_with(path, start))
        SELECT page_id, host, path, rule, given FROM fits WHERE k = 1""",
    "op3_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS leader FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND leader IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND leader IS DISTINCT FROM page_id THEN leader END AS refers_to, true AS verified
        FROM g""",
    "op12_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        n AS (SELECT doc_id, CAST(coalesce(len(terms), 0) AS BIGINT) AS n FROM d),
        t AS (SELECT CAST(count(*) FILTER (n > 0) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
        q AS (
            SELECT item_id, term, CAST(count(*) AS BIGINT) AS held
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
            GROUP BY ALL),
        words AS (SELECT doc_id, unnest(terms) AS term FROM d),
        f AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM words WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
        w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM df, t),
        g AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))) AS gain
            FROM f JOIN w USING (term) JOIN n USING (doc_id), t),
        s AS (SELECT item_id, doc_id, CAST(sum(held * gain) AS BIGINT) AS score FROM g JOIN q USING (term) GROUP BY ALL),
        r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
    "op10_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
