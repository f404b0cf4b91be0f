"""Registered queries of the llm operators, with their DuckDB oracles where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup as dedup
from tablewright.llm import conversation_repair, edit_fingerprint, html_extract, ngram_join, packing, quality, sentencepiece_codec, sharding, token_binary, url_filter, vector_search, whitening
from tablewright.llm.common import table
from tablewright.session import checkpoint_dir

#: The rules of the URL query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/token_binary/{uuid.uuid4().hex}"
    token_binary.write_token_binary(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return token_binary.segments(spark.read.parquet(path))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first; where none fits, hosts of the pages that the word list puts on the block list."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    listed = url_filter.listed_hosts(pages)
    return url_filter.filter_urls(pages, url_filter.rule_rows(spark, RULES).unionByName(listed))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return conversation_repair.repair_report(conversation_repair.damage(rows), rows)


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edit_fingerprint.fingerprint_report(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_exact_dedup, op3_best_fit_packing, op4_ngram_jaccard, op5_sharding,
                            op6_token_binary, op7_url_filter, op8_nearest_neighbours, op9_html_extract, op10_quality_classifier,
                            op11_conversation_repair, op12_document_fingerprints, op13_embedding_whitening)
}

SQL: dict[str, str] = {
    "op2_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id is not distinct from max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    "op7_url_filter": """
        with u as (
            select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        s as (
            select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
        r(verdict, rhost, rpath) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                            ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        f as (
            select s.page_id, max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, verdict := verdict)) as b
            from s join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by s.page_id)
        select s.page_id, s.host, s.path, f.b.rule as rule,
               coalesce(f.b.verdict, case when regexp_matches(s.host, '(^|[.\\-_])(ads|adult|bet|bets|casino|pills|porn|spam|xxx)($|[.\\-_])')
                                               then 'block' else 'allow' end) as verdict
        from s left join f using (page_id)""".replace("\\\\", "\\"),
}
