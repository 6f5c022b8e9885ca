"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.llm import languages, leakage, mojibake, personal, scans, titles, tokens
from vitalake.session import materialise, table


def p1_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Open titles with their occupation, the entry they name and its score; unmatched titles are ``none``."""
    rows = table(spark, d, "resolution_results").where("standardized is null")
    return titles.resolve(rows, "result_id", "input", table(spark, d, "occupations"), "uri", "preferred_label", "alt_labels", cache=materialise)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_resolved(spark, d).select("result_id", "uri")


def _posts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "post_results")
    return p.select("post_id", "text", p["stats.detected_language"].alias("label"))


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every text (line 0) and line with letters, with its language and a confidence."""
    posts = _posts(spark, d)
    return languages.label_lines(posts, "post_id", "text", languages.fit(posts, "post_id", "text", "label")).drop("mixed")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    posts = _posts(spark, d)
    return languages.find_mislabelled(posts, "post_id", "text", "label", languages.fit(posts, "post_id", "text", "label")).select("post_id", "line_no", "lang")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.find_noise(table(spark, d, "pdf_results"), "pdf_id", "text", "page_count", cache=materialise)


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "pdf_results"), "pdf_id", "text", "page_count", cache=materialise)


def _personal_texts(spark: SparkSession, d: str) -> DataFrame:
    """(src, row_id, field, text) of every searched text."""
    p, w = table(spark, d, "pdf_results"), table(spark, d, "docx_results")

    def part(df: DataFrame, src: str, key: str, field: str, column: Column) -> DataFrame:
        return df.select(F.lit(src).alias("src"), F.col(key).alias("row_id"), F.lit(field).alias("field"), column.alias("text"))

    # an author is one line, whatever it holds
    author = F.translate(p["metadata.author"], "\n", " ")
    return part(p, "pdf_results", "pdf_id", "text", p["text"]).unionByName(part(p, "pdf_results", "pdf_id", "author", author)).unionByName(part(w, "docx_results", "docx_id", "text", w["text"]))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _personal_texts(spark, d)
    return personal.find_personal(texts, ["src", "row_id", "field"], "text", personal.learn_names(texts, "text"))


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    texts = _personal_texts(spark, d)
    return personal.mask_personal(texts, ["src", "row_id", "field"], "text", personal.learn_names(texts, "text"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_column(table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again: its size and digest."""
    back = tokens.decode_column(p8_ids(spark, d), "doc_id", "ids")
    return back.select("doc_id", F.length("raw").alias("n_bytes"), F.md5("raw").alias("digest"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text").select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, d, "documents"), "doc_id", "text", cache=materialise).select("doc_id")


def p10_words(spark: SparkSession, d: str) -> DataFrame:
    """What is looked up: the number of distinct words of each document that hold a character outside ASCII."""
    return mojibake.document_words(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(table(spark, d, "documents"), "doc_id", "text", cache=materialise)


QUERIES = {"p1_found": p1_found, "p1_resolved": p1_resolved, "p2_found": p2_found, "p2_languages": p2_languages, "p3_found": p3_found, "p3_repaired": p3_repaired, "p5_found": p5_found, "p5_masked": p5_masked, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_found": p9_found, "p10_words": p10_words, "p10_found": p10_found, "p10_restored": p10_restored}
ORACLES: dict[str, str] = {
    "p8_decoded": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS INTEGER) AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents",
    "p10_words": r"SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS w FROM documents) WHERE regexp_matches(w, '[^\x00-\x7F]') GROUP BY doc_id",
}
