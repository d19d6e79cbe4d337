"""Named queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import chat_rotation, decontaminate, html_text, language, lines, pieces, prefix_trie, quality, repeats, simhash, topk, warc, whitening
from cairnfield.llm._common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


@_query("op2_chat_rotation", chat_rotation.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


@_query("op9_warc", warc.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op5_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query("op7_decontaminate", decontaminate.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("coalesce(aggregate(hit_spans, 0L, (n, s) -> n + s[1] - s[0]), 0L)")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@_query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = ~held_out(F.col("doc_id"))
    model = quality.fit(documents.where(seen), table(spark, sf_dir, "labels").where(seen))
    scored = quality.predict(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@_query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    judged = language.predict(documents.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@_query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op10_topk", topk.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole(F.col("embedding")).alias("vector"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@_query("op3_repeats")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"), words=repeats.PASSAGE)
    covered = lambda spans: F.expr(f"aggregate({spans}, 0L, (n, s) -> n + s[1] - s[0])")
    # a repeated passage of over 50 words may have fewer than 400 bytes: only the last column shows it
    return cut.select(
        "doc_id", "n_bytes", covered("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), covered("passages").alias("n_passage_words")
    )


@_query("op1_lines", lines.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["begin"], r["begin"] + r["n_lines"] - 1)))))
    return kept.select(
        F.col("others.doc_id").alias("doc_id"),
        "n_lines",
        gone.cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@_query("op11_prefix_trie", prefix_trie.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@_query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@_query("op13_html_text", html_text.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))
