"""The registered queries of this folder: thin calls of its operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language, licenses, mixing, packing, prefix_trie, quality, secrets, token_files, token_rollup, warc, whitening
from .common import hot_keys, join_hot, new_path, small_batches, table, written
from .sql import SQL


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=3, up=90, down=100).select("doc_id", "n_shingles", "component_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, markers=True)
    return token_files.read_token_files(manifest, with_ids=False)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language.fit(docs.where(~language.is_held_out("doc_id")))
    predicted = language.predict(docs, dictionaries)
    return predicted.select("doc_id", language.is_held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches, each for both tokenizers: every document is counted; all
    but the least id of equal texts are deleted; what is left is revised to its
    distinct lines; and the deletions come a second time."""
    return rollup(table(spark, sf_dir, "documents"), {n: public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k")})


def rollup(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    spark, versions = docs.sparkSession, sorted(tokenizers)
    lines = F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")
    own = docs.select("doc_id", "source", "lang", "text", F.sha2("text", 256).alias("same"), F.when(lines != F.col("text"), lines).alias("fewer"))
    # Only texts with repeated lines are encoded a second time, as their distinct lines.
    whole = token_rollup.count_tokens(own, "text", tokenizers).withColumnsRenamed({f"n_{v}": f"all_{v}" for v in versions})
    counted = token_rollup.count_tokens(whole, "fewer", tokenizers).drop("text", "fewer")
    counted = written(counted, "counted")
    first = counted.where("same is not null").groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    copies = join_hot(counted, first, "same", F.col("doc_id"), hot_keys(counted, "same")).withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    copies = written(copies.drop("same", "first"), "copies")

    def events(rows: DataFrame, kind: str, now: str | None, was: str | None) -> DataFrame:
        null = F.lit(None).cast("long")
        each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), (F.col(f"{now}_{v}") if now else null).alias("n_tokens"), (F.col(f"{was}_{v}") if was else null).alias("was_tokens")) for v in versions]))
        return rows.select("source", "lang", F.lit(kind).alias("kind"), each.alias("e")).select("source", "lang", "kind", "e.*")

    folder = new_path(spark, "token-totals")
    deletions = events(copies.where("copy"), "delete", None, "all")
    token_rollup.commit(folder, "1-load", events(copies, "insert", "all", None))
    token_rollup.commit(folder, "2-copies", deletions)
    token_rollup.commit(folder, "3-lines", events(copies.where(f"not copy and n_{versions[0]} is not null"), "revise", "n", "all"))
    token_rollup.commit(folder, "2-copies", deletions)
    return token_rollup.totals(spark, folder)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048, markers=True)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), repeats=3)
    return mixed.select("doc_id", "size", "source_size", "target", mixing.taken(F.col("pieces")).alias("taken"), "source")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), most=8)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c")
    rows = white.select("vec_id", "n", "deviation", "identity_error", each)
    return rows.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.conversations_of(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.shared_openings(written(convs, "conversations")))


_ALL = (
    op1_ngram_jaccard_join, op2_token_files, op3_secret_scan, op4_language_id, op5_token_rollup, op6_warc, op7_license_scan, op8_best_fit_packing, op9_decontamination, op10_quality_rules,
    op11_source_mixing, op12_embedding_whitening, op13_conversation_trie,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: small_batches(f) for f in _ALL}

__all__ = ["QUERIES", "SQL"]
