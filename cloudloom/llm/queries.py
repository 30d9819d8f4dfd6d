"""The registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontamination, jaccard, language, licenses, lm, merkle, minhash, packing, quality, ranking, tokencount, topk
from .common import crc_mod, table
from .oracles import ORACLE_SQL  # noqa: F401


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = f"{chat.END}{chat.START}assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    records = chat.records_of_rows(rows.unionByName(own))
    return chat.read_back(chat.format_records(records, "conv_id", "record"))


def language_training_rows(docs):
    """key (the row's number), text and lang of the rows that language identification may learn from."""
    rows = docs.select(F.monotonically_increasing_id().cast("string").alias("key"), "doc_id", "text", "lang")
    return rows.where(crc_mod("doc_id", 5) != 0).select("key", "text", "lang")


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(language_training_rows(docs)))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op6_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("matches.template"))), ",")
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), names.alias("licenses"), F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("best_coverage"), F.to_json("matches").alias("matches"))


def op7_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = lm.score(docs, docs.where(crc_mod("doc_id", 7) != 2), tokenizer("byte_bpe_50k.json"))
    return found.withColumn("held_out", crc_mod("doc_id", 7) == 2)


def quality_training_rows(docs, labels):
    """key (the row's number), text and quality of the rows that the quality classifier may learn from; one label for each doc_id."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.select(F.monotonically_increasing_id().cast("string").alias("key"), "doc_id", "text")
    rows = rows.where((crc_mod("doc_id", 4) != 2) & F.col("doc_id").isNotNull())
    return rows.join(marks, "doc_id").select("key", "text", "quality")


def op8_topk_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(quality_training_rows(docs, table(spark, sf_dir, "labels"))))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 4096)


def op5_benchmark_decontamination(spark, sf_dir):
    return decontamination.digest(decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("items", "spans")


def op10_ngram_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_minhash_near_dedup(spark, sf_dir):
    """The component of each document under links of a similarity of 0.80 of two-word shingles, and whether it is kept."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark, sf_dir):
    """The 50 best documents of each benchmark item."""
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark, sf_dir):
    """Every row of documents, its proof, and whether its leaf, tampered with or not, folds to the root."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_language_id, op3_token_counts, op4_best_fit_packing, op5_benchmark_decontamination,
        op6_license_scan, op7_lm_scoring, op8_topk_search, op9_quality_classifier, op10_ngram_jaccard_join,
        op11_minhash_near_dedup, op12_ranked_search, op13_merkle_manifest,
    )
}
