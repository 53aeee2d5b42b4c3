"""The thin queries over the synthetic tables, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, exact, language_model, lines, merkle, neighbours, passages, phrases, pieces, pii, simhash, token_store, toxicity
from .common import crc_mod, read_table

#: The end id of op7.
END_ID = 2


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    held = (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out")
    return toxicity.score(docs.select("doc_id", "text"), model).select(F.col("doc_id").cast("long").alias("doc_id"), held, "score", "predicted")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), END_ID)
    return token_store.read(manifest, with_ids=False)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read_table(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours.usable(read_table(spark, sf_dir, "embeddings"))
    return neighbours.MultiIndex(rows).search(rows.where("vec_id % 20 = 0"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.when(crc_mod(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(merkle.leaves(docs, tampered), carry=("changed",))
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.col("proof"), F.col("changed")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(read_table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_passages": op4_passages,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_token_store": op7_token_store,
    "op8_pii": op8_pii,
    "op9_language_model": op9_language_model,
    "op10_neighbours": op10_neighbours,
    "op11_phrases": op11_phrases,
    "op12_merkle": op12_merkle,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": lines.SQL + """
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN lost.c IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text,
               CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(lost.c, 0) AS n_dropped
        FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
    """,
    "op2_decontaminate": decontaminate.SQL,
    "op11_phrases": phrases.SQL,
    "op12_merkle": merkle.SQL,
    "op13_exact_dedup": exact.SQL,
}
