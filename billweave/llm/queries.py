"""The registered queries of the training-data operators: each over its whole table, with production settings."""

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm import clustering, infill, line_dedup, lm_scores, minhash, mixing, piece_codec, quality, token_counts, token_store, top_k, toxicity, vector_dedup
from billweave.llm.shared import scratch_root

WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of every text and the text they decode to, as digests."""
    docs = documents(spark, folder).select("doc_id", "text")
    coded = piece_codec.with_text(piece_codec.with_pieces(docs, PIECES), PIECES)
    return coded.select(
        "doc_id",
        F.size("piece_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("piece_ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every text, the fixed verdict and the adaptive one."""
    judged = quality.judged(documents(spark, folder))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of lines within two edits: one row per distinct line."""
    return line_dedup.line_classes(documents(spark, folder)).drop("line")


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are similar to 80 % or more."""
    return minhash.components_of(documents(spark, folder), width=2, percent=80)


def op5_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, written as range-coded blocks and read back."""
    store = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    token_store.write_tokens(documents(spark, folder), WORD_PIECES, store)
    read = token_store.read_tokens(spark, store)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram token counts of every text."""
    docs = documents(spark, folder).select("doc_id", "text")
    return token_counts.with_token_counts(docs, PIECES).select("doc_id", "n_pretokens", "n_tokens")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes from every document."""
    return mixing.mixed(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of vectors of one label with a cosine of 0.93 or more."""
    return vector_dedup.linked(spark.read.parquet(f"{folder}/embeddings.parquet"), threshold=0.93)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every text, learnt from the labelled ones that are not held out."""
    docs = documents(spark, folder).select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    return toxicity.toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op10_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Stupid-backoff score of every text by the n-grams of all others."""
    return lm_scores.scores(documents(spark, folder))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Fill-in-the-middle form of every text, and the text rebuilt from it, as digests."""
    made = infill.fill_in_middle(documents(spark, folder).select("doc_id", "text"))
    counts = ("n", "form", "prefix_chars", "middle_chars")
    return made.select(
        "doc_id",
        *(f"fim.{c}" for c in counts),
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("fim.form"), F.col("fim.output")), 256).alias("restored_sha256"),
    )


def op12_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector with all others."""
    return top_k.top_k(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster and distance of every vector after three rounds over 16 centroids."""
    return clustering.clusters(spark.read.parquet(f"{folder}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
