"""Documents to a training mix: toxicity, line dedup, near-duplicates, mixing, tokens.

`run` applies the stages one after the other; each takes (spark, docs, sf_dir), where docs has the columns of documents, and all but the last return
those columns. Rows may be null, empty or repeated in any column; columns beyond those of documents are kept.

A stage's result reads tables that the stage wrote for itself. They go when the next stage begins, except those that its `docs` still read.
So a result is to be written, or given to the next stage, before that.
"""

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm import line_dedup, minhash, mixing, piece_codec, toxicity
from billweave.llm.shared import discard, known_id, recorded, write_table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
# SQL has no tokenizer, classifier or MinHash: the stages are tested against brute force.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.toxicity(docs.withColumn("_row", F.struct(*docs.columns)).select("doc_id", "text", "_row"), labels)
    return scored.filter("predicted = 0").select("_row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats within two edits; those with nothing else go."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with sets of five-word shingles similar to 80 % or more."""
    return minhash.without_near_duplicates(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    copies = mixing.mixed(docs).groupBy("key").agg(F.max("copies").alias("_copies"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), known_id("doc_id", "text").alias("key"))
    times = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return rows.join(copies, "key").filter("_copies > 0").select("_row", times.alias("_time")).select("_row.*")


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    coded = piece_codec.with_text(piece_codec.with_pieces(docs.select("doc_id", "text"), PIECES), PIECES)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), piece_codec.MARK, " ")
    return coded.select("doc_id", F.size("piece_ids").cast("bigint").alias("n_tokens"), "piece_ids", same.alias("decodes"))


_left: list[str] = []  # tables that stages wrote for themselves


def tidy(stage: Callable) -> Callable:
    """The stage, after deleting what earlier stages left and `docs` does not read."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {folder for file in docs.inputFiles() for folder in file.split("/")} if _left else set()
        for path in [p for p in _left if p.rpartition("/")[2] not in read]:
            discard(spark, path)
            _left.remove(path)
        with recorded(_left):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", tidy(toxicity_stage)),
    ("line dedup", tidy(line_dedup_stage)),
    ("near-duplicates", tidy(near_duplicate_stage)),
    ("mixing", tidy(mixing_stage)),
    ("pieces", tidy(piece_stage)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over documents; every stage is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = write_table(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
