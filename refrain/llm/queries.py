"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.common import few_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_text(name: str) -> str:
    """The driver reads a public vocabulary file and ships its text; executors need no such file."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refrain.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refrain.llm.quality_rules import verdicts

    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1")).withColumn("ratio", F.round("ratio", 6))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refrain.llm.substring_dedup import passages

    return passages(table(spark, sf_dir, "documents")).withColumnsRenamed({"doc": "doc_id", "other": "other_id"})


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from refrain.llm.sentencepiece_unigram import encode, load

    out = encode(table(spark, sf_dir, "documents"), load(public_tokenizers.path("piece_bpe_32k.model")))
    return out.withColumn("n_pieces", F.size("ids").cast("long"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refrain.llm.line_dedup import clean_lines

    return clean_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def op6_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refrain.llm.sharding import shards

    return shards(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refrain.llm.common import crc_fold
    from refrain.llm.language_id import classify, learn

    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 3) == 1
    return classify(docs, learn(docs.where(~held_out), "doc_id", "text", "lang"), carry={"held_out": held_out})


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refrain.llm.jaccard import similarity_components

    return similarity_components(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refrain.llm.common import crc_fold
    from refrain.llm.quality_classifier import scores, train

    docs, held_out = table(spark, sf_dir, "documents"), crc_fold("doc_id", 5) == 0
    return scores(docs, train(docs, table(spark, sf_dir, "labels").where(~held_out)), carry={"held_out": held_out})


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refrain.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_text("word_bpe_49k.json"), with_ids=False)


def _in_few_files(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return few_files(query(spark, sf_dir))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries; their results come in few files, as those of materialise()."""
    return {k: _in_few_files(v) for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from refrain.llm import line_dedup

    return {"op5_line_dedup": line_dedup.ORACLE}
