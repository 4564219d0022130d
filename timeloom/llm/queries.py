"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timeloom.llm import decontam, jaccard, mixing, quality_gbt, robust_rules, sharding, spm, substring, tokenfiles, toxicity_fm, vectorcodes, warc, whitening
from timeloom.llm.oracles import ORACLES as ORACLES
from timeloom.llm.support import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), similarity=0.8)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"), min_words=50, similarity=0.8)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.encode_round_trip(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encoding_digests(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_rules.robust_verdicts(_table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"), width=5, similarity=0.8)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_token_files": op6_token_files,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_robust_rules": op9_robust_rules,
    "op10_jaccard": op10_jaccard,
    "op11_vector_codes": op11_vector_codes,
    "op12_mixing": op12_mixing,
    "op13_whitening": op13_whitening,
}
