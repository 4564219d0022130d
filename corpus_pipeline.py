"""From raw documents to token ids: five stages, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timeloom.llm import decontam, jaccard, spm, substring, support, toxicity_fm

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; the model learns from the labelled ones of them."""
    model = toxicity_fm.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    name = support.free_name(docs, "score")
    return toxicity_fm.score_toxicity(docs, model, name).where(f"{name} < 0.5").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each class of near copies."""
    return jaccard.keep_one_of_each(docs, jaccard.jaccard_classes(docs, width=5, similarity=0.8))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document holds; one of
    which nothing is left goes."""
    return substring.remove_passages(docs, substring.repeated_passages(docs, min_words=50, similarity=0.8))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither word for word nor with other values."""
    return decontam.remove_contaminated(docs, decontam.contaminated(docs, _table(spark, sf_dir, "benchmark"), similarity=0.8))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with its number and origin."""
    import public_tokenizers

    return spm.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Models, min-hashes and the search for pieces are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = support.spread(_table(spark, sf_dir, "documents"))
    for _, stage in STAGES:
        out = support.shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
