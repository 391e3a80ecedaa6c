"""A training corpus in five stages: quality, near-duplicates, repeated passages, benchmark leaks, tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import byte_bpe, decontam, quality, similar, substring_dedup
from quadrille.llm.common import free_name, id_crc, stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose text the classifier scores 0.3 or more; it learns from labels outside the held-out fold.

    A null text is scored as an empty one; equal texts have equal scores, whatever their ids, null too. A very long text
    is scored whole. Repeated rows stay repeated; an empty table stays empty. Other columns stay, whatever their names.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.pmod(id_crc(), F.lit(5)) != 0)
    return docs.filter(quality.scorer(docs, model)(F.col("text").cast("string")) >= 0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles with a similarity of 0.8 or more: the least id's.

    Of a group the row with the least (doc_id, hash of text) stays, once. Texts without words, null too, are copies of
    each other; a text of fewer than five words is one shingle. Rows with a null doc_id take no part and stay. An empty
    table stays empty. Other columns stay, whatever their names.
    """
    return similar.without_copies(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words or more out of documents if a smaller id has them; a text that loses all its words goes.

    Null, empty and shorter texts stay as they are, and so do rows with a null doc_id. Rows with equal ids don't repeat
    each other; each repeated row is shortened alike. n_chars, where there is one, follows the text; other columns stay,
    whatever their names. An empty table stays empty.
    """

    @F.pandas_udf("string")
    def shortened(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in parts:
            yield pd.Series([substring_dedup.without_spans(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    spans = free_name("_spans", docs)
    marked = substring_dedup.with_spans(docs, spans)
    text = F.when(F.col(spans).isNotNull(), shortened(F.col("text").cast("string"), F.col(spans))).otherwise(F.col("text"))
    out = marked.withColumn("text", text).filter(F.col(spans).isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows in whose text tiles cover 0.8 or more of a benchmark item.

    The text decides, whatever the id: leaks with a null id go, and of two texts under one id only those that leak. Null
    and empty texts stay. Repeated rows share a verdict. Empty tables stay empty, and an empty benchmark drops nothing.
    Other columns stay, whatever their names.
    """
    key = free_name("_key", docs)
    texts = docs.select(similar.text_key().alias("doc_id"), "text")
    leaks = decontam.contaminated(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, similar.text_key()).join(leaks, key, "left_anti").select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of what they decode to, for each row.

    A null text has no tokens; a null doc_id is kept; repeated rows each give a row, an empty table none. Other columns
    are not read.
    """
    import public_tokenizers

    return byte_bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality_filter), ("near_dedup", near_copies), ("passage_dedup", passage_dedup), ("decontamination", decontaminate), ("tokens", tokenise)]

#: A learned classifier and a fingerprint of hashes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
