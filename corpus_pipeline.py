"""From raw documents to tokens: quality, near-duplicates, personal data, mix, BPE.

``STAGES`` holds (name, function) pairs. A function takes (spark, docs, sf_dir), where ``docs`` is what
the stage before has left, and returns rows with the columns of ``documents``; the last returns tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.bpe import encoded_and_checked
from loomgraph.llm.minhash import near_duplicates_removed
from loomgraph.llm.mixing import mix_documents
from loomgraph.llm.pii import mask_pii
from loomgraph.llm.quality import good_documents
from loomgraph.runtime import materialise, table

TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    return near_duplicates_removed(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind."""
    return mask_pii(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each pass over a document, so that sources come to their target weights."""
    return mix_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, token_ids, round_trip``: tokens, and whether they decode to the text."""
    return encoded_and_checked(docs, public_tokenizers.path(TOKENIZER)).select(
        "doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip"
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("pii", pii),
    ("source_mix", source_mix),
    ("bpe", bpe),
]
#: The classifier and the seeded draw of the mix can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
