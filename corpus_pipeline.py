"""From raw documents to token ids: five stages, each an operator of ``casewright.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Nulls, empty tables, repeated rows and extra columns pass as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casewright.llm import decontaminate, sentencepiece_scan, simhash, suffix_dedup, toxicity
from casewright.llm._common import staged, table

#: Words of a repeated passage: over fifty.
PASSAGE = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from their labels, scores under 0.7."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of exact and near copies: SimHash fingerprints two bits apart
    or fewer, by blocks, and the wider similarity of shingle sets beside them."""
    return simhash.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that also stand elsewhere."""
    return suffix_dedup.remove_repeated_words(docs, words=PASSAGE)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document left."""
    return sentencepiece_scan.token_rows(docs, sentencepiece_scan.default_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_leaks),
    ("tokens", tokenize),
]

#: No SQL expresses the learned and the sampled stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
