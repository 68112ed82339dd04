"""From raw documents to token ids: toxicity, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, documents, folder of the given tables) and returns a DataFrame. All but the last return the
columns of documents.

In every stage null and empty texts are texts without words: no model rejects them, no other is like them, they repeat no
test item, and the mix, which takes words, leaves them out. Rows that share a doc_id, or have none, are rows of
their own, except that of a group of near copies one row stays. Further columns are carried along, whatever their
names, and no rows give no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aftershock.llm import decontaminate, jaccard, mixing, token_ids, toxicity
from aftershock.llm.common import staged, table
from aftershock.llm.vocabulary import tokenizer_path

#: A document is dropped as a near copy if its word 5-grams are that similar (percent) to those of a kept one.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject; the model is fitted on the given documents and labels."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return jaccard.keep_one_of_each_group(docs, NEAR_WORDS, NEAR_PERCENT)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no window of a test item; a document with a hit goes as a whole."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"), max_coverage=0.0)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written to a new shared folder and read back: one row per document of the mix."""
    return token_ids.token_ids(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near copies", remove_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token ids", write_token_ids),
]

#: SQL can express neither the fitted model nor the tokenizer; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = staged(docs, "stage")
    return docs
