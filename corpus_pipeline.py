"""A training-data pipeline: languages known to us, clean of abuse, each text once, packed for training.

Null and empty texts have no language and go in the first stage. Of rows repeated under one id, or of
equal texts without any id, one stays. A null id is an id like others. An empty table gives an empty
result. Further columns are handed on up to the last stage, under whatever name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segmentary.llm import language_id as languages
from segmentary.llm import toxicity as toxic
from segmentary.llm._common import materialize, sent_to_all, table
from segmentary.llm.exact_dedup import keep_one
from segmentary.llm.minhash import near_dedup
from segmentary.llm.packing import best_fit_packing
from segmentary.llm.queries import PATTERN, RANKS_50K, SPECIAL_50K


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from ``docs`` itself; those without letters or in no such language go."""
    return languages.keep_known_languages(docs, languages.train(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    return toxic.keep_clean(docs, toxic.train(docs, table(spark, sf_dir, "labels")))


def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id."""
    return keep_one(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words to a shingle, a similarity of 0.8 or more."""
    gone = materialize(near_dedup(docs).filter("NOT kept").select("doc_id").distinct())
    return docs.join(sent_to_all(gone), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return best_fit_packing(docs, RANKS_50K, PATTERN, special=SPECIAL_50K)


STAGES = [
    ("language ID", known_language),
    ("toxicity", not_toxic),
    ("exact dedup", once),
    ("near dedup", no_near_copies),
    ("packing", packed),
]

#: Two stages are learned classifiers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
