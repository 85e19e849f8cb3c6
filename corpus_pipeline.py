"""From raw documents to token ids: quality rules, near duplicates, personal data, source mix, sampled pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. The mix and the sampled segmentation can't be expressed in SQL, so there is no ORACLE_SQL; the tests hold each
stage against a brute-force version.

Extra columns, whatever their names, go along to the mix. An empty table has an empty result. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import mixing, ngrams, pieces, pii, quality
from tidelog.llm.common import materialise, table

#: Near duplicates: words to a shingle, and the per cent of similarity from which documents are one group.
NEAR_WORDS, NEAR_SIMILAR = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that many documents of their source share.

    Null and empty texts fail. A null source is a source of its own. Repeated rows are judged alike, and all stay.
    """
    return quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id.

    Of rows that repeat a doc_id one stays, the first by text and then by the other columns, so reruns agree. Rows without
    a doc_id all stay.
    """
    return ngrams.one_of_each(docs, NEAR_WORDS, NEAR_SIMILAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. A null text stays null; repeated rows stay."""
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, which may be never.

    Documents without words are never taken. Reruns take the same ones.
    """
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids. A null text has no pieces; rows that share doc_id and text have the same ones."""
    return pieces.encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
