"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of documents (doc_id, text, lang, source, n_chars). SQL can't express the stages; the tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlog.llm import op1_ngram_jaccard, op3_mixing, op5_langid, op7_packing, op10_secrets
from weftlog.llm.common import Written, table

#: Language ID rejects a document below this score (a guess among four languages has 0.25 at least).
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go.

    Null and empty texts and texts without a letter go; very long ones are judged whole; repeated rows each stay or go; ties
    of languages change nothing; an empty table gives an empty one; a null id never trains; further columns are left out.
    """
    return op5_langid.known(docs, op5_langid.train(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the one with the smallest id (null last). Shingles of five words, a similarity of 0.8.

    Texts without words are similar to none and stay; very long ones are compared whole; of ties (one id, several texts in
    a group) the text with the smallest fingerprint stays; rows that repeat id and text are one; of rows that share an id
    alone each goes or stays by its own text; an empty table gives an empty one; further columns are kept.
    """
    return op1_ngram_jaccard.first_of_groups(docs, words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays.

    A null text stays null, an empty one empty; very long ones are read whole; repeated rows each stay; overlapping secrets
    are one; an empty table gives an empty one; further columns are left out.
    """
    return op10_secrets.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as their source's budget takes them.

    Texts without words (null, empty, blank) go; a very long one is cut only at its source's budget; a null source is a
    source; rows of one id, source and size get equal shares; an empty table gives an empty one; further columns are left out.
    """
    return op3_mixing.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 tokens.

    A null or empty text is the closing id alone; very long ones are cut into whole sequences and a rest; rows that repeat
    are packed each; ties of lengths go by place; an empty table gives an empty one; further columns are left out.
    """
    return op7_packing.pack(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    store = Written(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = store.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            store.drop(before)
        before = docs
    return docs
