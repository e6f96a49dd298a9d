"""The corpus pipeline: filters, near-duplicate removal, decontamination, then encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``, whole rows as they came, whatever their names. A filter decides on a text, so rows are
dropped by id and text: rows that share an id keep their own verdicts, and rows with a null id are
filtered like others. Rows without an id or words are never near duplicates; of rows repeated as a whole
one stays. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import contamination, jaccard, langid, pieces, rules
from pagequarry.llm.common import matched, materialize, table
from pagequarry.llm.queries import tokenizer


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text hash are no row of ``dropped``."""
    return matched(docs, [docs["doc_id"], F.xxhash64(docs["text"])], materialize(dropped.distinct()), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    found = rules.apply_rules(docs, table(spark, sf_dir, "labels"), tagged=True)
    return _without(docs, found.where(~F.col("kept")).select("doc_id", "tag"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with more than a narrow margin."""
    return langid.filter_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that near copies link."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = docs.select(F.struct(docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("tag")).alias("doc_id"), docs["text"].alias("text"))
    found = contamination.find_contained(keyed, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id.id", "doc_id.tag"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each text."""
    return pieces.encode_pieces(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("piece_encoding", piece_encoding),
]
#: Learned rules, compression and the piece model have no SQL: a test does each stage's work again in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
