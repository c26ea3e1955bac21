"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookwise.functions.staging import stage
from bookwise.llm import jaccard, mixing, packing, quality_classifier, quality_rules
from bookwise.llm.common import table
from bookwise.llm.tokens import tokenizer_path


#: Rows of an Arrow batch: whole texts cross to Python, so a batch of Spark's 10,000 rows would hold tens of MB on both sides.
ARROW_ROWS = 500


def _short_batches(spark: SparkSession) -> None:
    """Let texts cross in short batches, unless the session asks for shorter ones. The setting stays: the stage runs when it is written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read more like the labelled good ones than like the rest.

    Null, empty and blank texts have no words and go. Equal texts fare alike, repeated
    rows all stay or all go; a document at the threshold stays; other columns are
    carried whatever their names; an empty table stays empty. Without labels every
    document that passes the base rules stays.
    """
    _short_batches(spark)
    trusted = quality_rules.trusted_documents(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_rules.keep(docs, quality_rules.fit(docs, trusted))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours are good.

    Null, empty and blank texts are judged like any other, as texts without terms.
    Repeated rows all stay or all go; a score of exactly one half stays; other columns
    are carried whatever their names; an empty table stays empty.
    """
    _short_batches(spark)
    return quality_classifier.keep(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Null, empty and blank texts are linked with nothing and all stay. Of rows that are
    equal in doc_id and text one stays; a null doc_id counts as the largest. Other
    columns are carried whatever their names; an empty table stays empty.
    """
    _short_batches(spark)
    return jaccard.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix of the sources: documents repeated or left out as their source's target asks.

    A null source is a source of its own, the last one. Null, empty and blank texts
    have no words and fill no target: they may be taken or left out without changing
    it. Repeated rows are numbered and taken each for itself; ties fall by seeded hashes;
    other columns are carried whatever their names; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    A null or empty text is its end token alone. Repeated rows are packed each for
    itself; texts of any length are cut, every token lies in one piece; other columns
    end here; an empty table gives no pieces.
    """
    _short_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("ngram_jaccard", near_copies_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: No SQL: the classifier, the draw of the mix and the tokenizer are out of its reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
