"""A training corpus from raw documents, in stages that are written in between.

Each stage works on all rows that its predecessor kept; all but the last give
the columns of ``documents``.  Texts that a stage changes get their new
``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlytics.llm import language_id, pii
from convlytics.llm.ngram_join import jaccard_components
from convlytics.llm.packing import pack
from convlytics.llm.queries import vocabulary
from convlytics.llm.scratch import Scratch, settle
from convlytics.llm.suffix_dedup import remove_repeats


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they now are."""
    n = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))
    return docs.select(*[n.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that no language's centroid is near to go."""
    settle(spark)
    return language_id.accepted(docs, language_id.fit(docs.where(~language_id.held_out()).select("doc_id", "text", "lang")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near copies (five words, 0.8) the smallest doc_id stays.

    Repeated rows of that document become one.
    """
    settle(spark)
    keep = (jaccard_components(docs, k=5, num=8, den=10)
            .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__rows")))
    joined = docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")))
    once = joined.where("__rows = 1").select(*docs.columns)
    more = joined.where("__rows > 1").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.union(more)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: passages of 50 words stay in the document with the smallest id."""
    settle(spark)
    return _measured(remove_repeats(docs))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data are replaced by their kind."""
    settle(spark)
    return _measured(pii.redact(docs, pii.fit(docs.select("doc_id", "text"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of token sequences, with their ids."""
    settle(spark)
    return pack(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("identify_language", identify_language),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("redact_pii", redact_pii),
    ("pack_sequences", pack_sequences),
]

#: SQL cannot state the learned stages; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
