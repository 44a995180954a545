"""A training corpus from ``documents``: five stages, each one of the operators of ``keysweep.llm``.

Every function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents: doc_id, text, lang, source and n_chars.

Edge cases, in every stage: an empty table gives an empty table; other columns than those of documents are dropped, whatever
their names; texts of any length are taken whole. What a stage does with nulls, empty texts and repeated rows stands with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysweep.llm.common import materialize, read
from keysweep.llm.jaccard import BROADCAST_KEYS, join, with_set_id
from keysweep.llm.packing import pack
from keysweep.llm.quality_model import classify
from keysweep.llm.quality_rules import clean
from keysweep.llm.suffix_dedup import dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go. A null text is judged as an empty one and stays null if it is kept;
    nulls in other columns mean nothing; each of several rows of a doc_id is judged by itself."""
    return classify(docs, keep=tuple(COLUMNS)).where("kept").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the line rules go, and documents that base or the loss of too much text rejects. Null and empty texts have
    too few words and go; each of several rows of a doc_id is judged by itself; n_chars is that of the text that is left."""
    kept = clean(docs, keep=("lang", "source")).where("kept")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row with the smallest doc_id stays (where that repeats, its smallest set; of
    rows equal in both, one). Rows without words are in no component: of those equal in doc_id and text, one stays."""
    found = join(docs)  # a table already
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = materialize(again, "pipeline-repeated")
    gone = found.where("component_id <> doc_id").select("doc_id").union(again).distinct()
    kept = docs.join(_few(gone), "doc_id", "left_anti").select(*COLUMNS)
    if again.isEmpty():
        return kept
    # A doc_id of several rows says nothing about each of them: these are told apart by their sets.
    stays = (found.where("label is not null and component_id = doc_id").join(_few(again), "doc_id")
             .groupBy("label", "doc_id").agg(F.min("set_id").alias("set_id"), F.lit(True).alias("stays")).drop("label"))
    rows = with_set_id(docs.join(_few(again), "doc_id").select(*COLUMNS))
    rows = (rows.join(stays, ["doc_id", "set_id"], "left").where("set_id is null or stays")
            .groupBy("doc_id", "set_id", F.when(F.col("set_id").isNull(), F.col("text")).alias("blank"))
            .agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")))
    return kept.union(rows.select("doc_id", "row.*"))


def _few(ids: DataFrame) -> DataFrame:
    """Broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that also start earlier go; what is left of a character that is cut goes too. Every document
    stays: null and empty texts lose nothing (null becomes empty), and a text whose bytes all go is empty. Rows that are equal in
    doc_id and text are one document for this."""
    left = dedup(docs, keep=("lang", "source"), as_text=True)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece. A null or empty text is its end token alone; rows of one doc_id are packed
    one by one, each with its own pieces."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_dedup),
    ("packing", packing),
]

#: No SQL: the classifier is trained, and the packing's tokenizer isn't known to SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
