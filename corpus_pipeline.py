"""From raw documents to token ids in five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomix.llm import decontamination, line_dedup, near_dedup, pieces, toxicity
from fathomix.llm.queries import held_out
from fathomix.storage import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the text as it now is."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it is trained on labelled rows of its input."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), held_out=held_out)
    name = "score"
    while name in docs.columns:  # a column of the documents keeps its name
        name += "_"
    return toxicity.score(docs, model, name=name).filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs across texts."""
    return _recounted(line_dedup.drop_recurring_lines(docs, min_tokens=line_dedup.EVERY_LINE))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of a similarity of 0.8 or more."""
    return near_dedup.drop_near_copies(docs, percent=80, bands=36)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: cut out, or the document dropped if they are 5 % of it."""
    return _recounted(decontamination.remove_contamination(docs, _table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_ids of every document that is left."""
    return pieces.encode_pieces(docs, keep=["doc_id"]).select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pieces", encode),
]

#: SQL expresses neither the classifier nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
