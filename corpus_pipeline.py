"""Corpus pipeline over ``documents``: language identification, line dedup,
near-duplicates, mixing sources to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet into the shared folder and reads it back as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import bpe, langid, linededup, minhash, mixing
from tarmac.llm.common import WORD, read_table
from tarmac.llm.queries import TOKENIZER
from tarmac.session import scratch_path

MIN_SCORE = 0.5         # of the predicted language
NEAR_PERCENT = 80       # similarity of near-duplicates
ORACLE_SQL = None       # hashed models, signatures and draws aren't SQL; the tests compare with brute force


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with columns of an operator's own names out of its way."""
    return docs.withColumnsRenamed({c: f"own {c}" for c in docs.columns if c in names})


def _columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, those set aside under their names again."""
    return found.select(*[F.col(f"`own {c}`" if f"own {c}" in found.columns else f"`{c}`").alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters, or without a language
    of probability ``MIN_SCORE``, go. A null ``lang`` takes the prediction.
    Columns named like the model's keep their values; an empty table stays
    empty."""
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(_aside(docs, "lang_pred", "score"), model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return _columns(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are deleted; documents of which no word
    is left go. A column ``deleted_lines`` of the documents keeps its values."""
    found = linededup.dedup_lines(_aside(docs, "deleted_lines"))
    text = F.col("text")
    return _columns(found.where((F.col("deleted_lines") == 0) | text.rlike(WORD))
                    .withColumn("n_chars", F.when(F.col("deleted_lines") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the
    smallest id. Rows go by id and text, so another text with the same id, or
    without one, has its own verdict."""
    return minhash.without_near_duplicates(docs, percent=NEAR_PERCENT).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy that it takes, dealt to shards and shuffled
    inside them. Columns named like the plan's keep their values."""
    return _columns(mixing.mixed_documents(_aside(docs, "draws", "of", "of_id", "words", "mix_words", "mix_draw", "mix_shard", "mix_epoch")), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, decoded`` of every copy."""
    coded = bpe.encode_documents(docs, TOKENIZER, decoded_col="decoded", keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language id", language_id), ("line dedup", line_dedup), ("near-duplicates", near_duplicates),
          ("mixing", mix_sources), ("bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
