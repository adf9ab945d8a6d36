"""A training corpus in five stages, from ``documents`` to token streams.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from httplens.llm import bpe, langid, mixing, secret_scan, simhash
from httplens.llm.lineage import release, scoped, staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that no known language can parse, go. The model learns
    from the documents' own labels; ``lang`` is left as it came. Null texts have no letter; repeated
    rows and null ids are judged each for itself; an empty table stays empty."""
    told = langid.identify(docs, langid.fit(docs), id_col=None)
    known = (F.col("lang_pred") != langid.UNKNOWN) & ((F.col("phrase_rate") < langid.NOISE) | (F.char_length("row.text") < langid.SHORT))
    return told.where(known).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id, null last, of
    rows that repeat it that of the smallest hash of the text. Null and wordless texts are one group
    (with what links to them); an empty table stays empty."""
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; all rows stay, ``n_chars`` follows the text (null for a
    null text)."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training; ties by a hash of id and
    text. Null and wordless texts have nothing to take; an empty table stays empty."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, exact): ids are unsigned 32-bit, little-endian; exact tells
    that they decode to the text. A row for each row; null text has no tokens; an empty table gives
    an empty one."""
    done = bpe.encode(docs, id_col=None, decoded=True)
    exact = F.col("decoded") == F.coalesce("row.text", F.lit(""))
    return done.select("row.doc_id", "row.source", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mix), ("bpe", tokens)]

#: Language ID, SimHash components and BPE aren't SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scoped(spark) as keep:
            after = keep(staged(stage(spark, docs, sf_dir)))
        release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
