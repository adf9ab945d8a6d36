"""The registered queries of this subpackage: each operator, with production parameters, over its
whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, infill, langid, minhash, mixing, packing, passages, quantize, secret_scan, sharding, simhash, suffix_dedup
from .sql import oracle_sql

__all__ = ["oracle_sql", "queries"]

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _secrets(docs: DataFrame) -> DataFrame:
    """The table's versions come in two runs, by the hash of the id: the second scans only blobs that
    the ledger of the first doesn't hold."""
    later = F.xxhash64("doc_id") < 0
    found = secret_scan.secrets(docs, runs=[~later, later])
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    spans = secret_scan.span_text(F.col("found"))
    return found.select("doc_id", *[count(r.kind) for r in secret_scan.RULES], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _bpe(docs: DataFrame) -> DataFrame:
    done = bpe.encode(docs, decoded=True)
    return done.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _langid(docs: DataFrame) -> DataFrame:
    told = langid.identify(docs, langid.fit(docs))
    return told.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def _suffixes(docs: DataFrame) -> DataFrame:
    done = suffix_dedup.dedup(docs)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["hi"] - x["lo"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _passages(docs: DataFrame) -> DataFrame:
    done = passages.dedup(docs)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["hi"] - x["lo"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def _mixing(docs: DataFrame) -> DataFrame:
    first, last = (F.try_element_at("positions", F.lit(n)).alias(name) for n, name in ((1, "position"), (-1, "last_position")))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("bigint").alias("passes"), first, last)


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": _table("documents", sharding.assign),
        "op2_secret_scans": _table("documents", _secrets),
        "op3_bpe": _table("documents", _bpe),
        "op4_language_id": _table("documents", _langid),
        "op5_nearest_neighbours": _table("embeddings", ann.search),
        "op6_fingerprints": _table("documents", minhash.chained),
        "minhash_classes": _table("documents", minhash.near_duplicates),
        "op7_suffix_dedup": _table("documents", _suffixes),
        "op8_mixing": _table("documents", _mixing),
        "op9_passage_dedup": _table("documents", _passages),
        "op10_simhash": _table("documents", simhash.near_duplicates),
        "op11_fill_in_middle": _table("documents", lambda docs: infill.transform(docs).drop("output")),
        "op12_best_fit_packing": _table("documents", lambda docs: packing.pack(docs).drop("ids")),
        "op13_vector_codes": _table("embeddings", lambda vectors: quantize.compress(vectors)[0]),
    }
