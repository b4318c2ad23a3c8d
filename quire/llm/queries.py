"""The registered queries of this package: one for each operator, over its
whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, importance, license_lookup, packing, periodic_runs, prefix_counts, ranked_ids, rule_cascade, secret_cnn, signature_join, spectral_whitening, suffix_tree, warc_chain
from quire.llm.common import shared_path, table

TOKEN_LIMIT = 512


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.suffix_scores(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts.prefix_counts(table(spark, sf_dir, "documents"), vocabulary())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_cnn.found_spans(docs, secret_cnn.trained(docs))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != secret_cnn.FOUND)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secret_cnn.KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op5_license_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_lookup.licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "license", F.when(F.size("notices") > 0, F.array_join("notices", ",")).alias("notices"), "n_notices")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "n_grams", "log_weight", F.lit(True).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_cascade.quality_rules(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_chain.archived(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    written = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(written, F.lit("\n"))).otherwise("")
    longest = found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_ranked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "ranked-ids")
    ranked_ids.write_ids(table(spark, sf_dir, "documents"), vocabulary(), path)
    return ranked_ids.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_spectral_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral_whitening.whitened(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_token_counts": op2_token_counts,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_secret_scan": op4_secret_scan,
    "op5_license_lookup": op5_license_lookup,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_quality_resampling": op8_quality_resampling,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ranked_ids": op12_ranked_ids,
    "op13_spectral_whitening": op13_spectral_whitening,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op3_jaccard_join": signature_join.ORACLE,
    "op5_license_lookup": license_lookup.ORACLE,
    "op9_quality_rules": rule_cascade.ORACLE,
    "op10_warc": warc_chain.ORACLE,
}
