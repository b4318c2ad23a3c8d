"""The corpus pipeline: documents are judged, deduplicated, decontaminated,
cleared of secrets and packed. Each stage works on all that its predecessor
kept, and reads its predecessor's rows from Parquet."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, importance, packing, secret_cnn, signature_join
from quire.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near duplicates: words of a shingle, and the least Jaccard similarity in percent. Those of op3's query bind that query alone.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the resampling does not draw go. Rows of one
    id go or stay together; it stays if one of its texts is drawn."""
    kept = importance.resampled(docs, table(spark, sf_dir, "labels")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of linked documents the one with the smallest
    id stays, of equal ids the first row. Groups are found by row, so repeated
    and null ids are rows of their own; documents without words all stay."""
    rows = docs.withColumn("_row", F.monotonically_increasing_id())  # docs is a Parquet table, so a row keeps its number
    groups = signature_join.jaccard_components(rows.select("_row", "text"), size=SHINGLE, percent=PERCENT, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = rows.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(F.min_by("_row", order).alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold an item of the benchmark go."""
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each secret in a text is replaced by a mark, and the characters are counted anew."""
    clean = secret_cnn.without_secrets(docs, secret_cnn.trained(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the pieces of packed sequences."""
    pieces = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing_stage),
]

#: Models, components and token ids are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
