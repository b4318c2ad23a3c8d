"""The dataset build job over real input files.

AI posts (JSON arrays) and human posts (CSV) are cleaned and filtered, each
class is deduplicated on its normalised key (first wins), the human class is
read per file only up to an oversampled target and sampled evenly across
files, both classes are balanced, and the result is split 80/10/10 by label
and written as CSV per split; the combined AI set is written as JSON lines.
Sizes that steer later steps (class sizes, per-file targets) stay in one-row
tables joined into the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import constants as K
from quire.functions import text as tx
from quire.functions.hashing import md5_order
from quire.operators import ranking as rk
from quire.operators import reports as rp
from quire.operators import sampling as smp
from quire.session import cut_lineage
from quire.sources import io

LanguageFilter = Callable[[DataFrame], DataFrame]


def _usable(df: DataFrame, english: LanguageFilter | None) -> DataFrame:
    df = df.withColumn("text", tx.clean("text")).filter(F.length("text") > 0)
    return english(df) if english else df


def prepare_dataset(spark: SparkSession, ai_paths: list[str], human_paths: list[str], out_dir: str | None = None,
                    text_column: str = "tweet", csv_columns: list[str] | None = None,
                    english: LanguageFilter | None = None, chunk_rows: int = K.CHUNK_ROWS,
                    seed: int = K.SEED) -> dict[str, DataFrame]:
    """Build the labelled dataset. ``english`` filters a DataFrame with a
    ``text`` column to English rows (e.g. a trained trigram model plus
    ``length >= 3``); None keeps every language."""
    # AI class: all files, cleaned, keyed dedup across files (first wins)
    ai = _usable(io.read_json_items(spark, ai_paths, "ai"), english)
    rp.require_rows(ai, "AI input files")
    # stage boundaries are checkpointed into spark.checkpoint.dir: later
    # steps read each stage several times, and plans stay small
    ai = cut_lineage(smp.dedup_first(ai, tx.dedup_key("text"), "seq").drop("dedup_key"))
    n_ai = ai.agg(F.count("*").alias("_n_req"))

    # Human class: per file, stop after the chunk reaching int(n/k*1.7)+100
    k_files = max(1, len(human_paths))
    target = n_ai.select(smp.oversample_target(F.col("_n_req"), k_files).alias("_target"))
    raw = io.read_csv_column(spark, human_paths, text_column, csv_columns)
    usable_rows = _usable(raw.withColumn("label", F.lit("human")), english)
    human = smp.prefix_until_target(usable_rows, "row", F.lit(True), chunk_rows, target, group=["source_path"])
    rp.require_rows(human, "human CSV files")
    human = smp.dedup_first(human.drop("chunk"), tx.dedup_key("text"), "seq").drop("dedup_key")
    human = cut_lineage(smp.even_source_sample(human, "seq", "source_path", "seq", n_ai, seed))

    # Balance, drop the file tag, split
    both = ai.select("text", "label", "source_file", "seq").unionByName(
        human.select("text", "label", "source_file", "seq"))
    both = both.withColumn("key", F.concat_ws(":", "label", F.col("seq").cast("string")))
    balanced = cut_lineage(smp.balance_classes(both, "key", "label", seed))
    data = cut_lineage(smp.stratified_split(balanced.drop("source_file"), "key", "label", seed))

    # Human posts wanted (the AI class size) vs found; a shortfall is a
    # warning here (the classes are balanced down), not a failure
    wanted = n_ai.select(F.lit("human").alias("label"), F.col("_n_req").alias("requested"))
    found = human.agg(F.count("*").alias("available")).withColumn("label", F.lit("human"))
    out = {
        "human_shortfall": rp.shortfall(wanted, found, ["label"]),
        "ai": ai.select("text", "label", "source_file"),
        "dataset": data.select("text", "label", "split"),
        "ai_sources": rp.value_counts(ai, "source_file"),
        "human_sources": rp.value_counts(human, "source_file"),
        "class_counts": rp.value_counts(data, "label"),
        "length_summary": rp.length_summary(data, "text", "label"),
        "examples": rk.first_n(data.withColumn("_h", md5_order(seed, "key")), ["label"], ["_h", "key"], 5)
        .select("label", "text"),
        "split_counts": rp.value_counts(data, "split", "label"),
    }
    if out_dir:
        io.write_json_lines(out["ai"].select("text", "label"), f"{out_dir}/ai_combined")
        io.write_splits_csv(out["dataset"], f"{out_dir}/splits")
    return out
