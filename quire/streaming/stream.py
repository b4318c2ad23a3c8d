"""Structured Streaming jobs (R1-R3), reusing the batch Column functions.

Each job reads a file stream, runs the same transformations as the batch
query and writes to a folder under the shared checkpoint directory (file
sink or ``foreachBatch``), so results never pass through the driver. Tests
and the catalogue run them with ``trigger(availableNow=True)``.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import score as sc
from quire.functions import text as tx
from quire.operators import model as ml
from quire.session import checkpoint_dir
from quire.sources import io


def _scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    base = checkpoint_dir(spark).rstrip("/") + f"/streams/{name}-{uuid.uuid4().hex[:12]}"
    return base + "/out", base + "/state"


BATCH_BYTES = 1 << 30  # most bytes of files in a micro-batch (a larger file is a batch of its own)


def file_stream(spark: SparkSession, path: str, max_files: int = 1, max_bytes: int | None = None) -> DataFrame:
    """Parquet files arriving under ``path`` (a folder or a glob); the schema
    is taken from the files present (explicit, no inference at run time). With
    ``max_bytes`` micro-batches are cut by bytes, whatever the number of files."""
    schema = spark.read.parquet(path).schema
    limit = ("maxBytesPerTrigger", max_bytes) if max_bytes else ("maxFilesPerTrigger", max_files)
    return spark.readStream.schema(schema).option(*limit).parquet(path)


def score_requests(requests: DataFrame, logits: DataFrame, id_col: str) -> DataFrame:
    """Blank text -> error row; else sentiment and AI detection from the
    logits of the matching id (stream-static join)."""
    req = io.requests_from_json(requests)
    j = req.join(logits, id_col, "left")  # a request without logits still gets its row
    err = F.when(F.col("text") == "", F.lit("No text provided"))
    l3 = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    l2 = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))
    out = j.select("*", err.alias("error"), sc.sentiment_struct("text", l3).alias("sentiment"),
                   sc.detection_struct("text", l2).alias("ai_detection"))
    return out.withColumn("response", io.response_json())


def run_to_folder(df: DataFrame, name: str) -> str:
    """Run a streaming DataFrame to completion over the files present, in append
    mode, and return the output folder."""
    out, state = _scratch(df.sparkSession, name)
    df.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode("append").format("parquet").option("path", out).start().awaitTermination()
    return out


# ---------------------------------------------------------------------------
# Counters kept by upsert
# ---------------------------------------------------------------------------
KEPT_VERSIONS = 2  # a reader of the version before may still be at it


def versions(spark: SparkSession, out: str) -> list[int]:
    """Complete versions under ``out``, oldest first: the mark that Spark writes
    when a folder is whole is the pointer readers follow."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/version=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def read_version(spark: SparkSession, out: str, version: int | None = None) -> DataFrame | None:
    """The newest complete version (or the one named); None before the first."""
    if version is None:
        version = max(versions(spark, out), default=None)
    return None if version is None else spark.read.parquet(f"{out}/version={version}")


def upsert(changed: DataFrame, out: str, batch_id: int, keys: list[str]) -> None:
    """Version ``batch_id``: the rows of the newest earlier version whose keys are
    not in ``changed``, and ``changed``. A batch run again starts from the same
    earlier version, so a replay changes nothing; versions that no reader needs
    any more are deleted."""
    spark = changed.sparkSession
    before = [v for v in versions(spark, out) if v < batch_id]
    rows = changed
    if before:
        old = read_version(spark, out, before[-1])
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
        rows = old.alias("o").join(changed.alias("c"), same, "left_anti").unionByName(changed)
    rows.write.mode("overwrite").parquet(f"{out}/version={batch_id}")
    for v in before[:len(before) + 1 - KEPT_VERSIONS]:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/version={v}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


COUNTER_PARTITIONS = 4  # counters are few rows, whatever the stream's volume


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """Streams started inside have ``name`` set to ``value``."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_upserts(counts: DataFrame, name: str, keys: list[str]) -> str:
    """Run a streaming aggregate in update mode: each micro-batch sends only the
    counters it changed. Every task reports to the driver, so the counters, summed
    before they are shuffled, are kept in few partitions. Returns the folder of versions."""
    out, state = _scratch(counts.sparkSession, name)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        upsert(batch, out, batch_id, keys)
        batch.unpersist()

    with setting(counts.sparkSession, "spark.sql.shuffle.partitions", str(COUNTER_PARTITIONS)):
        counts.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode("update").foreachBatch(each).start().awaitTermination()
    return out


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = file_stream(spark, f"{sf_dir}/conversations*.parquet", max_bytes=BATCH_BYTES)
    req = conv.select("conv_id", "turn", F.to_json(F.struct("text")).alias("value"))
    logits = io.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    scored = score_requests(req, logits, "conv_id").select("conv_id", "turn", "response")
    out = run_to_folder(scored, "score")
    r = spark.read.parquet(out)
    return r.select(
        "conv_id", "turn",
        F.get_json_object("response", "$.error").alias("error"),
        F.get_json_object("response", "$.sentiment.scale_score").cast("double").alias("scale_score"),
        F.get_json_object("response", "$.sentiment.scale_label").alias("scale_label"),
        F.get_json_object("response", "$.ai_detection.ai_likelihood").cast("double").alias("ai_likelihood"))


# ---------------------------------------------------------------------------
# Routed scoring
# ---------------------------------------------------------------------------
ROUTES = ("scored", "error", "dead_letter")


def routed(requests: DataFrame, model: DataFrame, id_col: str) -> dict[str, DataFrame]:
    """R1 + S8 + S11: requests (id, value) of one batch by where they go: scored
    texts, blank texts with the error they are answered with, and bodies that
    are no JSON with a reason and their first 500 characters."""
    good = F.try_parse_json("value").isNotNull()
    bodies = io.requests_from_json(requests.filter(good)).select(id_col, "text")
    bodies = bodies.withColumn("text", tx.strip_ws(F.coalesce("text", F.lit(""))))
    answers = ml.detect_text(bodies.filter(F.col("text") != ""), model, id_col)
    blank = bodies.filter(F.col("text") == "").select(id_col, F.lit(ml.BLANK).alias("error"))
    dead = requests.filter(~good | F.col("value").isNull()).select(
        id_col, F.when(F.col("value").isNull(), F.lit("no_body")).otherwise(F.lit("invalid_json")).alias("reason"), F.substring("value", 1, 500).alias("raw"))
    return {"scored": answers.select(id_col, "score", "ai_likelihood", "ai_label"), "error": blank, "dead_letter": dead}


def write_routes(routes: dict[str, DataFrame], out: str, batch_id: int) -> None:
    """One folder per route and batch. A batch that is run again overwrites its
    own folders, so a replay adds nothing."""
    for name, rows in routes.items():
        rows.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")


def run_routed(requests: DataFrame, model_path: str, id_col: str, out: str, state: str) -> None:
    """Score a stream of requests (id, value) with a saved model; each
    micro-batch goes to its routes in one ``foreachBatch``. A request id occurs
    once."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        write_routes(routed(batch, ml.load_log_odds(batch.sparkSession, model_path), id_col), out, batch_id)
        batch.unpersist()

    requests.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def read_routes(spark: SparkSession, out: str, id_col: str) -> DataFrame:
    """(id, route, reason, score, ai_likelihood, ai_label) of all batches."""
    none = lambda t: F.lit(None).cast(t)
    parts = {name: spark.read.parquet(f"{out}/{name}") for name in ROUTES}
    scored = parts["scored"].select(id_col, F.lit("scored").alias("route"), none("string").alias("reason"), "score", "ai_likelihood", "ai_label")
    for name, reason in (("error", "error"), ("dead_letter", "reason")):
        scored = scored.unionByName(parts[name].select(id_col, F.lit(name).alias("route"), F.col(reason).alias("reason"), none("bigint").alias("score"),
                                                       none("double").alias("ai_likelihood"), none("string").alias("ai_label")))
    return scored


def document_requests(documents: DataFrame) -> DataFrame:
    """Stand-in requests: one JSON body for each document; of ten ids one body is cut short and one text is blank."""
    body = F.to_json(F.struct(F.when(F.col("doc_id") % 10 == 7, F.lit(" \n")).otherwise(F.coalesce("text", F.lit(""))).alias("text")))
    cut = F.expr("substring(value, 1, length(value) div 2)")
    return documents.select("doc_id", body.alias("value")).withColumn("value", F.when(F.col("doc_id") % 10 == 3, cut).otherwise(F.col("value")))


def _stream_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.posts_of(file_stream(spark, f"{sf_dir}/documents*.parquet", max_bytes=BATCH_BYTES)).drop("lang")


DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_seen(posts: DataFrame, text: str = "text", event_time: str | None = None, keep: str = "1 day") -> DataFrame:
    """R2: each text once. The state holds 128-bit fingerprints (MD5), 16 bytes
    a distinct text whatever its length; two texts with one fingerprint are
    taken as equal (for 10^12 texts a chance of about 10^-15). With an event
    time, fingerprints older than ``keep`` leave the state, and a text that comes
    back after that is new; without one the state grows with the distinct texts."""
    rows = posts.withColumn("fingerprint", F.unhex(F.md5(F.col(text).cast("binary"))))
    if event_time:
        return rows.withWatermark(event_time, keep).dropDuplicatesWithinWatermark(["fingerprint"]).drop("fingerprint")
    return rows.dropDuplicates(["fingerprint"]).drop("fingerprint")


def state_on_disk(spark: SparkSession):
    """Streams started inside keep their state in a store on disk, not on the heap."""
    return setting(spark, "spark.sql.streaming.stateStore.providerClass", DISK_STATE)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: running exact dedup of incoming posts, by fingerprints kept on disk."""
    posts = first_seen(_stream_posts(spark, sf_dir).select("text"))
    with state_on_disk(spark):
        return spark.read.parquet(run_to_folder(posts, "dedup"))


def stream_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counters of the row-local v2 rejection flags, kept by upsert."""
    posts = _stream_posts(spark, sf_dir).withColumn("flags", tx.quality_flags("text"))
    reasons = posts.select(F.explode(F.split(F.when(F.col("flags") == "", F.lit("accepted"))
                                             .otherwise(F.col("flags")), ",")).alias("reason"))
    counts = reasons.groupBy("reason").agg(F.count("*").alias("n"))
    return read_version(spark, run_upserts(counts, "rejects", ["reason"]))
