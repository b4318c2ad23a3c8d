"""Readers and sinks (S1-S11) and the stand-in tables built from the
parquet test data (``posts``, ``class_items``).

Every read has an explicit schema; nothing is inferred. Order-dependent
operators need an explicit ``seq`` column, so every reader exposes one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import constants as K
from quire.functions import text as tx
from quire.functions.hashing import md5_order

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------
# Stand-in tables
# ---------------------------------------------------------------------------
# A key holds an id above 28 bits of position. Ids and positions that do not
# fit raise, so two rows never share a key.
KEY_STRIDE = 1 << 28


def stride_key(id_col: str, pos_col: str) -> F.Column:
    """``id * 2^28 + position`` in one long, or an error."""
    fits = F.col(pos_col).between(0, KEY_STRIDE - 1) & F.col(id_col).between(-(1 << 34), (1 << 34) - 1)
    made = F.col(id_col).cast("bigint") * KEY_STRIDE + F.col(pos_col)
    return F.when(fits | F.col(id_col).isNull() | F.col(pos_col).isNull(), made).otherwise(
        F.raise_error(F.lit("an id or a position does not fit into a key")).cast("bigint"))


def posts_of(documents: DataFrame) -> DataFrame:
    """Posts: every newline piece of ``text``, whatever its length (length
    rules are operators, not part of the input); the key orders them like a
    file."""
    lines = documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select(stride_key("doc_id", "line").alias("key"), "text", "lang", "source")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_of(table(spark, sf_dir, "documents"))


ROLE_TO_LABEL = {"user": "human", "assistant": "ai"}


def class_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled items: conversation turns, user -> human, assistant -> ai,
    other roles unmapped and dropped (S9); text cleaned (T4) and blank rows
    dropped (F1)."""
    c = table(spark, sf_dir, "conversations")
    label = F.create_map(*[F.lit(x) for kv in ROLE_TO_LABEL.items() for x in kv])[F.col("role")]
    c = c.select(stride_key("conv_id", "turn").alias("key"), F.col("text").alias("_raw"),
                 label.alias("label")).filter(F.col("label").isNotNull())
    return tx.keep_nonempty(c, "text", tx.clean("_raw")).select("key", "text", "label")


# ---------------------------------------------------------------------------
# Readers
# ---------------------------------------------------------------------------
FILE_STRIDE = 1 << 40  # rows of one file stay below this


def _files(spark: SparkSession, paths: list[str] | str, required: bool) -> list[tuple[str, str]]:
    """(path, URI) of the files that the given paths name, in the order given. A path that names none is an error if
    ``required``, else left out (S4)."""
    sc = spark.sparkContext
    rows = []
    for p in [paths] if isinstance(paths, str) else paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        found = [s for top in fs.globStatus(path) or [] for s in (fs.listStatus(top.getPath()) if top.isDirectory() else [top])]
        names = sorted((s.getPath().toString(), s.getPath().toUri().toString()) for s in found
                       if s.isFile() and s.getPath().getName()[0] not in "_.")
        if required and not found:
            raise FileNotFoundError(f"input file not found: {p}")
        rows += [n for n in names if n not in rows]
    return rows


def _ranked(spark: SparkSession, df: DataFrame, files: list[tuple[str, str]]) -> DataFrame:
    """Add ``_rank``, the place of each row's file in the order given."""
    slashes = lambda c: F.regexp_replace(c, "^([A-Za-z0-9+.-]+):/+", "$1:/")  # noqa: E731  file:/a and file:///a are one
    ranks = spark.createDataFrame([(i, uri) for i, (_, uri) in enumerate(files)], "_rank bigint, _file string")
    ranks = ranks.select("_rank", slashes("_file").alias("_file"))
    return df.join(F.broadcast(ranks), slashes("source_path") == F.col("_file")).drop("_file")  # one row for each file named


def _numbered(df: DataFrame, by: list[str]) -> DataFrame:
    """Add ``row``, the number of each row inside its file. Ids rise by one
    inside a split, so a split needs only its first id and its count (a table
    of splits), offset by prefix sums over the file's splits."""
    df = df.withColumn("_id", F.monotonically_increasing_id())
    splits = df.groupBy(*by).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(by[0]).orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return df.join(splits, by).withColumn("row", F.col("_off") + F.col("_id") - F.col("_first")).drop("_off", "_first", "_id")


def _seq() -> F.Column:
    return F.col("_rank") * F.lit(FILE_STRIDE) + F.col("row")


def read_csv_column(spark: SparkSession, paths: list[str] | str, column: str,
                    all_columns: list[str] | None = None) -> DataFrame:
    """S1 (+S3, S4): header CSV, one text column kept, malformed lines kept
    in PERMISSIVE mode, pandas-style null tokens dropped. Missing files are
    skipped (S4). Carries ``source_file`` (its name) and ``source_path``,
    ``row`` (number in the file, counted before any filter) and ``seq`` (file
    order, then row). A multi-line CSV file is one split."""
    files = _files(spark, paths, required=False)
    cols = all_columns or [column]
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in cols])
    if not files:
        return spark.createDataFrame([], "text string, source_file string, source_path string, row bigint, seq bigint")
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("encoding", "UTF-8")
        .csv([path for path, _ in files])
    )
    rows = _numbered(df.select(F.col(column).alias("text"), F.col("_metadata.file_name").alias("source_file"),
                               F.col("_metadata.file_path").alias("source_path"),
                               F.col("_metadata.file_block_start").alias("_block")), ["source_path", "_block"])
    rows = _ranked(spark, rows, files).withColumn("seq", _seq())
    kept = rows.filter(tx.not_null_token("text")).withColumn("text", tx.strip_ws("text"))
    return kept.filter(F.length(tx.collapse_ws("text")) > 0).select("text", "source_file", "source_path", "row", "seq")


def read_json_items(spark: SparkSession, paths: list[str] | str, label: str = "ai",
                    lines: bool = False) -> DataFrame:
    """S2 (+S3, F3): JSON array-of-objects files; a missing file, malformed
    JSON or JSON that is no list is an error, non-object items are skipped,
    ``text`` defaults to '' and is stripped. Carries ``source_file``,
    ``source_path``, ``row``, ``seq`` (file order, position) and ``label``.

    A JSON array is one value per file, read by one task; for large inputs
    write JSON lines (one object per line) and pass ``lines=True``, which
    splits files across tasks; blank lines are skipped, and a line that is no
    JSON is an error like a malformed file."""
    files = _files(spark, paths, required=True)
    if lines:
        raw = spark.read.text([path for path, _ in files]).select(
            "value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("source_path"),
            F.col("_metadata.file_block_start").alias("_block"))
        items = _numbered(raw, ["source_path", "_block"]).filter(tx.strip_ws("value") != "").withColumn("item", F.coalesce(
            F.try_parse_json("value"), F.raise_error(F.concat(F.lit("not a JSON line: "), "source_path")).cast("variant")))
    else:
        raw = spark.read.option("wholetext", True).text([path for path, _ in files]).select(
            F.col("value"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("source_path"))
        arr = F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"),
                         F.raise_error(F.concat(F.lit("not a JSON list: "), "source_path")).cast("array<variant>"))
        items = raw.select("source_file", "source_path", F.posexplode(arr).alias("row", "item")).withColumn(
            "row", F.col("row").cast("bigint"))
    is_obj = F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False))
    txt = F.coalesce(F.try_variant_get("item", "$.text", "string"), F.lit(""))
    return _ranked(spark, items.filter(is_obj), files).select(
        tx.strip_ws(txt).alias("text"), F.lit(label).alias("label"), "source_file", "source_path", "row", _seq().alias("seq"))


# ---------------------------------------------------------------------------
# Sinks
# ---------------------------------------------------------------------------
def write_splits_csv(df: DataFrame, out: str) -> None:
    """One CSV folder per split, header, no index."""
    (df.select("text", "label", "split").write.mode("overwrite").partitionBy("split")
     .option("header", True).option("escape", '"').csv(out))


def write_shuffled(df: DataFrame, key: str, out: str, seed: int = K.SEED) -> None:
    """O5 + S6/S7: JSON lines in a global random order (md5 of seed and key):
    ranges of the order go to files, each file is sorted, and files are named in
    range order. No task sees more than its range."""
    rows = df.withColumn("_h", md5_order(seed, key))
    rows.repartitionByRange("_h", key).sortWithinPartitions("_h", key).drop("_h").write.mode("overwrite").json(out)


def read_in_order(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as ``write_shuffled`` left them, with ``position``: the number
    of each row over all files, by file and line. Files and splits meet as one
    row each, so nothing is sorted again."""
    raw = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint").alias("_file"),
                                       F.col("_metadata.file_block_start").alias("_block"))
    rows = _numbered(raw, ["_file", "_block"])
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(files, "_file").select((F.col("_before") + F.col("row")).alias("position"), F.from_json("value", schema).alias("r"))
    return placed.select("position", "r.*")


def write_json_lines(df: DataFrame, out: str) -> None:
    """UTF-8 JSON lines (non-ASCII kept)."""
    df.write.mode("overwrite").json(out)


def write_dead_letters(failed: DataFrame, out: str) -> None:
    """Append unparsable responses with a reason, the first 500 characters
    of the raw text, and what else is known of the batch (profiles, phase)."""
    (failed.withColumn("raw", F.substring("raw", 1, 500))
     .write.mode("append").json(out))


def requests_from_json(df: DataFrame, col: str = "value") -> DataFrame:
    """Lenient parse of a JSON request body; text defaults to ''."""
    parsed = F.from_json(F.col(col), "text STRING")
    return df.withColumn("text", tx.strip_ws(F.coalesce(parsed["text"], F.lit(""))))


def response_json(sentiment: str = "sentiment", detection: str = "ai_detection", error: str = "error"):
    """Nested JSON response, or ``{"error": ...}``."""
    return F.when(F.col(error).isNotNull(), F.to_json(F.struct(F.col(error).alias("error")))).otherwise(
        F.to_json(F.struct(F.col(sentiment).alias("sentiment"), F.col(detection).alias("ai_detection"))))
