"""Acceptance batch by batch (G1, J3): a stored index of the accepted rows that
each later batch probes and extends.

A batch holds candidates that come after all earlier ones. Accepted rows are
final, so what earlier batches say about a candidate is known at once: it is
near to an accepted row, or its opening, length, topic, question or total quota
is used up by so much. The batch's own rows are then settled by the fixpoint of
``operators.greedy``, under the room that is left. Three batches in order give
what one run over all of them gives.

The index is a folder with one sub-folder per batch; a batch counts once its
``counts`` are written, which is its last step, so a batch that is run again
after a failure starts anew and one that is done is not added twice.

* ``accepted``: key, normalized text and word set of the accepted rows, whose
  texts new ones meet in blocks of lengths (``operators.segments``);
* ``words``: the words of their sets' prefixes under a fixed order (long words
  first, which are rarer, then by hash), so an old prefix stays right;
* ``counts``: accepted rows per rule and group.

Only pairs of a new and an accepted row are looked for, so a batch costs its own
size and one read of the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import greedy as gr
from quire.operators import segments
from quire.operators import similarity as sim
from quire.session import cut_lineage

_ACCEPTED = "key bigint, nk string, wk string"
_WORDS = "key bigint, s int, w string, r int, c bigint"
_COUNTS = "rule string, g string, n bigint"


def batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches that are complete, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath().getParent().getParent().getName() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/counts/_SUCCESS")) or []]
    return sorted(done)


def _read(spark: SparkSession, path: str, done: list[str], part: str, schema: str) -> DataFrame:
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{b}/{part}" for b in done])


def used(spark: SparkSession, path: str) -> DataFrame:
    """(rule, g, n): accepted rows per rule and group so far."""
    return _read(spark, path, batches(spark, path), "counts", _COUNTS).groupBy("rule", "g").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------------------
# Pairs of new and accepted rows
# ---------------------------------------------------------------------------
def _prefixes(sets: DataFrame) -> DataFrame:
    """(key, s, w, r, c): the prefix of each word set (key, wk) under the fixed order."""
    s = sets.filter(F.col("wk") != "").withColumn("ws", F.split("wk", " ")).withColumn("s", F.size("ws"))
    order = F.array_sort(F.transform("ws", lambda w: F.struct((-F.length(w)).alias("l"), F.xxhash64(w).alias("h"), w.alias("w"))))
    plen = F.col("s") - F.expr(f"({sim.JACCARD_NUM} * s + {sim.JACCARD_DEN - 1}) div {sim.JACCARD_DEN}") + 1
    s = s.select("key", "s", sim._size_class(F.col("s")).alias("c"), F.posexplode(F.slice(order, F.lit(1), plen.cast("int"))).alias("r", "e"))
    return s.select("key", "s", F.col("e.w").alias("w"), (F.col("r") + 1).cast("int").alias("r"), F.col("c").cast("bigint").alias("c"))


def _word_pairs(new: DataFrame, old: DataFrame) -> DataFrame:
    """Distinct (x, y): new and accepted keys whose word sets may reach the ratio."""
    a = new.select("key", "s", "w", "r", F.explode(F.array(F.col("c") - 1, "c", F.col("c") + 1)).alias("c")).alias("a")
    b = old.alias("b")
    small, large = F.least("a.s", "b.s"), F.greatest("a.s", "b.s")
    behind = F.least(F.col("a.s") - F.col("a.r"), F.col("b.s") - F.col("b.r")) + F.least("a.r", "b.r")
    met = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.c") == F.col("b.c"))).filter(
        (sim.JACCARD_DEN * small >= sim.JACCARD_NUM * large) & ((sim.JACCARD_NUM + sim.JACCARD_DEN) * behind >= sim.JACCARD_NUM * (small + large)))
    return met.select(F.col("a.key").alias("x"), F.col("b.key").alias("y")).distinct()


def near_accepted(new: DataFrame, accepted: DataFrame, old_words: DataFrame) -> DataFrame:
    """Keys of the rows (key, nk, wk) of ``new`` that are near duplicates of an
    accepted row."""
    same_text = new.join(accepted.select("nk"), "nk", "left_semi").select("key")
    same_words = new.filter(F.col("wk") != "").join(accepted.filter(F.col("wk") != "").select("wk"), "wk", "left_semi").select("key")
    x, y = (t.select(F.col("key").alias(n), F.col("nk").alias(f"n{n}"), F.col("wk").alias(f"w{n}")) for t, n in ((new, "x"), (accepted, "y")))
    words = _word_pairs(_prefixes(new), old_words).join(x, "x").join(y, "y").select("x", F.split("wx", " ").alias("a"), F.split("wy", " ").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    words = words.filter(sim.JACCARD_DEN * shared >= sim.JACCARD_NUM * (F.size("a") + F.size("b") - shared)).select(F.col("x").alias("key"))
    # odd numbers for new texts and even ones for accepted texts, which meet in the blocks of their lengths
    both = new.select("nk", F.lit(1).alias("side")).unionByName(accepted.select("nk", F.lit(0).alias("side"))).filter(F.col("nk") != "")
    held = segments.held_texts(both.select((2 * F.monotonically_increasing_id() + F.col("side")).alias("no"), "nk"))
    texts = new.join(sim.near_texts(held, two_sides=True).select(F.col("nx").alias("nk")), "nk", "left_semi").select("key")
    return same_text.union(same_words).union(words).union(texts).distinct()


# ---------------------------------------------------------------------------
# One batch
# ---------------------------------------------------------------------------
def accept_batch(cands: DataFrame, path: str, batch: str, key: str = "key", bucket: str = "bucket") -> DataFrame:
    """Decide the candidates of one batch (columns as in ``greedy.accept``, nk
    and wk as texts, keys above all earlier ones) and add its accepted rows to
    the index at ``path``. Batch names sort in the order of the batches.
    Returns (key, decision, accepted_before) as ``greedy.explain_rejections``."""
    spark = cands.sparkSession
    earlier = [b for b in batches(spark, path) if b < batch]
    cands = cut_lineage(cands)
    valid = cands.filter(F.col("verdict") == "ok")
    # one row for each normalized text: what is near to it is near to its copies
    firsts = cut_lineage(valid.groupBy("nk").agg(F.min(key).alias("key"), F.min("wk").alias("wk")).select("key", "nk", "wk"))
    if earlier:
        old = _read(spark, path, earlier, "accepted", _ACCEPTED)
        near = cut_lineage(near_accepted(firsts, old, _read(spark, path, earlier, "words", _WORDS)))
        blocked = firsts.join(near, "key", "left_semi").select("nk", F.lit(True).alias("_near"))
        near_too = valid.join(blocked, "nk", "left").withColumn(
            "verdict", F.when(F.col("_near"), F.lit("near_duplicate")).otherwise(F.col("verdict"))).drop("_near")
        cands = near_too.unionByName(cands.filter(~F.col("verdict").eqNullSafe("ok")))
        so_far = _read(spark, path, earlier, "counts", _COUNTS).groupBy("rule", "g").agg(F.sum("n").alias("n"))
    else:
        so_far = spark.createDataFrame([], _COUNTS)
    so_far = cut_lineage(so_far)
    room = cands.withColumn("_qgroup", F.lit(0)).withColumn("_all", F.lit(0))
    for _name, group, cap, _on in gr.ALL_RULES:  # a table of the groups in use, as small as the quotas
        n = so_far.filter(F.col("rule") == group).select(F.col("g").alias("_g"), F.col("n").alias("_n"))
        room = room.join(n, F.col(group).cast("string") == F.col("_g"), "left").withColumn(cap, F.col(cap) - F.coalesce("_n", F.lit(0))).drop("_g", "_n")
    room = cut_lineage(room.drop("_qgroup", "_all"))
    own = room.filter(F.col("verdict") == "ok")
    jacc, near_chars = cut_lineage(sim.jaccard_edges(own)), cut_lineage(sim.char_edges(own))
    final = gr.accept(room, key, bucket, jacc, near_chars)
    before = so_far.filter(F.col("rule") == "_all").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_before"))
    decisions = gr.explain_rejections(final, key, bucket, jacc, near_chars).crossJoin(F.broadcast(before))
    decisions = cut_lineage(decisions.select(key, "decision", (F.col("accepted_before") + F.col("_before")).alias("accepted_before")))
    _extend(cands, decisions, path, batch, key)
    return decisions


def _extend(cands: DataFrame, decisions: DataFrame, path: str, batch: str, key: str) -> None:
    """Write the accepted rows of a batch; its counts come last and make it count."""
    taken = decisions.filter(F.col("decision") == "accepted").select(F.col(key).alias("key"))
    rows = cands.withColumnRenamed(key, "key").join(taken, "key", "left_semi")
    rows.select("key", "nk", "wk").write.mode("overwrite").parquet(f"{path}/{batch}/accepted")
    _prefixes(rows.select("key", "wk")).write.mode("overwrite").parquet(f"{path}/{batch}/words")
    entries = [F.struct(F.lit(g).alias("rule"), (F.lit("0") if g in ("_qgroup", "_all") else F.col(g).cast("string")).alias("g"), (F.lit(True) if on is None else F.col(on)).alias("on"))
               for _n, g, _c, on in gr.ALL_RULES]
    per_group = rows.select(F.explode(F.array(*entries)).alias("e")).filter("e.on").groupBy(F.col("e.rule").alias("rule"), F.col("e.g").alias("g")).agg(F.count("*").alias("n"))
    per_group.write.mode("overwrite").parquet(f"{path}/{batch}/counts")
