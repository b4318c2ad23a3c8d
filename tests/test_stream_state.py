"""Fingerprint state, restarts, and counters kept by upsert."""

import os
import random

from pyspark.sql import functions as F

from quire.streaming import stream as st


def _batches(spark, path, parts):
    """One file per batch, in order of arrival."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "text string, at timestamp").coalesce(1).write.mode("append").parquet(path)
    return path


def _run(spark, source, out, state, **kw):
    rows = st.first_seen(st.file_stream(spark, source), **kw)
    q = rows.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start()
    q.awaitTermination()
    return q


def _at(hour, day=1):
    import datetime as dt
    return dt.datetime(2024, 1, day, hour)


def test_fingerprints_survive_a_restart(spark, tmpdir_path):
    src, out, state = (f"{tmpdir_path}/{n}" for n in ("src", "out", "state"))
    long = random.Random(1).randbytes(1_000_000).hex()
    with st.state_on_disk(spark):
        _batches(spark, src, [[("a", _at(1)), (long, _at(1)), (None, _at(1)), ("a", _at(1))]])
        _run(spark, src, out, state)
        _batches(spark, src, [[("a", _at(2)), (long, _at(2)), (None, _at(2)), ("b", _at(2)), ("", _at(2))]])
        q = _run(spark, src, out, state)
    got = sorted((r.text is not None, r.text or "") for r in spark.read.parquet(out).select("text").collect())
    assert got == [(False, ""), (True, ""), (True, "a"), (True, "b"), (True, long)]
    assert sum(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators if p.numInputRows) == 5
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{state}/state") for f in fs)
    assert size < len(long)  # the long text itself is not in the state


def test_fingerprints_leave_after_their_time(spark, tmpdir_path):
    src, out, state = (f"{tmpdir_path}/{n}" for n in ("src", "out", "state"))
    for rows in ([("a", _at(1))], [("a", _at(2))], [("z", _at(1, 20))], [("y", _at(1, 21))], [("a", _at(2, 21))]):
        _batches(spark, src, [rows])
        _run(spark, src, out, state, event_time="at", keep="1 day")
    got = sorted((r.text, r["at"].day) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1), ("a", 21), ("y", 21), ("z", 20)]


def test_upserts_and_replay(spark, tmpdir_path):
    out = f"{tmpdir_path}/v"
    df = lambda rows: spark.createDataFrame(rows, "reason string, n long")
    assert st.versions(spark, out) == [] and st.read_version(spark, out) is None
    st.upsert(df([("a", 1), (None, 5)]), out, 0, ["reason"])
    st.upsert(df([("a", 3), ("b", 1)]), out, 1, ["reason"])
    want = {("a", 3), ("b", 1), (None, 5)}
    assert {tuple(r) for r in st.read_version(spark, out).collect()} == want
    reader = st.read_version(spark, out)
    st.upsert(df([("a", 3), ("b", 1)]), out, 1, ["reason"])  # the batch again
    assert {tuple(r) for r in st.read_version(spark, out).collect()} == want
    st.upsert(df([(None, 6)]), out, 2, ["reason"])
    assert {tuple(r) for r in st.read_version(spark, out).collect()} == {("a", 3), ("b", 1), (None, 6)}
    assert st.versions(spark, out) == [1, 2] and reader is not None
    # an unfinished version is not seen
    df([("q", 9)]).write.parquet(f"{out}/version=3")
    os.remove(f"{out}/version=3/_SUCCESS")
    assert st.versions(spark, out) == [1, 2]


def test_running_counts_by_upsert(spark, tmpdir_path):
    src = f"{tmpdir_path}/src"
    _batches(spark, src, [[("a", _at(1)), ("b", _at(1))], [("a", _at(1))], [("c", _at(1)), ("a", _at(1))]])
    counts = st.file_stream(spark, src).groupBy("text").agg(F.count("*").alias("n"))
    out = st.run_upserts(counts, "t", ["text"])
    assert {tuple(r) for r in st.read_version(spark, out).collect()} == {("a", 3), ("b", 1), ("c", 1)}


def test_batches_by_bytes_and_few_counter_partitions(spark, tmpdir_path):
    src = _batches(spark, f"{tmpdir_path}/src", [[("a", _at(1)), ("b", _at(1))], [("a", _at(2))], [("c", _at(3))]])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    counts = st.file_stream(spark, src, max_bytes=st.BATCH_BYTES).groupBy("text").agg(F.count("*").alias("n"))
    out = st.run_upserts(counts, "t", ["text"])
    assert st.versions(spark, out) == [0]  # three files, one batch
    state = os.path.join(os.path.dirname(out.removeprefix("file:")), "state", "state", "0")
    assert len([d for d in os.listdir(state) if d.isdigit()]) == st.COUNTER_PARTITIONS
    assert sorted(map(tuple, st.read_version(spark, out).collect())) == [("a", 2), ("b", 1), ("c", 1)]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
