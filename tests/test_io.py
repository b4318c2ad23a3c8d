"""Readers and sinks: write-then-read round trips on edge files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quire.sources import io


def test_csv_reader_edges(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "human.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('id,tweet,extra\n1,normal text,x\n2,long line text,x,y,z\n3,short line text\n'
                '4,"quoted, with comma\nand newline and ""doubled"" quote",x\n5,None,x\n6,NA,x\n7,,x\n'
                '8,"\t padded\u00a0",x\n')
    df = io.read_csv_column(spark, [p, os.path.join(tmpdir_path, "missing.csv")], "tweet", ["id", "tweet", "extra"])
    got = [r.text for r in df.orderBy("seq").collect()]
    assert got == ["normal text", "long line text", "short line text",
                   'quoted, with comma\nand newline and "doubled" quote', "padded"]
    assert {r.source_file for r in df.collect()} == {"human.csv"}


def test_json_reader(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "ai.json")
    with open(p, "w", encoding="utf-8") as f:
        json.dump([{"text": "  one  ", "label": "ai"}, "not an object", 3, {"label": "ai"}, {"text": "two"}], f)
    df = io.read_json_items(spark, p)
    assert [r.text for r in df.orderBy("seq").collect()] == ["one", "", "two"]
    with pytest.raises(FileNotFoundError):
        io.read_json_items(spark, os.path.join(tmpdir_path, "nope.json"))


def test_split_sink_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([("a, b", "ai", "train"), ('q "x"\ny', "human", "test")], "text string, label string, split string")
    out = os.path.join(tmpdir_path, "splits")
    io.write_splits_csv(df, out)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out)
    assert sorted((r.text, r.label, r.split) for r in back.collect()) == sorted(df.collect())


def test_json_sink_and_dead_letters(spark, tmpdir_path):
    df = spark.createDataFrame([("é “x”", "ai")], "text string, label string")
    out = os.path.join(tmpdir_path, "ai_json")
    io.write_json_lines(df, out)
    assert spark.read.json(out).first().text == "é “x”"
    dl = os.path.join(tmpdir_path, "dead")
    failed = spark.createDataFrame([(1, "wrong_arity", "x" * 900)], "batch_id long, reason string, raw string")
    io.write_dead_letters(failed, dl)
    io.write_dead_letters(failed, dl)
    back = spark.read.json(dl)
    assert back.count() == 2 and back.select(F.max(F.length("raw"))).first()[0] == 500


def test_request_parse(spark):
    df = spark.createDataFrame([('{"text": "  hi  "}',), ("not json",), ('{"other": 1}',)], "value string")
    assert [r.text for r in io.requests_from_json(df).collect()] == ["hi", "", ""]


def test_json_lines_reader(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "ai.jsonl")
    with open(p, "w", encoding="utf-8") as f:
        for item in [{"text": "  one  "}, "not an object", {"label": "ai"}, {"text": "two"}]:
            f.write(json.dumps(item) + "\n")
    df = io.read_json_items(spark, p, lines=True)
    assert [r.text for r in df.orderBy("seq").collect()] == ["one", "", "two"]


def test_bad_json_line_raises(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "bad.jsonl")
    with open(p, "w", encoding="utf-8") as f:
        f.write('{"text": "a"}\n\n{"text": \n')
    with pytest.raises(Exception, match="not a JSON line"):
        io.read_json_items(spark, p, lines=True).collect()


def test_bad_json_raises(spark, tmpdir_path):
    for name, body in (("broken.json", '[{"text": "a"}'), ("object.json", '{"text": "a"}')):
        p = os.path.join(tmpdir_path, name)
        with open(p, "w", encoding="utf-8") as f:
            f.write(body)
        with pytest.raises(Exception, match="not a JSON list"):
            io.read_json_items(spark, p).collect()


def test_null_tokens(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "human.csv")
    tokens = ["#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "1.#IND", "1.#QNAN", "NA"]
    with open(p, "w", encoding="utf-8") as f:
        f.write("tweet\n" + "\n".join([*tokens, "kept"]) + "\n")
    assert [r.text for r in io.read_csv_column(spark, p, "tweet").collect()] == ["kept"]


def test_many_files_keep_order_and_equal_names_apart(spark, tmpdir_path):
    paths, want = [], []
    for k in range(129):
        folder = os.path.join(tmpdir_path, f"part {k % 2}")
        os.makedirs(folder, exist_ok=True)
        p = os.path.join(folder, f"f{k // 2}.csv")
        with open(p, "w", encoding="utf-8") as f:
            f.write("tweet\n" + "".join(f"t{k}_{i}\n" for i in range(20)))
        paths.append(p)
        want += [f"t{k}_{i}" for i in range(20)]
    rows = io.read_csv_column(spark, paths[::-1], "tweet").orderBy("seq").collect()
    assert len({r.seq for r in rows}) == 129 * 20 and len({r.source_path for r in rows}) == 129
    assert [r.text for r in rows] == [t for k in range(128, -1, -1) for t in want[20 * k : 20 * k + 20]]


def test_prefix_counts_rows_of_each_file(spark, tmpdir_path):
    from quire.operators import sampling as smp

    paths = []
    for k in range(2):
        paths.append(os.path.join(tmpdir_path, f"big{k}.csv"))
        with open(paths[-1], "w", encoding="utf-8") as f:
            f.write("tweet\n" + "".join(f"t{k}_{i}\n" for i in range(12_000)))
    df = io.read_csv_column(spark, paths, "tweet")
    kept = smp.prefix_until_target(df, "row", F.lit(True), 5000, 100, group=["source_path"])
    assert sorted(r["count"] for r in kept.groupBy("source_path").count().collect()) == [5000, 5000]


def test_keys_that_do_not_fit_raise(spark):
    df = spark.createDataFrame([(1, io.KEY_STRIDE)], "id long, pos long")
    with pytest.raises(Exception, match="does not fit"):
        df.select(io.stride_key("id", "pos")).collect()


def test_shuffled_files_keep_their_order(spark, tmpdir_path):
    rows = [(i, f"line {i}\nwith \"quotes\" \u00e9", None if i % 7 == 0 else "x") for i in range(500)]
    df = spark.createDataFrame(rows, "key long, text string, label string").repartition(4)
    out = f"{tmpdir_path}/shuffled"
    io.write_shuffled(df, "key", out)
    got = sorted(map(tuple, io.read_in_order(spark, out, "key long, text string, label string").collect()))
    want = df.orderBy(io.md5_order(io.K.SEED, "key"), "key").collect()
    assert [g[0] for g in got] == list(range(500)) and [g[1:] for g in got] == [tuple(w) for w in want]
    assert [g[1] for g in got] != sorted(g[1] for g in got)
    assert io.read_in_order(spark, out, "key long").filter("position < 0").count() == 0
