"""End-to-end dataset build over CSV and JSON fixture files."""

import json
import os

from pyspark.sql import functions as F

from quire.plans.dataset_job import prepare_dataset


def test_prepare_dataset(spark, tmpdir_path):
    ai_files = []
    for f in range(2):
        p = os.path.join(tmpdir_path, f"ai_{f}.json")
        items = [{"text": f"generated post number {i} about policy https://x.y", "label": "ai"} for i in range(30)]
        items += [{"text": "generated post number 1 about policy"}, "junk", {"label": "ai"}]
        with open(p, "w", encoding="utf-8") as fh:
            json.dump(items, fh)
        ai_files.append(p)
    human_files = []
    for f in range(2):
        p = os.path.join(tmpdir_path, f"human_{f}.csv")
        with open(p, "w", encoding="utf-8") as fh:
            fh.write("tweet,user\n")
            for i in range(40 if f == 0 else 12):
                fh.write(f'"human {f} says thing {i} @someone",u{i}\n')
            fh.write("NA,u\n")
        human_files.append(p)
    out_dir = os.path.join(tmpdir_path, "out")
    res = prepare_dataset(spark, ai_files, human_files + [os.path.join(tmpdir_path, "missing.csv")], out_dir,
                          csv_columns=["tweet", "user"], chunk_rows=10)
    counts = {r.label: r.n for r in res["class_counts"].collect()}
    assert counts["ai"] == counts["human"] == 30  # 30 distinct AI posts after cross-file dedup
    splits = {(r.split, r.label): r.n for r in res["split_counts"].collect()}
    assert splits[("train", "ai")] == splits[("train", "human")] == 24
    assert sum(splits.values()) == 60
    back = spark.read.option("header", True).csv(os.path.join(out_dir, "splits"))
    assert back.count() == 60 and back.filter(F.col("text").contains("http")).count() == 0
    assert spark.read.json(os.path.join(out_dir, "ai_combined")).count() == 30
    assert [(r.requested, r.available, r.short) for r in res["human_shortfall"].collect()] == [(30, 30, 0)]
    assert sorted(r.label for r in res["examples"].collect()) == ["ai"] * 5 + ["human"] * 5
    hs = {r.source_file: r.n for r in res["human_sources"].collect()}
    assert hs["human_1.csv"] == 12 and hs["human_0.csv"] == 18  # short file filled from the other


def test_language_filter(spark):
    from quire.functions import text as tx
    from quire.operators import langid as li
    from quire.sources import io

    d = io.table(spark, "/root/testdata/sf0.001", "documents").select(
        F.col("doc_id").alias("seq"), "lang", tx.clean("text").alias("text"))
    dg = li.doc_trigram_counts(d.select("seq", "lang", F.lower("text").alias("t")), "seq", "t", "lang")
    model, langs = li.train_from_counts(dg, "lang")
    kept = li.language_filter(model, langs)(d).cache()
    n_en = d.filter(F.col("lang") == "en").count()
    assert kept.filter(F.col("lang") != "en").count() <= 0.05 * kept.count()
    assert kept.filter(F.col("lang") == "en").count() >= 0.9 * n_en
