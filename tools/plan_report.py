"""Write the physical operator trees of selected catalogue queries (after
execution, so AQE's final choices show) to PLANS.md."""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NOTES = {
    "accept_posts": "First-wins dedup: a partial WindowGroupLimit runs before the shuffle, so a repeated text ships "
                    "one row per map task; the truncation is a distributed top-k (TakeOrderedAndProject).",
    "stratified_split": "Per-label ranks: windows are partitioned by (label, md5 bucket) and offset by a prefix sum "
                        "over the small (label, bucket) count table; the label quotas are a broadcast of one row per "
                        "label.",
    "language_id": "Trigram counts are aggregated once (cached) and feed training and scoring; AQE picks the join "
                   "strategy for the model at run time; the document x language fan-out is over the language set.",
    "near_dup_jaccard": "Prefix filtering: only rare-first prefix words are joined, with the size filter in the join "
                        "condition; no cartesian or nested-loop joins.",
    "near_dup_chars": "Pieces join substrings on (piece, position bucket, length band); distinct matched pieces are "
                      "counted with a partial bit_or aggregate over 128-bit text ids before the difflib UDF "
                      "(ArrowEvalPython) sees the few surviving pairs.",
    "build_dataset": "Keyed dedup (partial WindowGroupLimit), balance and split; the candidate table is persisted "
                     "(InMemoryTableScan) because several branches read it.",
}


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def ops(text: str, limit: int = 160) -> str:
    """The final operator tree of a formatted explain, with each Exchange's
    partitioning; the stored plans behind cached relations are folded."""
    tree, _, details = text.partition("\n\n")
    parts = {}
    for block in details.split("\n\n"):
        m = re.match(r"\((\d+)\) (?:Exchange|BroadcastExchange)", block.strip())
        a = re.search(r"Arguments: ([^\n]+)", block)
        if m and a:
            parts[m.group(1)] = re.sub(r"#\d+L?", "", a.group(1)).split(", ENSURE")[0].split(", [plan_id")[0]
    keep, fold_at = [], None
    for line in tree.split("\n")[1:]:
        if line.startswith("+- == Initial Plan =="):
            break
        if line.startswith("+- == Final Plan ==") or not line.strip():
            continue
        lead = len(line) - len(line.lstrip(" "))
        if fold_at is not None and lead >= fold_at:
            continue
        fold_at = None
        if "== Final Plan ==" in line or "== Initial Plan ==" in line:  # a stored plan printed inline
            fold_at = lead
            continue
        if keep and "AdaptiveSparkPlan (" in line:  # plan stored behind a cache
            fold_at = line.index("AdaptiveSparkPlan") - 3
            keep.append(line[:line.index("AdaptiveSparkPlan")] + "(cached relation, computed once)")
            continue
        node = re.search(r"\((\d+)\)", line)
        if node and node.group(1) in parts and "Exchange" in line:
            line += "  [" + parts[node.group(1)] + "]"
        keep.append(line)
    if len(keep) > limit:
        keep = keep[:limit] + [f"... ({len(keep) - limit} more lines)"]
    return "\n".join(keep)


def main() -> None:
    from quire.plans.catalog import QUERIES
    from quire.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    out = ["# Physical plans of selected queries", "",
           f"Operator trees after execution on `{sf}` (AQE final plans), produced by `tools/plan_report.py`.", ""]
    for name, note in NOTES.items():
        df = QUERIES[name](spark, sf)
        df.collect()  # same QueryExecution, so executedPlan is the final adaptive plan
        out += [f"## {name}", "", note, "", "```", ops(formatted(df)), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
