"""Text statistics against brute force, the cascade's order and verdicts, and a plan without Python."""

import random
import re

from quire.llm import rule_cascade as rc


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    cover = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def texts():
    rng = random.Random(4)
    out = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n \n", "#|<> ü ß　漢 \x0b\x1c z", "one two\n" * 3000]
    for _ in range(120):
        out.append("".join(rng.choice(["a", "b", "cc", "é", "#", "...", "A"]) + rng.choice([" ", " ", "\n", "\t", "\x0b"]) for _ in range(rng.randint(1, 160))))
    return out


def test_statistics(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rc.text_statistics(docs).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_verdict_does_not_depend_on_order(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    rows = rc.text_statistics(docs)
    plain = " or ".join(f"({r})" for r in [rc.BASE_FAILED, *rc.RULES.values()])
    want = {r.doc_id: not r.bad for r in rows.selectExpr("doc_id", f"{plain} as bad").collect()}
    for names in (list(rc.RULES), list(rc.RULES)[::-1]):
        got = rc.quality_rules(docs, {n: rc.RULES[n] for n in names})
        assert {r.doc_id: r.kept for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_order_is_by_rejection_per_cost(spark):
    rows = spark.createDataFrame([(i, f"word {i} " * 20) for i in range(300)], "doc_id long, text string")
    slow = "length(" + "regexp_replace(" * 30 + "text" + ", 'o', 'oo')" * 10 + ", 'x', 'y')" * 20 + ") > 0"
    found = rc.measured(rows, {"slow_all": slow, "never": "length(text) < 0", "cheap_all": "length(text) > 0"})
    names = [f[0] for f in found]
    assert names.index("cheap_all") < names.index("slow_all") and dict((n, s) for n, _, s in found)["never"] == 0
    assert names[-1] == "never"


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rc.quality_rules(docs).collect() == []
    assert [tuple(r) for r in rc.quality_rules(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [(None, 0, 0, 0, 0, 0, True, False)]
