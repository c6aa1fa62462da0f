"""Quality rules against a plain version, on random and awkward texts."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tracelens.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in Q.SYMBOLS), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({k for i, x in enumerate(windows) if often[x] > 1 for k in (i, i + 1, i + 2)}), "n_stop_words": sum(x.lower() in Q.STOP_WORDS for x in w),
        "n_letters": sum(1 for x in "".join(w) if ord(x) > 127 or x.isalpha()), "n_lines": len(lines),
        "n_bullet_lines": sum(x.lstrip(" ")[0] in Q.BULLETS for x in lines), "n_cut_lines": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines),
    }


def verdict(c):
    broken = lambda r: (c[r.under] if r.under else 1) != 0 and ((r.least is not None and 1000 * c[r.top] < r.least * (c[r.under] if r.under else 1)) or (r.most is not None and 1000 * c[r.top] > r.most * (c[r.under] if r.under else 1)))
    base, other = [r.name for r in Q.BASE if broken(r)], [r.name for r in Q.THRESHOLDS if broken(r)]
    return bool(base), not base and not other, base + other


def texts():
    rng = random.Random(4)
    out = [None, "", " \t\r\n\x0b", "a", "a a", "a a a", "a a a a", "\x1cone\x1dtwo", "  x\u0085", "- a\n-b\n  • c\n...\n…  \nx ...", "1 2 3\n\n1 2 3\n1 2 3 \r\n1 2 3", "😀 " * 60, "word " * 70_000, "z" * 300_000]
    for _ in range(120):
        pool = ["the", "of", "and", "um", "##", "a|b", "é", "…", "x9", "\n", "\n- ", "\t", "...\n"] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([2, 9, 400]))]
        out.append(rng.choice([" ", "  "]).join(rng.choice(pool) for _ in range(rng.choice([3, 40, 60, 200]))))
    return out


def test_counts_and_verdicts(spark):
    given = texts()
    rows = {r.doc_id: r for r in Q.quality(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")).collect()}
    assert len(rows) == len(given)
    for i, t in enumerate(given):
        want = plain(t)
        assert {c: rows[i][c] for c in Q.COUNTS} == want, repr((t or "")[:80])
        assert (rows[i].base_failed, rows[i].kept, rows[i].failed) == verdict(want)
    assert {r.kept for r in rows.values()} == {True, False}


def test_tables_and_own_rules(spark):
    docs = spark.createDataFrame([(1, "one two", "x", True), (1, "one two", "x", True), (None, "three", None, None)], "doc_id long, text string, failed string, kept boolean")
    assert Q.quality(docs.limit(0)).collect() == []
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in Q.quality(docs).collect()) == [(0, 1, False), (1, 2, False), (1, 2, False)]
    own = Q.quality(docs, base=(), rules=(Q.Rule("two", "n_words", None, 2000),)).collect()
    assert sorted((r.n_words, r.kept) for r in own) == [(1, False), (2, True), (2, True)]


def test_one_projection_without_python(spark):
    plan = Q.quality(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert F.size(Q.compiled()) is not None
