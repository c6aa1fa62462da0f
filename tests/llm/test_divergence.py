"""Divergence of sources against a plain version, with many seats, many slices and awkward rows."""

import collections
import random
import re

import numpy as np
import pytest

from tracelens.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, item string"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def corpus(sources, n=400, seed=2):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdÉé") for _ in range(rng.randint(1, 4))) for _ in range(90)] + ["KelvinK", "İ"]
    rows = [(i, " ".join(rng.choice(pool[: rng.choice([9, 40, 92])]) for _ in range(rng.randint(0, 30))) + rng.choice([".", "_x", "9é"]), rng.choice(["en", "en", "fr"]), f"s{rng.randrange(sources)}", "x") for i in range(n)]
    return rows + [(None, None, "en", "s1", "x"), (1, "", "de", "only", None), (2, "one two", None, None, None), (2, "one two", None, "a", None), (3, "X" * 100_000, "fr", "long", None), (4, "9 !", "en", "none", None)]


def plain(rows, least=30, top=50):
    docs = [("".join(c.lower() if c.isascii() else c for c in t or ""), lang or "", source or "") for _, t, lang, source, *_ in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(WORD.findall(t), s) for t, of, s in docs if of == lang]
        df = collections.Counter(w for ws, _ in own for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        count = {s: collections.Counter(w for ws, of in own if of == s for w in ws) for s in {s for _, s in own}}
        whole = collections.Counter(w for ws, _ in own for w in ws)
        part = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        p, q = {s: part(c) for s, c in count.items()}, part(whole)
        for s in p:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in p if o != s]
            terms = [(q[w] - p[s][w], w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for name, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, name, item, -v, r + 1) for r, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("sources", "slice_terms", "least"), [(3, 1 << 16, 30), (23, 20, 10), (9, 7, 10**6)])
def test_against_plain(spark, sources, slice_terms, least):
    rows = corpus(sources)
    got = sorted(map(tuple, D.divergence(spark.createDataFrame(rows, SCHEMA), least_documents=least, slice_terms=slice_terms).collect()))
    assert got == plain(rows, least)


def test_empty_and_whole_words(spark, monkeypatch):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    monkeypatch.setattr(D, "PIECE", 5)
    text = b"abc de" * 7 + b"xyz" * 9
    assert [w for p in D.pieces(text) for w in D.WORD.findall(p)] == D.WORD.findall(text)


def test_parts_are_exact():
    for total, terms in ((10, 3), (2**40 + 7, 10**6), (2**60, 5)):
        counts = np.array([0, 1, 5, total // 3, total], np.int64)
        assert D.part_of(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in counts]


def test_every_two_seats_meet_once(spark):
    from pyspark.sql import functions as F

    for seats in (2, 4, 10):
        met = collections.Counter()
        frame = spark.range(seats).select(*[D.partner(F.col("id"), F.lit(seats), t).alias(f"t{t}") for t in range(seats - 1)], "id").collect()
        for r in frame:
            for t in range(seats - 1):
                met[tuple(sorted((r["id"], r[f"t{t}"])))] += 1
        assert met == {(a, b): 2 for b in range(seats) for a in range(b)}
