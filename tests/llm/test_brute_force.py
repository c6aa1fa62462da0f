"""Operators against plain versions of themselves, and on texts and tables that are awkward in size or kind."""

import collections
import itertools
import math
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelens.llm import common, knn, language, mixing, near, packing, pages, queries, secrets, store, words

DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain_classes(texts):
    """Links and classes of all pairs of distinct word sequences, by shingle sets of strings."""
    sequences = {}
    for i, t in enumerate(texts):
        w = tuple(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower()))
        sequences.setdefault(w or ("", i), []).append(i)
    keys = list(sequences)
    sets = [frozenset(k[j : j + 5] for j in range(max(1, len(k) - 4))) if k[0] else frozenset() for k in keys]
    links = [(a, b) for a, b in itertools.combinations(range(len(keys)), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return [sequences[k] for k in keys], links


def family(rng, size, edits, n=200):
    """One text, edited anew for each of its near copies."""
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(n)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(n)] = word()
        out.append(" ".join(w))
    return out


def recall_of(spark, texts):
    members, links = plain_classes(texts)
    got = {r.doc_id: r for r in near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(texts)
    found = sum(got[m[0]].n_links for m in members)
    assert found <= 2 * len(links)
    count = collections.Counter(x for link in links for x in link)
    assert all(got[m[0]].n_links <= count[i] for i, m in enumerate(members))
    joined = sum(got[members[a][0]].class_id == got[members[b][0]].class_id for a, b in links)
    return found / max(1, 2 * len(links)), joined / max(1, len(links)), len(links)


def test_recall_in_families_of_near_copies(spark, monkeypatch):
    rng = random.Random(3)
    texts = [t for size, edits in ((150, 2), (40, 1), (2, 1), (2, 2), (3, 1)) for t in family(rng, size, edits)] + [t for _ in range(40) for t in family(rng, 2, 2)]
    monkeypatch.setattr(near, "BLOCK", 32)
    found, joined, n = recall_of(spark, texts)
    assert n > 1000 and found >= 0.97 and joined >= 0.995


@tables
def test_recall_on_documents(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").select("text").collect()
    found, joined, n = recall_of(spark, [r.text for r in rows])
    assert n > 0 and found >= 0.9 and joined >= 0.9


def test_pairs_belong_to_one_trie_and_depth():
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, (30, 4, 3)).astype(">u2")
    for a, b in itertools.combinations(range(30), 2):
        shared = [next((k for k in range(3) if labels[a, t, k] != labels[b, t, k]), 3) for t in range(4)]
        own = [(t, d) for t in range(4) for d in range(1, 4) if near.first_shared(labels, t, d)[a, b] and shared[t] >= d]
        assert own == ([(shared.index(max(shared)), max(shared))] if max(shared) else [])


def test_mixed_keeps_rows_apart(spark):
    rows = [(None, f"a b c {i}", "en", "s") for i in range(6)] + [(1, "one two", "en", "t"), (1, "one two three four", "en", "t"), (2, "x " * 50, "en", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = collections.Counter(r.text for r in mixing.mixed(docs).collect())
    assert max(got.values()) <= 2 and set(got) <= {r[1] for r in rows}
    assert sum(r.copies for r in mixing.mix(docs).collect()) == pytest.approx(sum(got.values()), abs=2)


def test_inclusion_odds_differ_within_a_source(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([1, 4, 60, 900]), "en", "s" if i % 3 else "t") for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    for s in ("s", "t"):
        own = [r for r in got if r.source == s]
        taken = sum(r.taken for r in own)
        assert abs(taken - own[0].target) <= 900
        mean = {n: np.mean([r.copies for r in own if r.size == n]) for n in (1, 4, 60, 900)}
        assert mean[1] <= mean[4] + 0.1 <= mean[60] + 0.2 <= mean[900] + 0.3
    small = [r for r in got if r.source == "t" and r.size == 1]
    large = [r for r in got if r.source == "t" and r.size == 900]
    assert np.mean([r.copies for r in large]) - np.mean([r.copies for r in small]) > 0.2


def test_language_of_unknown_scripts(spark):
    texts = {"en": "the quick brown fox and the lazy dog were there", "fr": "le renard brun et le chien paresseux sont ici"}
    rows = [(i, texts[lang], lang, "s") for i, lang in enumerate(["en"] * 20 + ["fr"] * 10)] + [(100, "日本語", None, "s"), (101, "12 34 !", None, "s"), (102, None, None, "s"), (103, "Zq", None, "s")]
    got = {r.doc_id: r for r in language.languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[100].lang_pred == "en" and got[100].score == 0 and got[103].lang_pred in ("en", "fr")
    assert got[101].lang_pred == got[102].lang_pred == "und" and got[5].lang_pred == "en" and got[25].lang_pred == "fr"
    kept = {r.doc_id for r in language.in_known_language(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert 100 not in kept and 102 not in kept and {0, 25} <= kept


def test_scores_are_those_of_exact_ngram_sets(spark, monkeypatch):
    """With next to no false positives the filter counts as sets of n-grams do; more than 64 languages take several words."""
    rng = random.Random(1)
    langs = [f"l{i:03d}" for i in range(70)]
    vocabulary = {lang: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for lang in langs}
    grams = {size: collections.defaultdict(dict) for size in language.SIZES}
    for lang, ws in vocabulary.items():
        data, keep = language.letters_only((" " + " ".join(ws) + " ").encode())
        for size in language.SIZES:
            found = language.ngrams(data[keep], size).tolist()
            for g in found:
                grams[size][g][lang] = 1 / len(found)
    monkeypatch.setattr(language, "SHARPNESS", 0.0)
    rated = [(size, g - (1 << 64) if g >> 63 else g, langs.index(lang), rate) for size, found in grams.items() for g, each in found.items() for lang, rate in each.items()]
    model = language.Filter(langs, language.united(spark.createDataFrame(rated, "size int, gram long, bit int, rate double"), len(langs)))
    assert all(len(s) == 2 for s in model.slots.values())
    texts = [" ".join(vocabulary[lang]) for lang in langs] + ["", "...", " ".join(vocabulary["l069"][:2] + vocabulary["l001"][:1])]
    got = model.scores(texts)
    for t, row in zip(texts, got):
        data, keep = language.letters_only(b" " + t.encode() + b"\n  ")
        n = hits = 0
        for size in language.SIZES:
            own = language.ngrams(data[keep], size)[: len(data[keep]) - 2][: sum(keep) - 3]
            own = own.tolist()
            n += len(own)
            hits = hits + np.array([sum(lang in grams[size][g] for g in own) for lang in langs])
        if n > 10:
            assert np.abs(row - hits / n).max() < 0.1 and row.argmax() in np.flatnonzero(hits == hits.max())


def test_two_hundred_languages(spark):
    """The driver holds the packed filter alone: 8 MB for each size and 64 languages."""
    rng = random.Random(6)
    pools = {f"l{i:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(25)] for i in range(200)}
    text = lambda ws: " ".join(rng.choice(ws) for _ in range(40))
    rows = [(i, text(ws), lang, "s") for i, (lang, ws) in enumerate([x for x in pools.items() for _ in range(12)])]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.learn(docs.filter(~language.held_out(docs)))
    assert len(model.langs) == 200 and sum(m.nbytes for ms in model.slots.values() for m in ms) <= 3 * 4 * 8 << 20
    got = {r.doc_id: r.lang_pred for r in language.identify(docs.select("doc_id", "text"), model).collect()}
    assert np.mean([got[i] == lang for i, _, lang, _ in rows]) > 0.97


def test_top_k_with_large_numbers_and_short_vectors(spark):
    rows = [(0, [2.0**41, 1.0]), (50, [1.0, 2.0]), (1, [3.0]), (2, [1e30, -1.0]), (3, [-1e300, 0.5]), (4, [float("inf"), 0.0]), (5, None), (6, []), (7, [0.25, 0.5]), (7, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = lambda v: [math.floor(x * 256) for x in v] + [0] * (2 - len(v))
    kept = {i: whole(v) for i, v in rows if v is not None and i != 4 and (i, v) != (7, [0.5, 0.5])}
    want = []
    for q in (0, 50):
        score = lambda x: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(kept[q], kept[x]))))  # noqa: B023, E731
        want += [(q, k + 1, x, score(x)) for k, x in enumerate(sorted((x for x in kept if x != q), key=lambda x: (-score(x), x))[:5])]
    assert sorted(map(tuple, knn.top_k(df).collect())) == sorted(want)


def test_top_k_prunes_where_vectors_form_clusters(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((40, 16)) * 4
    x = np.concatenate([c + rng.standard_normal((100, 16)) * 0.2 for c in centers])
    rng.shuffle(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent = []
    monkeypatch.setattr(common, "saved", lambda frame, name, *a, keep=common.saved: (out := keep(frame, name, *a), sent.append(out) if name == "sent" else None)[0])
    monkeypatch.setattr(knn, "BLOCK", 16)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in knn.top_k(df).collect()}
    w = np.floor(x * 256).astype(np.int64)
    for q in range(0, len(x), 50):
        s = w @ w[q]
        order = [int(i) for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, int(s[i])) for i in order]
    tiles = sent[0].select("tile").distinct().count()
    assert tiles >= 20 and sent[0].count() < 0.2 * tiles * len(range(0, len(x), 50))


def test_score_bounds_hold():
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((400, 8)) * 5, rng.standard_normal((30, 8))
    pivots = x[:5]
    cell, far, wide, norm = knn._near(x, pivots)
    each = [cell == c for c in range(5)]
    low, high = knn.score_bounds(q, pivots, *[np.array([f(v[m]) for m in each]) for f, v in ((max, far), (max, wide), (min, norm), (max, norm))])
    for c, m in enumerate(each):
        s = q @ x[m].T
        assert (low[:, c] <= s.min(1)).all() and (s.max(1) <= high[:, c]).all()


def test_viterbi_and_training_against_enumeration():
    rng = random.Random(7)
    for _ in range(50):
        n = rng.randint(1, 6)
        score, same = [rng.uniform(-3, 3) for _ in range(n)], [rng.randint(0, 1) for _ in range(n)]
        move = [[[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)] for _ in range(2)]
        value = lambda s: sum(a for a, on in zip(score, s) if on) + sum(move[same[t]][s[t - 1]][s[t]] for t in range(1, n))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert value(pages.viterbi(score, same, move)) == pytest.approx(value(best))
    # one step of training moves the weights up the log-likelihood's gradient
    found = [(("body", "p"), (), "Some words of a text, that ends.", 0), (("body", "nav", "ul", "li"), ((), ("menu",), (), ()), "Home", 4), (("body", "p"), (), "More of it.", 0)]
    labels = [1, 0, 1]
    weight, move = pages.train([(found, labels)], epochs=1, rate=1e-3, decay=0.0)
    fs, same = pages.features(found)

    def likelihood(weight, move):
        score = [sum(weight.get(f, 0.0) for f in x) for x in fs]
        value = lambda s: sum(a for a, on in zip(score, s) if on) + sum(move[same[t]][s[t - 1]][s[t]] for t in range(1, 3))
        return value(labels) - math.log(sum(math.exp(value(s)) for s in itertools.product((0, 1), repeat=3)))

    start = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)]
    once = [f for f, n in collections.Counter(f for x in fs for f in x).items() if n == 1]  # steps of others are scaled block by block
    for f in once:
        slope = likelihood({f: 1e-6}, start) - likelihood({f: -1e-6}, start)
        assert weight[f] == pytest.approx(0, abs=1e-12) if abs(slope) < 1e-12 else weight[f] * slope > 0
    assert likelihood(weight, move) > likelihood({}, start)


def test_main_text_keeps_what_is_no_boilerplate():
    model = pages.default_model()
    page = "<html><body><nav><a href=/>Home</a></nav><article><p>The sum <math><mi>x</mi></math> is shown, and it's long enough.</p><object>What stands for it, in words.</object><p title=it's>After <svg> that nothing closes, there is more text.</p></article></body></html>"
    text = pages.main_text(page, model)
    assert "The sum x is shown" in text and "What stands for it" in text and "there is more text." in text and "Home" not in text
    assert pages.main_text("<body>Only some text, without any element. It is the article.</body>", model) != ""


@pytest.mark.parametrize("page", ['<div x="' * 130_000, "<a " * 300_000, "<p>x</p>" + "<iframe>" * 100_000, "<" * 1_000_000, "<div>" * 150_000 + "</p>" * 200_000, "<!--" * 250_000, "<p>a &amp; b</p>" * 60_000, "<i x='\">" * 100_000])
def test_main_text_of_long_pages(page):
    model = pages.default_model()
    began = time.time()
    pages.main_text(page, model)
    assert time.time() - began < 20


def scanned(texts, paths, forest):
    """find_secrets() in Python: matches, features and trees, one at a time."""

    def walk(node, f):
        while isinstance(node, tuple):
            node = node[2] if f[node[0]] <= node[1] else node[3]
        return node

    out = []
    for i, (t, path) in enumerate(zip(texts, paths)):
        last = 0
        for k, m in enumerate(re.finditer(secrets.CANDIDATE, t or "")):
            value = re.sub(secrets.LEAD, "", m[0])
            lead = m[0][: len(m[0]) - len(value)]
            follows = re.compile(secrets.CANDIDATE).search(t, m.end())
            after = t[m.end() : follows.start() if follows else len(t)][: secrets.AFTER]
            f = secrets.features_of(value, (t[last : m.start()][-secrets.BEFORE :] + lead)[-secrets.BEFORE :], after, path or "")
            out.append((i, k, m.end() - len(value), m.end(), round(sum(walk(tree, f) for tree in forest) / len(forest), 3)))
            last = m.end()
    return out


def test_secret_scan_against_trees_in_python(spark):
    forest = secrets.default_forest()
    made = secrets.labelled_findings(400, seed=77)
    rng = random.Random(78)
    whole = [secrets.labelled_text(rng)[:2] for _ in range(300)]
    texts = [f"{before}{value}{after}" for value, before, after, _, _ in made[:300]] + [" ".join(f"{b}{v}{a}" for v, b, a, _, _ in made[300:]), "", None, "é" * 50 + " token = 'abc123def456' ü"]
    paths = [p for _, _, _, p, _ in made[:300]] + ["src0", None, "x", None]
    texts, paths = texts + [t for t, _ in whole], paths + [p for _, p in whole]
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip(texts, paths))], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.finding, r.start, r.stop, round(r.score, 3)) for r in secrets.find_secrets(df).collect())
    want = scanned(texts, paths, forest)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) <= 0.0011 for g, w in zip(got, want))


@tables
def test_secrets_that_the_documents_hold(spark):
    """Tokens that are assigned are secrets; the numbers of cards are not."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = d.select("doc_id", "text").collect()
    planted = sum(len(re.findall(r"(?i)token = \"[0-9a-f]{40}", r.text or "")) for r in rows)
    numbers = sum(len(re.findall(r"(?<![0-9])[0-9]{16}(?![0-9])", r.text or "")) for r in rows)
    found = secrets.find_secrets(d).groupBy("is_secret").count().collect()
    count = {r["is_secret"]: r["count"] for r in found}
    assert planted > 5 and numbers > 5 and count[True] == planted and count[False] == numbers


def test_secret_scan_of_a_long_text(spark):
    import hashlib

    text = "\n".join(f"{hashlib.sha1(str(i).encode()).hexdigest()} f" for i in range(25_000))
    df = spark.createDataFrame([(1, text, "a", 5)], "doc_id long, text string, source string, __pieces long")
    began = time.time()
    assert secrets.find_secrets(df).count() == 25_000
    masked = secrets.without_secrets(df.withColumn("text", F.concat(F.lit("password = 'x8Gk29dLq0Zm' "), "text"))).first()
    assert time.time() - began < 60 and masked["__pieces"] == 5 and "x8Gk29dLq0Zm" not in masked["text"]


def test_store_of_a_long_text(spark):
    path = queries.vocabulary("word_bpe_49k.json")
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(300_000))
    began = time.time()
    got = store.stored(spark.createDataFrame([(2, text), (1, "a")], "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.start for r in got}[2] == {r.doc_id: r.n_tokens for r in got}[1] and time.time() - began < 90


def test_batches_and_powers_are_bounded():
    long = words.powers(words.BASE, words.POWERS + 5)
    assert len(long) == words.POWERS + 5 and len(words._powers.get(words.BASE, [])) <= words.POWERS
    assert int(long[3]) == pow(words.BASE, 3, 2**64)
    assert len(packing._directions(packing.SEED)) == 1 << 16


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    """Each stage on what the one before kept: rows with nulls, repeated rows, a hot group of copies."""
    rng = random.Random(9)
    english = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so".split()
    french = "le de un et à être en avoir que pour dans ce il qui ne sur se pas plus par je avec tout faire son mettre autre on mais nous comme ou si leur y dire elle devoir avant deux même prendre aussi celui".split()
    text = lambda ws: " ".join(rng.choice(ws) for _ in range(rng.randint(30, 80)))
    rows = [(i, text(english if i % 3 else french), "en" if i % 3 else "fr", f"s{i % 4}", 0) for i in range(120)]
    rows += [(200 + i, rows[5][1], "en", "s1", 0) for i in range(40)]  # copies
    rows += [(300, None, None, None, 0), (None, text(english), None, "s0", 0), (None, text(english), None, None, 0), (301, "日本語だけ", None, "s2", 0), (302, "", None, "s2", 0), rows[7], rows[7]]
    rows += [(303, text(english) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "en", "s3", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r.asDict() for r in docs.collect()]
    kept = collections.Counter(r["text"] for r in seen["language"])
    assert kept == collections.Counter(r[1] for r in rows if r[1] and re.search("[a-z]", r[1]))
    members, links = plain_classes(sorted(kept))
    assert not links
    assert collections.Counter(r["text"] for r in seen["near_duplicates"]) == collections.Counter(set(kept))
    least = min(r["doc_id"] for r in seen["near_duplicates"] if r["text"] == rows[5][1])
    assert least == 5
    masked = [r["text"] for r in seen["secrets"]]
    assert sorted(masked) == sorted(re.sub(r"04dbebab91ab85687d33eeaaf9ac699e1188f962", secrets.MASK, r["text"]) for r in seen["near_duplicates"])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["secrets"] if secrets.MASK in r["text"])
    times = collections.Counter(r["text"] for r in seen["mix"])
    assert max(times.values()) <= 2 and set(times) <= set(masked)
    size = collections.Counter()
    taken = collections.Counter()
    for r in seen["secrets"]:
        size[r["source"]] += len(r["text"].split())
    for r in seen["mix"]:
        taken[r["source"]] += len(r["text"].split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, open_, rest = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}, set(order), 1.5 * sum(size.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        for s in full or set(open_):
            target[s] = 2 * size[s] if full else share[s]
        rest -= sum(target[s] for s in full)
        open_ -= full or set(open_)
    assert all(abs(taken[s] - target[s]) <= 80 for s in order)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    ids = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in times.elements())
    assert sum(r["length"] for r in seen["pack"]) == ids
    full = collections.Counter()
    for r in seen["pack"]:
        full[r["sequence_id"]] += r["length"]
    assert all(n == 1024 or n & (n - 1) == 0 for n in full.values())
