"""The operators against brute force, round trips and held-out cases, and on the awkward inputs."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.llm import common, imatch, knn, language, licenses, mixing, near, packing, pages, secrets, store, words

ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n", "en", "a"), (4, "!!!", "en", "b"), (5, "one two", "en", None), (5, "one two", "en", None), (6, "x" * 200_000, "fr", "b"), (7, "one two", "en", "é")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "kept") for r in ODD], SCHEMA + ", class_id string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def vocabulary(name):
    return str(pytest.importorskip("public_tokenizers").path(name))


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(n)]
    for i in range(0, n, 4):  # near and exact copies of text i
        w = texts[i].split()
        for k in range(i % 3):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts


def test_near_duplicates_against_all_pairs(spark):
    texts = corpus()
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    value, bounds = words.shingles(texts)
    sets = [frozenset(value[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = collections.Counter()
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and sets[i]:
                if texts[i] != texts[j]:
                    links[i] += 1
                    links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in near.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: find(i) for i in range(len(texts))} == {i: r.class_id for i, r in got.items()}
    copies = collections.Counter(texts)
    assert all(got[i].n_copies == copies[t] - 1 for i, t in enumerate(texts))
    # links count other word sequences once, however many copies they have
    firsts = {t: i for i, t in reversed(list(enumerate(texts)))}
    want = {i: sum(1 for j in firsts.values() if texts[j] != t and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i, t in enumerate(texts)}
    assert want == {i: r.n_links for i, r in got.items()}


def test_near_duplicates_in_blocks(spark, monkeypatch):
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3 + f"end{i}" for i in range(40)]
    monkeypatch.setattr(near, "BLOCK", 8)
    got = near.near_duplicates(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {39}


def test_near_duplicates_on_odd_rows(spark, odd, empty):
    got = {r.doc_id: r.class_id for r in near.near_duplicates(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 5}
    assert near.near_duplicates(empty).count() == 0
    kept = near.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("top", [8, 2**63 - 1])
def test_rows_without_ids_are_documents(spark, top):
    text, own = ("quick brown foxes jump over lazy dogs and sleep in the sun all day", "seven other words make up this text here")
    rows = [(3, text, "en", "a"), (5, text, "en", "a"), (top, "one of the last", "en", "a"), (None, text, "en", "a"), (None, own, "en", "b"), (None, own, "en", "b"), (None, None, "en", None), (None, "", "en", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.class_id, r.n_copies) for r in near.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, 3, 2), (5, 3, 2), (top, top, 0), (None, 3, 2), (None, None, 1), (None, None, 1), (None, None, 0), (None, None, 0)], key=str)
    assert collections.Counter(r.text for r in near.one_of_each(docs).collect()) == {text: 1, "one of the last": 1, own: 1, None: 1, "": 1}


def test_mixed_rows_without_ids_take_their_own_copies(spark):
    rows = [(None if i % 2 else i, f"w{i} " + "w " * (i % 9), "en", "ab"[i % 3 > 0]) for i in range(400)] + [(7, "same id one", "en", "a"), (7, "same id two more", "en", "a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    got = mixing.mixed(docs).collect()
    taken, times = collections.Counter(), collections.Counter(r.text for r in got)
    for r in got:
        taken[r.source] += len(r.text.split())
    assert max(times.values()) <= 2 and all(abs(taken[s] - target[s]) <= 20 for s in target)


def test_mix_targets_and_takes(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "en", rng.choice(["a", "b", "c", "d", None])) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    order = sorted((s for s in sizes if s), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= set(over)
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken = collections.Counter()
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert math.isclose(r.target, target[source[r.doc_id]], rel_tol=1e-9) and 0 <= r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 60 for s in order)
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_on_odd_rows(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == 8 and mixing.mix(empty).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_fingerprints_and_edits(spark):
    texts = [t + " é😀" for t in corpus(60)] + ["", "a", "ab", None]
    ids = random.Random(3).sample(range(1000), len(texts))
    got = {r.doc_id: r for r in imatch.edited_and_next(spark.createDataFrame([(i, t) for i, t in zip(ids, texts)], "doc_id long, text string")).collect()}
    order = sorted(zip(ids, texts))
    seen = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == t:
            assert got[i].near_edited == 1


def test_one_term_changes_only_the_hashes_of_its_subsets(spark):
    rng = random.Random(8)
    rows = []
    for k in range(40):
        terms = sorted(rng.getrandbits(64) - (1 << 63) for _ in range(rng.choice([0, 1, 2, 20, 400])))
        more = rng.getrandbits(64) - (1 << 63)
        rows.append((terms, sorted([*terms, more]), more))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, more long")
    for r in df.select("a", "more", imatch.fingerprint(F.col("a")).alias("x"), imatch.fingerprint(F.col("b")).alias("y")).collect():
        x, y = r.x.split("."), r.y.split(".")
        part = lambda t: (t + (1 << 63)) >> 58
        low = lambda t, bits: (t >> (58 - bits)) & ((1 << bits) - 1)
        at, n = part(r.more), 64
        of = [0, 1 + at // 4, 17 + at // 16, 21 + at, *([21 + n + at] * (low(r.more, 2) == 0)), *([21 + 2 * n + at] * (low(r.more, 4) == 0))]
        assert len(x) == len(y) == 21 + 3 * n
        assert {i for i in range(len(x)) if x[i] != y[i]} <= set(of) and x[21 + at] != y[21 + at]
        for level, bits in ((21, 0), (21 + n, 2), (21 + 2 * n, 4)):
            full = {part(t) for t in r.a if low(t, bits) == 0}
            assert {i for i in range(n) if x[level + i] != imatch.NONE} == full


def test_half_edited_texts_are_nearer_than_the_next(spark):
    rng = random.Random(9)
    terms = ["".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(4000)]
    texts = [" ".join(rng.choices(terms, k=rng.choice([40, 150, 900]))) for _ in range(200)]
    got = imatch.edited_and_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r.near_edited > r.near_next for r in got) >= 0.97 * len(got)


def test_fingerprints_on_odd_rows_and_plan(odd, empty):
    df = imatch.edited_and_next(odd)
    assert "__lexicon" not in df._jdf.queryExecution().executedPlan().toString()  # else it is copied for each term
    assert df.count() == 8
    assert imatch.edited_and_next(empty).count() == 0
    assert imatch.fingerprints(odd).count() == 8


def test_language_reads_whole_texts(spark):
    words_of = {"en": "ethanosri", "fr": "eéuxailn"}
    rng = random.Random(6)
    text = lambda lang, n: " ".join("".join(rng.choice(words_of[lang]) for _ in range(5)) for _ in range(n))
    rows = [(i, "1 " * 4000 + text(lang, 400), lang, "s") for i, lang in enumerate(["en", "fr"] * 20)]
    got = language.languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["en", "fr"] * 20


def test_language_held_out(spark, odd, empty):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        lang, letters = rng.choice([("en", "ethanosri"), ("fr", "eéuxailn"), ("de", "enrichtäs")])
        rows.append((i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(30)), lang, "s"))
    got = {r.doc_id: r for r in language.languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert {r.doc_id for r in got.values() if r.held_out} == {r[0] for r in held}
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    out = {r.doc_id: r.lang_pred for r in language.languages(odd).collect()}
    assert out[1] == out[2] == out[3] == out[4] == "und"
    assert language.languages(empty).count() == 0
    assert language.in_known_language(odd).columns == odd.columns


@pytest.mark.parametrize("kind,file", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_encoder_equals_the_library(kind, file):
    from tracelens.llm.tokens import Encoder

    e = Encoder(vocabulary(file), kind)
    rng = random.Random(1)
    texts = ["", None, "it's  'tis DON'T", "a\n\nb \n c\t\td", "日本 İstanbul ﬁ é", "x's 12ab", "<|endoftext|> x", " nbsp  a"] + ["".join(rng.choice(" \n\t'sdtmrelvSD1!.éÉß") for _ in range(rng.randint(0, 50))) for _ in range(800)]
    ids, bounds = e.encode(texts)
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == e.library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind,file,ids", [("byte", "byte_bpe_50k.json", [64, 220, 50256, 2124]), ("word", "word_bpe_49k.json", [320, 49407, 343])])
def test_literals_of_added_tokens_are_the_tokens(kind, file, ids):
    from tokenizers import Tokenizer

    from tracelens.llm.tokens import Encoder

    library = Tokenizer.from_file(vocabulary(file))
    texts = ["a <|endoftext|> x", "plain text", "<|startoftext|>it's<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>", "日 <|endoftext|>", "plain text"]
    out, bounds = Encoder(vocabulary(file), kind).encode(texts)
    got = [out[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got[0] == ids and got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_covers_every_id_once(spark, odd, empty):
    path = vocabulary("byte_bpe_50k.json")
    rows = [(i, t) for i, t in enumerate(corpus(200))] + [(900, None), (901, "")]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path)
    got = pieces.collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in rows}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and np.frombuffer(r.ids, "<u2").tolist() == part and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for spans, total in [(by_doc[i], len(x)) for i, x in ids.items()] + [(s, None) for s in by_seq.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert total is None or at == total
        assert total is not None or at == 1024 or at & (at - 1) == 0
    whole = packing.sequences(pieces).collect()
    assert sum(r.n for r in whole) == sum(map(len, ids.values())) and all(len(r.ids) == 2 * r.n for r in whole)
    assert packing.pack(odd, path).select("doc_id").distinct().count() == 7 and packing.pack(empty, path).count() == 0


def test_hilbert_steps_are_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert(grid, 3)
    path = grid[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 8)) * 0.3, np.tile(rng.normal(size=(1, 8)), (60, 1))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [float("nan")] * 8), (1100, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = np.floor(256 * x.astype(float)).astype(int)
    want = []
    for i in range(0, len(x), 50):
        s = sorted(((-int(q[i] @ q[j]), j) for j in range(len(x)) if j != i))[:5]
        want += [(i, k + 1, j, -v) for k, (v, j) in enumerate(s)]
    assert sorted(map(tuple, knn.top_k(df, pivots=16).collect())) == want
    assert knn.top_k(df.limit(0)).count() == 0


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, knn.top_k(df).collect())) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]


def test_store_round_trip(spark, tmp_path, odd, empty):
    path = vocabulary("word_bpe_49k.json")
    texts = corpus(150)
    rows = [(i, t * 20) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, texts[0] * 20)]
    folder = f"file://{tmp_path}/s"
    store.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    start, got = 0, {r.doc_id: r for r in store.digests_of(spark, folder).collect()}
    back = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in store.restore(spark, folder).collect()}
    for i, x in sorted(rows):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        assert back[i] == ids and (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    bad = f"file://{tmp_path}/bad"
    store.write(spark.createDataFrame(rows[:3], "doc_id long, text string"), bad, path)
    spark.read.parquet(f"{bad}/recipes").withColumn("root", F.reverse(F.col("root"))).write.parquet(f"{bad}/r2")
    import shutil

    shutil.rmtree(f"{tmp_path}/bad/recipes")
    shutil.move(f"{tmp_path}/bad/r2", f"{tmp_path}/bad/recipes")
    with pytest.raises(ValueError, match="manifest"):
        store.digests_of(spark, bad)
    assert store.stored(odd, path).count() == 8 and store.stored(empty, path).count() == 0


def plain_fingerprint(terms):
    """The fingerprint of sorted term hashes, made part by part."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    number = lambda v, seed=42: xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed % (1 << 64))

    def chained(values):
        h = 42
        for v in values:
            h = number(v, h)
        return h

    def parts(of):
        out = []
        for p in range(64):
            own = [t for t in of if (t >> 58) + 32 == p]
            h = None
            for t in own:
                h = number(t) if h is None else number(t, number(signed(h)))
            out.append("--------" if h is None else f"{h & 0xFFFFFFFF:08X}")
        return out

    fine = parts(terms)
    united = []
    for n in imatch.UNITED:
        for i in range(0, 64, n):
            some = fine[i : i + n]
            united.append("--------" if set(some) == {"--------"} else f"{xxhash.xxh64_intdigest(('.'.join(some) + '.').encode(), 42):016X}")
    first = ["--------" if not terms else f"{chained(terms):016X}"]
    one = [t for t in terms if (t >> 56) & 3 == 0]
    two = [t for t in one if (t >> 54) & 3 == 0]
    return ".".join([*first, *united, *fine, *parts(one), *parts(two)])


def test_fingerprints_against_a_plain_version(spark):
    """Lexicon band, parts and likeness, recomputed term by term."""
    import re

    import xxhash

    texts = [*corpus(60, 3), "", "one", "the the the", "Ünïcode wörds 12 34", None]
    terms = lambda t: {(h - (1 << 64) if h >> 63 else h) for h in (xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\W_]+", (t or "").lower()))}
    df = collections.Counter(x for t in texts for x in terms(t))
    n = len(texts)
    band = {x % (1 << imatch.SLOT_BITS) for x, k in df.items() if imatch.RARE * n <= k <= imatch.COMMON * n}
    kept = lambda t: sorted(own if len(own := {x for x in terms(t) if x % (1 << imatch.SLOT_BITS) in band}) >= imatch.FEW else terms(t))

    def like(a, b):
        pairs = [(p, q) for p, q in zip(a.split("."), b.split(".")) if not p == q == "--------"]
        return sum(p == q for p, q in pairs) / len(pairs) if pairs else 1.0

    got = {r.doc_id: r for r in imatch.edited_and_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    told = [t or "" for t in texts]
    for i, t in enumerate(told):
        following = told[(i + 1) % n]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, other, after = (plain_fingerprint(kept(x)) for x in (t, edited, following))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own, other), (i, t[:40])
        assert got[i].near_edited == pytest.approx(like(own, other)) and got[i].near_next == pytest.approx(like(own, after))


def test_licenses(spark, odd, empty):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT")
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (2, "text\nReleased under the MIT Licence.\nLicensed under CC BY-NC 4.0"), (3, "MIT")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].license_id == "MIT" and got[2].license_id is None and got[2].notices == "CC-BY-NC-4.0,MIT" and got[3].notices == ""
    assert licenses.scan(odd).count() == 8 and licenses.scan(empty).count() == 0


def test_licenses_inside_longer_texts(spark):
    mit, bsd = (next(t for i, t in licenses.KNOWN if i == name) for name in ("MIT", "BSD-3-Clause"))
    gpl = (licenses.TEXTS / "GPL-2.0.txt").read_text()
    broken = lambda t, mark: "\n".join(f"{mark} {' '.join(t.split()[i : i + 9])}" for i in range(0, len(t.split()), 9))
    opening = " ".join(mit.split()[:9])
    rows = [
        f"/*\n{broken(mit, ' *')}\n */\nint main() {{}}", f"import os\n\n{broken(bsd, '#')}\n\nx = 1\n{broken(mit, '#')}", f"A book.\n\n{gpl}\n\nThe end.",
        broken(mit, "#")[:-40] + " and more", f"{opening} {opening} {broken(mit, '//')} tail", broken(mit, "").rstrip(".") + "s", f"{opening}\n" * 20_000, "",
    ]
    want = ["MIT", "BSD-3-Clause,MIT", "GPL-2.0", "", "MIT", "", "", ""]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(rows)) + [(99, None)], "doc_id long, text string")).collect()}
    assert [got[i].notices for i in range(len(want))] == want and got[99].notices == "" and not any(r.license_id for r in got.values())
    spots = licenses.known_spots(spark)
    assert spots and not any(f" {o}" in p for o, _ in spots for p, _ in spots)


def test_licenses_of_whole_texts(spark):
    text = lambda name: (licenses.TEXTS / f"{name}.txt").read_text()
    known = {i: t for i, t in licenses.KNOWN if len(t) > 200}
    owner = "\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n"
    gpl2 = text("GPL-2.0")
    want = [
        ("MIT", "MIT License" + owner + known["MIT"].replace("The above copyright", "The above\ncopyright")),
        ("MIT", known["MIT"].replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT")),
        ("MIT", "Copyright 2020 Someone, Inc. " + known["MIT"]),
        ("ISC", "ISC License" + owner + known["ISC"]),
        ("BSD-3-Clause", "BSD 3-Clause License" + owner + known["BSD-3-Clause"].replace("1. R", "\n* R").replace("2. R", "\n* R").replace("3. N", "\n* N")),
        *((name, text(name)) for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")),
        ("GPL-2.0", gpl2[: gpl2.index("END OF TERMS")].replace("51 Franklin Street, Fifth Floor", "59 Temple Place, Suite 330").replace("02110-1301 USA", "02111-1307 USA", 1)),
        ("Apache-2.0", " ".join(text("Apache-2.0").split("END OF TERMS")[0].split())),
        (None, text("Apache-2.0").replace("You must retain", "You must not retain")),
    ]
    rows = [(i, t) for i, (_, t) in enumerate(want)] + [(100, "Copyright 2020 Someone. Licensed under the MIT License.\nText.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license_id for i in range(len(want))] == [i for i, _ in want]
    assert got[100].notices == "MIT"


def test_licenses_by_identifier(spark):
    lines = ["// SPDX-License-Identifier: BSD-3-Clause", "# SPDX-License-Identifier: GPL-2.0-or-later", "/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-2-Clause */", " * SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "SPDX-License-Identifier: LicenseRef-Own", "SPDX-License-Identifier:"]
    want = ["BSD-3-Clause", "GPL-2.0-or-later", "Apache-2.0,BSD-2-Clause,MIT", "GPL-2.0", "", ""]
    whole = {i: t for i, t in licenses.KNOWN if i in ("Zlib", "BSL-1.0", "Unlicense") and len(t) > 200}
    rows = [(i, f"first\n{x}\nlast") for i, x in enumerate(lines)] + [(10, f"zlib License\n\n(C) 2020 Someone\n\n{whole['Zlib']}"), (11, whole["BSL-1.0"].replace("Software, and", "Software,\n  and")), (12, whole["Unlicense"].replace("http:", "https:")), (13, f"/* {whole['Zlib']} */ int x;")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].notices for i in range(len(want))] == want
    assert [got[i].license_id for i in (10, 11, 12, 13)] == ["Zlib", "BSL-1.0", "Unlicense", None] and got[13].notices == "Zlib"


def test_license_sql_on_whole_texts(spark):
    """The SQL, whose catalogue is the query's, on licences inside longer texts and on whole ones."""
    con = pytest.importorskip("duckdb").connect()
    texts = [p.read_text() for p in sorted(licenses.TEXTS.glob("*.txt"))]
    rows = list(enumerate([*texts, *[f"Before it.\n\n{t}\n\nAfter it." for t in texts], *[t for _, t in licenses.KNOWN], "a\n" + "\n".join(t for _, t in licenses.KNOWN), "", None]))
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {d: (i, n) for d, _, i, n in con.execute(licenses.oracle()).fetchall()}
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and all(got[len(texts) + k][1] for k in range(len(texts)))


def test_main_text_held_out():
    model, rng = pages.default_model(), random.Random(99)
    wrong = total = 0
    for _ in range(80):
        found, labels = pages.labelled(pages.labelled_page(rng))
        f, same = pages.features(found)
        states = pages.viterbi([sum(model[0].get(x, 0.0) for x in y) for y in f], same, model[1])
        wrong += sum(a != b for a, b in zip(states, labels))
        total += len(labels)
    assert wrong <= 0.02 * total
    page = '<html><head><title>t</title><script>"</p>"</script></head><body><nav><a href=/>x</a></nav><article><h1>A&amp;B</h1><p>One \n two.<br>three<p>Four.</article><div class="comments"><p>No.</p></div><footer>&copy; me</footer>'
    assert pages.main_text(page, model) == "A&B One two. three Four." and pages.main_text(None, model) == pages.main_text("", model) == ""


def test_main_text_on_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<article><p>Some text here, and more.</p></article>", "x")], "page_id long, url string, html string, text string")
    assert {r.page_id: (r.text, r.n_chars) for r in pages.extract(df).collect()} == {1: ("", 0), 2: ("", 0), 3: ("Some text here, and more.", 25)}


def test_secrets(spark, odd, empty):
    key = "0123456789abcdef0123456789abcdef01234567"
    rows = [(1, f'é token = "{key}" and commit {key}', "en", "a"), (2, "card 4111111111111111 and words", "en", None), (3, f"TOKEN = \"{key.upper()}\"!!", "en", "a")]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA + ", n_chars long")
    got = secrets.find_secrets(df).collect()
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert hashlib.sha256(text[r.doc_id][r.start : r.stop].encode()).hexdigest() == r.value_sha256
    assert [(r.doc_id, r.is_secret) for r in sorted(got, key=lambda r: (r.doc_id, r.start))] == [(1, True), (1, False), (2, False), (3, True)]
    clean = {r.doc_id: r for r in secrets.without_secrets(df).collect()}
    assert clean[1].text == f'é token = "[SECRET]" and commit {key}' and clean[1].n_chars == len(clean[1].text) and clean[2].text == rows[1][1]
    assert secrets.find_secrets(odd).filter("is_secret").count() == 0 and secrets.find_secrets(empty).count() == 0
    assert secrets.without_secrets(odd).columns == odd.columns


def test_secret_features_are_the_same_in_sql(spark):
    rows = secrets.labelled_findings(60, 8)
    df = spark.createDataFrame(rows, "value string, before string, after string, path string, label int")
    got = df.select("value", secrets.feature_columns(F.col("value"), F.col("before"), F.col("after"), F.col("path")).alias("f")).collect()
    for row, r in zip(rows, got):
        assert np.allclose(secrets.features_of(*row[:4]), list(r.f))


def test_running_sums_with_ties_and_nulls(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, 2, 3, rng.randint(0, 500)]), i, rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    got = {r.t: r.s for r in common.with_running_sum(df, "k", ["t"], "v", "s").collect()}
    total = 0
    for k, t, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        assert got[t] == total
        total += v


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i not in (9, 25)] + [(100, i) for i in range(101, 140)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[9] == 0 and got[25] == 10 and got[40] == 26 and got[139] == 100


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    texts = corpus(80) + ["!!!", "", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "own") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_chars long, size string")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"file://{tmp_path}/{k}")
        new = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert new.columns == docs.columns, name
        docs = new
    assert docs.count() > 0
