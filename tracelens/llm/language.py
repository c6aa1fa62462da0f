"""Language identification with a bit-sliced Bloom filter of character n-grams.

A slot of the filter is a bit mask with one bit a language, in as many words of 64 bits as they need; an n-gram is in
the filter of language l if bit l is set in the slots of both its hashes, so one AND of two slots returns all
languages that contain it.  A text's score for l is the number of its n-grams (repeats counted) in l, less what the filter's
false positives give by chance: (hits - n * fp) / (1 - fp).  The largest wins.

Learning: the n-grams of at most LEARN labelled texts of each language (those of least hash of the id), whole, are
counted where the texts are; an n-gram enters a language if its rate there is at least RATE and at least
SHARPNESS times the mean rate over the languages.  The masks of slots are united on the executors; the driver gets the packed
filter alone, whose size the languages set, and no n-gram.  Prediction reads whole texts, lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C
from . import words

#: Labelled texts that teach a language at most.
LEARN = 1500
SIZES, SLOT_BITS, RATE, SHARPNESS = (2, 3, 4), 20, 2e-5, 1.6
#: Languages at most: every 64 take 24 MB of the filter.  More are an error.
MOST_LANGUAGES = 1024
UNKNOWN = "und"


def ngrams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` successive bytes."""
    x = data[: len(data) - size + 1].astype(np.uint64)
    for k in range(1, size):
        x = (x << np.uint64(8)) | data[k : len(data) - size + 1 + k]
    return (x + np.uint64(size << 56)) * np.uint64(0x9E3779B97F4A7C15)


def letters_only(raw: bytes) -> np.ndarray:
    """Bytes with everything that is neither an ASCII letter nor part of a non-ASCII character as a space, runs of spaces as one."""
    data = np.frombuffer(raw, np.uint8)
    data = np.where(words.WORD_BYTE[data] & ~((data >= 48) & (data <= 57)), data, 32).astype(np.uint8)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    return data, keep


def mask_type(langs: int) -> type:
    """The numbers that hold a bit for each of up to 64 languages."""
    return np.uint8 if langs <= 8 else np.uint64


class Filter:
    """The learned filter: `langs` in order, for each size and 64 languages the `slots` of masks, and each language's rate of false positives by size."""

    def __init__(self, langs: list[str], slots: dict[int, list[np.ndarray]] | None = None, common: str | None = None):
        """langs in the order of their bits; slots: by size, an array of masks for each 64 languages.  common: what a text without any known n-gram is taken for."""
        self.langs = langs
        self.common = self.langs.index(common) if common is not None else 0
        empty = lambda: [np.zeros(1 << SLOT_BITS, mask_type(len(langs[i : i + 64]))) for i in range(0, len(langs), 64)]
        self.slots = {size: (slots or {}).get(size) or empty() for size in SIZES}
        self.fp = np.zeros((len(self.langs), len(SIZES)))
        for at, size in enumerate(SIZES):
            for i in range(len(self.langs)):
                masks = self.slots[size][i // 64]
                self.fp[i, at] = np.count_nonzero(masks & masks.dtype.type(1 << (i % 64))) / len(masks)
        self.fp **= 2

    @staticmethod
    def places(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (gram >> np.uint64(64 - SLOT_BITS)).astype(np.int64), ((gram >> np.uint64(20)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    def scores(self, texts: list[str]) -> np.ndarray:
        """For each text and language: n-grams of the language per n-gram, corrected for false positives."""
        out = np.zeros((len(texts), len(self.langs)))
        for lo, hi in words.slices(texts):
            raw, bounds = words.lay_out(texts[lo:hi])
            data, keep = letters_only(b" " + raw + b"  ")
            place = np.zeros(len(keep) + 1, np.int64)
            np.cumsum(keep, out=place[1:])
            data, bounds = data[keep], place[bounds]
            total = np.zeros(hi - lo)
            for at, size in enumerate(SIZES):
                one, two = self.places(ngrams(data, size))
                begin = np.minimum(bounds[:-1], len(one))
                n = np.maximum(np.minimum(bounds[1:], len(one)) - begin, 0)
                total += n
                for word, slots in enumerate(self.slots[size]):
                    mask = slots[one] & slots[two]
                    for i in range(64 * word, min(64 * word + 64, len(self.langs))):
                        hits = np.zeros(len(mask) + 1, np.int64)
                        np.cumsum((mask >> mask.dtype.type(i - 64 * word)) & mask.dtype.type(1), out=hits[1:])
                        got = hits[begin + n] - hits[begin]
                        out[lo:hi, i] += (got - n * self.fp[i, at]) / (1 - self.fp[i, at])
            out[lo:hi] /= np.maximum(total, 1)[:, None]
        return np.maximum(out, 0)


def _counted(parts):
    """The n-grams of each batch of (lang, text): how often each occurs in a language."""
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])
    for part in parts:
        langs = np.array(part.column(0).to_pylist(), object)
        texts = part.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for lo, hi in words.slices(own):
                raw = " ".join(["", *own[lo:hi], ""]).lower().encode("utf-8", "replace")
                data, keep = letters_only(raw)
                for size in SIZES:
                    gram, n = np.unique(ngrams(data[keep], size), return_counts=True)
                    one = [pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), size, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(one, schema=schema)


def learn(labelled: DataFrame, limit: int = LEARN) -> Filter:
    """The filter of labelled(doc_id, text, lang), from at most `limit` whole texts a language; null texts and langs teach nothing."""
    C.batches(labelled.sparkSession)
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    # a language's share of hashes first, so that no language's rows are ordered in one task
    rows = rows.select("lang", F.xxhash64("doc_id", F.lit(3)).alias("h"), "text")
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not known:
        return Filter([])
    counts = labelled.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in known], "lang string, n long")
    near = rows.join(F.broadcast(counts), "lang").filter((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) * F.col("n") <= 1.2 * limit + 20)
    ranked = near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).filter(F.col("k") <= limit)
    grams = ranked.select("lang", "text").mapInArrow(C.lean(_counted), "lang string, size int, gram long, n long")
    grams = C.saved(grams.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = grams.groupBy("lang", "size").agg(F.sum("n").alias("total"))  # a row for each language and size
    langs = sorted(r["lang"] for r in known)
    order = labelled.sparkSession.createDataFrame(list(enumerate(langs)), "bit int, lang string")
    rated = grams.join(F.broadcast(totals), ["lang", "size"]).join(F.broadcast(order), "lang").select("size", "gram", "bit", (F.col("n") / F.col("total")).alias("rate"))
    slots = united(rated, len(langs))
    common = max(sorted(known, key=lambda r: r["lang"]), key=lambda r: r["n"])["lang"]
    return Filter(langs, slots, common)


def united(rated: DataFrame, langs: int) -> dict[int, list[np.ndarray]]:
    """The masks of rated(size, gram, bit, rate), for each size and 64 languages, of the n-grams that enter a language.

    A slot's bits are united before and after the shuffle; blocks of slots come to the driver packed, one after another.
    """
    by_gram = rated.groupBy("size", "gram").agg(F.sort_array(F.collect_list(F.struct("bit", "rate"))).alias("each"))
    mean = F.aggregate("each", F.lit(0.0), lambda s, x: s + x["rate"]) / F.lit(float(langs))
    enters = lambda x: (x["rate"] >= RATE) & (x["rate"] >= SHARPNESS * F.col("mean")) if langs > 1 else x["rate"] > 0
    inside = by_gram.withColumn("mean", mean).select("size", "gram", F.explode(F.filter("each", enters)).alias("in"))
    right = lambda x, n: F.call_function("shiftrightunsigned", x, F.lit(n)).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("in.bit") % 64)
    places = F.explode(F.array(right(F.col("gram"), 64 - SLOT_BITS), right(F.col("gram"), 20)))
    slots = inside.select("size", F.floor(F.col("in.bit") / 64).cast("int").alias("word"), mask.alias("mask"), places.alias("slot"))
    slots = slots.groupBy("size", "word", "slot").agg(F.bit_or("mask").alias("mask"))
    packed = slots.groupBy("size", "word", F.shiftright("slot", 12).alias("block")).agg(F.collect_list("slot").alias("slot"), F.collect_list("mask").alias("mask"))
    types = [mask_type(min(64, langs - i)) for i in range(0, langs, 64)]
    out = {size: [np.zeros(1 << SLOT_BITS, kind) for kind in types] for size in SIZES}
    for r in packed.toLocalIterator():  # a row for each 4,096 slots
        out[r["size"]][r["word"]][np.array(r["slot"])] = np.array(r["mask"], np.int64).view(np.uint64).astype(types[r["word"]])
    return out


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs(doc_id, text), and any further columns but text.

    `und` with score 0 if the text is null or has no letter, or nothing was learned; else score is the winner's part
    of all languages' scores.  Ties go to the first language by code point; a text with letters that shows none of
    the languages' n-grams is taken, with score 0, for the language that has most labelled texts.
    """
    spark = docs.sparkSession
    C.batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.drop("text").schema.add("lang_pred", "string").add("score", "double")
    at = docs.columns.index("text")

    def run(parts):
        m = shared.value
        for part in parts:
            text = part.column(at)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            points = m.scores([t or "" for t in text.to_pylist()])
            total = points.sum(1)
            if m.langs:
                best, top = points.argmax(1), points.max(1)
            else:
                best, top = np.zeros(len(letters), int), np.zeros(len(letters))
            known = letters & bool(m.langs)
            best = np.where(top > 0, best, m.common)
            langs = [m.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            score = np.where(known & (top > 0), top / np.where(total > 0, total, 1), 0.0)
            kept = [part.column(i) for i in range(part.num_columns) if i != at]
            names = [n for i, n in enumerate(part.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(C.lean(run), schema)


def held_out(docs: DataFrame):
    """True for the third of the documents that teaches nothing."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def languages(docs: DataFrame, limit: int = LEARN) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text, lang): learned from those not held out.

    A null doc_id is not held out and teaches nothing.
    """
    model = learn(docs.filter(~held_out(docs)).select("doc_id", "text", "lang"), limit)
    out = identify(docs.select("doc_id", F.coalesce(held_out(docs), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def in_known_language(docs: DataFrame, least: float = 0.0, limit: int = LEARN) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a score of more than `least`: rows in none of the learned languages go."""
    model = learn(docs.filter(~held_out(docs)).select("doc_id", "text", "lang"), limit)
    own = docs.withColumn("__text", F.col("text").cast("string")).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("__text").alias("text"))
    kept = identify(own, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") > least))
    return kept.select("row.*")
