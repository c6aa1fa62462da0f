"""Divergence of sources: a systolic rotation of compressed term vectors among groups that stay where they are.

A group is one (lang, source); its vector holds how often it has each term that its lang keeps.  Vectors are cut in slices of about TERMS
terms, each compressed to a few bytes a term.  The groups of a lang sit in seats of a few groups; a seat's rows stay in the
partition that holds them, and the seats' vectors circulate: in each round of a round-robin tournament (the circle method) every seat meets
one other, one of the two travels, and all pairs between them are evaluated for both directions.  At home each group also meets the vector of
its whole lang and keeps a heap of the terms that it uses most above it.  Sums of slices and merged heaps are ranked at the end.

Each round is one written table, so that a lost executor costs a part of one round, and only one copy of the vectors travels at a time.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

LEAST_DOCUMENTS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a slice; groups of a seat, which grow with the groups until a lang has SEATS seats.
TERMS, LEAST_GROUPS, MOST_GROUPS, SEATS = 1 << 16, 4, 64, 16
#: Distinct (group, term) counts that a task keeps before it hands them on, and bytes of a text that are cut to words at once.
ENTRIES, PIECE = 200_000, 1 << 20
#: Words of UTF-8 bytes whose A-Z are lower-cased, and what ends one.
WORD, NO_WORD = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
RESULT = "lang string, source string, part string, item string, value long, rank int"


def pieces(text: bytes):
    """The text in pieces of about PIECE bytes that don't cut a word."""
    at = 0
    while len(text) - at > PIECE:
        m = NO_WORD.search(text, at + PIECE)
        stop = m.start() if m else len(text)
        yield text[at:stop]
        at = stop
    yield text[at:]


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, count, docs: summed over the documents that a task reads, as far as ENTRIES fit."""
    told = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in (lang, source)]
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])

    def rows(held):
        for (of, by), (count, seen) in held.items():
            terms = list(count)
            for lo in range(0, len(terms), 50_000):
                some = terms[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([of] * len(some)), pa.array([by] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([count[t] for t in some], pa.int64()), pa.array([seen[t] for t in some], pa.int64())],
                    schema=schema,
                )

    def run(parts):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for part in parts:
            for of, by, body in zip(*(c.to_pylist() for c in part.columns)):
                count, seen = held.setdefault((of, by), (Counter(), Counter()))
                own: set[bytes] = set()
                for piece in pieces(body.lower()):
                    found = WORD.findall(piece)
                    count.update(found)
                    own.update(found)
                seen.update(own)
            if sum(len(c) for c, _ in held.values()) > ENTRIES:
                yield from rows(held)
                held = {}
        yield from rows(held)

    return docs.select(*told, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("body")).mapInArrow(C.lean(run), "lang string, source string, term string, count long, docs long")


def squeezed(at: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending places and their counts, compressed."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + count.astype("<u8").tobytes(), 1)


def opened(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob) if blob else b""
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<u8", n, 4 * n).astype(np.int64)


def part_of(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly: three decimal digits at a time, so that 64 bits do."""
    under = total + PRIOR * terms
    rest = count.astype(object if under >= 1 << 53 else np.int64) + PRIOR
    out, rest = rest // under, rest % under
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // under, rest % under
    return (out + 1).astype(np.int64)


def dense(blob: bytes | None, width: int, total: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of all terms of a slice, and the places of those that occur."""
    out, (at, count) = np.zeros(width, np.int64), opened(blob)
    if width:
        out += part_of(np.zeros(1, np.int64), total, terms)
        out[at] = part_of(count, total, terms)
    return out, at


def compressed(rows: DataFrame, keys: list[str], pairs: str) -> DataFrame:
    """keys, width, blob of rows with an array of (at, count), sorted by at."""
    kept = rows.select(*keys, pairs)

    def run(parts):
        for part in parts:
            lists = part.column(len(keys))
            blobs, sizes = [], []
            for i in range(part.num_rows):
                flat = lists[i].values
                at, count = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                blobs.append(squeezed(at, count))
                sizes.append(len(at))
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keys))], pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=[*keys, "width", "blob"])

    schema = kept.drop(pairs).schema.add("width", "long").add("blob", "binary")
    return kept.mapInArrow(C.lean(run), schema)


def partner(seat: Column, seats: Column, turn: int) -> Column:
    """The seat that a seat meets in a turn, from 0 to seats - 2; seats is even.  Every two seats meet in one turn."""
    last = seats - 1
    other = F.pmod(F.lit(2 * turn) - seat, last)
    return F.when(seat == last, F.lit(turn)).when(other == seat, last).otherwise(other)


PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("slice", pa.int64()), ("at", pa.int64()), ("value", pa.int64())])
FOUND = "lang string, source string, item string, slice long, at long, value long"


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in PAIRS]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, PAIRS)], schema=PAIRS)


def _members(t: pa.Table) -> list[tuple]:
    """(source, parts, places) of each group of a seat."""
    return [(r["source"], *dense(r["blob"], r["width"], r["n"], r["terms"])) for r in t.select(["source", "blob", "width", "n", "terms"]).to_pylist()]


def at_home(key, groups: pa.Table, whole: pa.Table) -> pa.Table:
    """All pairs of a seat, and each group's heap of terms above the lang's part."""
    rows, lang, piece = [], key[0].as_py(), key[1].as_py()
    members = _members(groups)
    for i, (a, p, _) in enumerate(members):
        for b, q, _ in members[:i]:
            value = int(np.abs(p - q).sum())
            rows += [(lang, a, b, piece, None, value), (lang, b, a, piece, None, value)]
    for r in whole.to_pylist():
        mean, _ = dense(r["blob"], r["width"], r["n"], r["terms"])
        for a, p, at in members:
            above = p[at] - mean[at]
            at, above = at[above > 0], above[above > 0]
            if len(at) > TOP:  # ties at the edge stay for the heap
                least = np.partition(above, len(above) - TOP)[len(above) - TOP]
                at, above = at[above >= least], above[above >= least]
            for value, place in heapq.nsmallest(TOP, zip((-above).tolist(), at.tolist())):
                rows.append((lang, a, None, piece, place, -value))
    return _table(rows)


def meeting(key, host: pa.Table, guest: pa.Table) -> pa.Table:
    """Both directions of all pairs between two seats; guests are opened one after another."""
    rows, lang, piece = [], key[0].as_py(), key[1].as_py()
    members = _members(host) if host.num_rows and guest.num_rows else []
    for k in range(guest.num_rows if members else 0):
        ((b, q, _),) = _members(guest.slice(k, 1))
        for a, p, _ in members:
            value = int(np.abs(p - q).sum())
            rows += [(lang, a, b, piece, None, value), (lang, b, a, piece, None, value)]
    return _table(rows)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = LEAST_DOCUMENTS, top: int = TOP, slice_terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of every group (lang, source) of docs: in part `pair` its distance to each other source of
    the lang, in part `term` its `top` terms above the lang (50 at most), largest values first, ties by the item's UTF-8 bytes.

    Null texts, langs and sources are read as ''.  A group without terms still has its pairs, a lang without kept terms has pairs of value 0, a
    lang with one source has no pairs.  Repeated rows count each; other columns are not looked at.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    C.batches(spark)
    summed = term_counts(docs, text, lang, source).groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    kept = C.saved(
        summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("each")).filter(F.col("docs") >= least_documents).drop("docs"), "kept",
    )
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    most = langs.agg(F.max("terms")).first()[0] or 0
    slices = max(1, -(-most // slice_terms))
    within = W.partitionBy("lang", "slice").orderBy("term")
    terms = C.saved(kept.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices))).withColumn("at", F.row_number().over(within).cast("long") - 1), "terms")
    counts = terms.select("lang", "slice", "at", F.inline("each"))
    listed = lambda count: F.sort_array(F.collect_list(F.struct("at", F.col(count).alias("count")))).alias("pairs")
    vectors = compressed(counts.groupBy("lang", "source", "slice").agg(listed("count")), ["lang", "source", "slice"], "pairs").drop("width")
    wholes = C.saved(compressed(terms.groupBy("lang", "slice").agg(listed("total")), ["lang", "slice"], "pairs"), "wholes")

    occurring = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"))]).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    row = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    size = F.count("*").over(W.partitionBy("lang"))
    seated = occurring.withColumns({"row": row, "size": size}).withColumn("own", F.least(F.lit(MOST_GROUPS), F.greatest(F.lit(LEAST_GROUPS), F.ceil(F.col("size") / SEATS))))
    seated = seated.select("lang", "source", F.floor(F.col("row") / F.col("own")).alias("seat"), (2 * F.ceil(F.col("size") / F.col("own") / 2)).cast("long").alias("seats"))
    groups = C.saved(seated.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "terms", "lang_n"]), "groups")
    turns = (groups.agg(F.max("seats")).first()[0] or 1) - 1

    key = ["lang", "slice", "seat"]
    sliced = groups.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    rows = sliced.join(vectors, ["lang", "source", "slice"], "left").join(wholes.select("lang", "slice", "width"), ["lang", "slice"], "left").fillna(0, ["width"])
    residents = C.saved(rows.select(*key, "seats", "source", "n", "terms", "width", "blob"), "residents")
    staying = residents.repartition(C.width(spark), *key).persist(StorageLevel.MEMORY_AND_DISK)
    everywhere = wholes.join(groups.select("lang", "seat", F.col("lang_n").alias("n"), "terms").distinct(), "lang").select(*key, "n", "terms", "width", "blob")
    found = [C.saved(staying.groupBy(*key).cogroup(everywhere.groupBy(*key)).applyInArrow(lambda key, a, b: at_home(key, a, b), FOUND), "home")]
    for turn in range(turns):
        met = partner(F.col("seat"), F.col("seats"), turn)
        playing = F.lit(turn) < F.col("seats") - 1
        hosts = staying.filter(playing & (met > F.col("seat")))
        guests = residents.filter(playing & (met < F.col("seat"))).withColumn("seat", met)
        found.append(C.saved(hosts.groupBy(*key).cogroup(guests.groupBy(*key)).applyInArrow(lambda key, a, b: meeting(key, a, b), FOUND), f"turn{turn}"))
    staying.unpersist()

    of_all = found[0]
    for one in found[1:]:
        of_all = of_all.unionByName(one)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair = of_all.filter(F.col("item").isNotNull()).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", rank)
    named = found[0].filter(F.col("item").isNull()).drop("item").join(terms.select("lang", "slice", "at", F.col("term").alias("item")), ["lang", "slice", "at"])
    term = named.select("lang", "source", "item", "value").withColumn("rank", rank).filter(F.col("rank") <= min(top, TOP))
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return shown(pair, "pair").unionByName(shown(term, "term"))


#: The same by joins of all groups with all terms and with each other.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS terms, CAST(sum(total) AS HUGEINT) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * v.terms) AS p,
        1 + (1000000000::HUGEINT * (k.total + 5)) // (v.n + 5 * v.terms) AS q
      FROM s JOIN kept k ON s.lang = k.lang JOIN v ON s.lang = v.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
f AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM f QUALIFY part = 'pair' OR rank <= 50
"""
