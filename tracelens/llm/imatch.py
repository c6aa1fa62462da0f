"""I-Match fingerprints: the terms of a chosen inverse-document-frequency band, hashed over randomised lexicons.

Terms are lower-cased runs of letters and digits, known by a 64-bit hash.  The document frequency of every term is
counted over all documents; a term is in the lexicon if RARE <= df / N <= COMMON, that is ln(1 / COMMON) <= idf <=
ln(1 / RARE).  The lexicon has at most 1 / RARE times as many terms as a document has on average, at every corpus size, so
it is held as a bitmap of 2 ** SLOT_BITS slots of which few are taken; a term outside it is let in where it shares a
slot, the part of the slots that are taken at most (100,000 terms: 1.2 %).  A
document keeps its distinct terms in the lexicon (all its terms, if fewer than FEW are), sorts them, and
hashes those of the whole lexicon and of each of its random subsets.  The subsets are drawn by the terms' own
hash: 64 fine ones share the lexicon out, the coarse ones are unions of them, and nested ones are parts of them, so
a text of a dozen terms and one of thousands both have subsets of one or two of their terms, which survive when half
of the text is changed.  The likeness of two fingerprints is the part of equal hashes among those that are not empty
in both.  Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

SLOT_BITS, RARE, COMMON, FEW = 23, 0.002, 0.2, 4
#: Bits of a term's hash that say which fine subset it is in; how many fine subsets a coarse one unites; and the bits
#: that are zero in each nested subset: rates of 1/64, 1/16 and 1/4, and 1/256 and 1/1024, of the lexicon.
FINE, UNITED, NESTED = 6, (4, 16), (2, 2)
#: Rows of a range of the order, and ranges at most.
ROWS_EACH, RANGES = 1000, 1 << 15


def words(text: Column) -> Column:
    """The terms of a text in order, repeats too; null: none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def slot(term: Column) -> Column:
    return F.pmod(term, F.lit(1 << SLOT_BITS))


def lexicon(docs: DataFrame, text: str = "text", rare: float = RARE, common: float = COMMON) -> DataFrame:
    """One row, `lexicon`: a byte for each slot, '1' where a term of the band is."""
    n = docs.count()
    each = docs.select(F.explode(F.array_distinct(F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))).alias("term"))
    kept = each.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df").between(rare * n, common * n)).select(slot(F.col("term")).alias("slot"))
    block = 12
    filled = kept.groupBy(F.shiftright("slot", block).alias("block")).agg(F.sort_array(F.collect_set(F.col("slot").bitwiseAND((1 << block) - 1).cast("int"))).alias("in"))
    add = lambda s, at: F.struct(F.concat(s["row"], F.repeat(F.lit("0"), at - s["at"] - 1), F.lit("1")).alias("row"), at.alias("at"))
    drawn = F.aggregate("in", F.struct(F.lit("").alias("row"), F.lit(-1).alias("at")), add, lambda s: F.concat(s["row"], F.repeat(F.lit("0"), F.lit((1 << block) - 1) - s["at"])))
    every = docs.sparkSession.range(0, 1 << (SLOT_BITS - block), 1, 1).withColumnRenamed("id", "b")
    rows = every.join(filled.select("block", drawn.alias("row")), F.col("b") == F.col("block"), "left")
    rows = rows.select(F.struct("b", F.coalesce("row", F.lit("0" * (1 << block))).alias("row")).alias("r"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]), "")
    return rows.agg(whole.cast("binary").alias("lexicon"))


def kept_terms(texts: list[Column], bitmap: Column) -> Column:
    """For each text the hashes of its distinct terms in the lexicon, sorted; of all its terms if fewer than FEW are."""
    lists = F.array(*[words(t) for t in texts])
    hashed = lambda ws: F.array_distinct(F.transform(ws, lambda w: F.xxhash64(w)))

    def keep(ws: Column) -> Column:
        inside = hashed(F.filter(ws, lambda w: F.substring(bitmap, (slot(F.xxhash64(w)) + 1).cast("int"), 1) == F.lit(b"1")))
        return F.transform(F.array(inside), lambda k: F.sort_array(F.when(F.size(k) < FEW, hashed(ws)).otherwise(k)))[0]

    return F.transform(lists, keep)


#: Hex digits of a hash, of a fine or nested part's, and what stands for a part without terms (no part's hash).
WHOLE, DIGITS, NONE = 16, 8, "--------"


def _digest(hashed: Column, digits: int = WHOLE) -> Column:
    return F.lpad(F.hex(hashed if digits == 16 else hashed.bitwiseAND((1 << 4 * digits) - 1)), digits, "0")


def _parts(terms: Column) -> Column:
    """The hash of each of the 2 ** FINE parts of sorted terms, a dot after each.

    A part's terms have the same first bits, so they follow each other and one pass closes part after part.
    """
    n = 1 << FINE
    none = NONE + "."
    part = lambda t: (F.call_function("shiftright", t, F.lit(64 - FINE)) + (n >> 1)).cast("int")
    closed = lambda s: F.when(s["at"] >= 0, F.concat(s["done"], _digest(s["h"], DIGITS), F.lit("."))).otherwise(s["done"])
    start = F.struct(F.lit("").alias("done"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("h"))

    def add(s: Column, t: Column) -> Column:
        return F.when(part(t) == s["at"], F.struct(s["done"].alias("done"), s["at"].alias("at"), F.xxhash64(s["h"], t).alias("h"))).otherwise(
            F.struct(F.concat(closed(s), F.repeat(F.lit(none), part(t) - s["at"] - 1)).alias("done"), part(t).alias("at"), F.xxhash64(t).alias("h"))
        )

    return F.aggregate(terms, start, add, lambda s: F.concat(closed(s), F.repeat(F.lit(none), F.lit(n - 1) - s["at"])))


def _united(fine: Column, each: int) -> Column:
    """The hashes of unions of `each` successive fine parts, from the parts' own hashes; a dot after each."""
    width = each * (DIGITS + 1)
    starts = F.sequence(F.lit(1), F.lit((1 << FINE) * (DIGITS + 1)), F.lit(width))

    def hashed(at: Column) -> Column:
        own = F.substring(fine, at, F.lit(width))
        return F.when(own == (NONE + ".") * each, NONE).otherwise(_digest(F.xxhash64(own)))

    return F.concat(F.array_join(F.transform(starts, hashed), "."), F.lit("."))


def fingerprint(kept: Column) -> Column:
    """Hashes of the kept terms, and of their parts in each random subset of the lexicon, with dots between; NONE for empty parts."""

    def nested(terms: Column, used: int, rates: tuple) -> list[Column]:
        if not rates:
            return []
        inner = F.filter(terms, lambda t: F.call_function("shiftright", t, F.lit(64 - used - rates[0])).bitwiseAND((1 << rates[0]) - 1) == 0)
        return [F.transform(F.array(inner), lambda p: F.concat(_parts(p), *nested(p, used + rates[0], rates[1:])))[0]]

    def whole(fine: Column) -> Column:
        return F.concat(F.when(F.size(kept) == 0, NONE).otherwise(_digest(F.xxhash64(kept))), F.lit("."), *[_united(fine, n) for n in UNITED], fine)

    first = F.transform(F.array(_parts(kept)), whole)[0]
    return F.rtrim(F.concat(first, *nested(kept, FINE, NESTED)), F.lit("."))


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes of two fingerprints by hashes that are not empty in both; two without any: 1."""
    one = 1 << 32  # equal ones are counted above this bit, all below
    score = lambda p, q: F.when(p != q, F.lit(1).cast("long")).when(p == NONE, F.lit(0).cast("long")).otherwise(F.lit(one + 1))
    sums = F.aggregate(F.zip_with(F.split(a, "\\.", -1), F.split(b, "\\.", -1), score), F.lit(0).cast("long"), lambda s, v: s + v)
    return F.transform(F.array(sums), lambda s: F.when(s == 0, F.lit(1.0)).otherwise(F.shiftright(s, 32) / s.bitwiseAND(one - 1)))[0]


def _with_kept(df: DataFrame, texts: list[Column], bitmap: DataFrame) -> DataFrame:
    """Adds __kept: for each text its kept terms.

    The bitmap is a scalar subquery that is used once, so the optimizer moves it into the lambda, where it
    is one array for all rows; as a column of its own it would be copied for each term.
    """
    return df.withColumn("__lexicon", bitmap.scalar()).withColumn("__kept", kept_terms(texts, F.col("__lexicon"))).drop("__lexicon")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `fingerprint` to docs: equal texts have equal ones; null and empty texts have an empty one."""
    own = _with_kept(docs, [F.col(text)], lexicon(docs, text))
    return own.withColumn("fingerprint", fingerprint(F.col("__kept")[0])).drop("__kept")


def edited_and_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs(doc_id, text).

    A text (null: empty) is edited by putting the start of the next document's, by ascending doc_id (after
    the last: the first), in place of its last half, rounded down.  Null ids come first; rows with equal
    ids follow each other by text.  The order is made by ranges of ids that each know the
    next one's first row, so texts are shuffled once.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = C.quantile_bounds(own.select("key"), "key", ROWS_EACH, most=RANGES)
    firsts = own.groupBy(C.bucket_of(F.col("key"), bounds).alias("part")).agg(F.min("key").alias("first")).select("first")
    firsts = sorted(r["first"] for r in firsts.collect())  # one a range, RANGES at most
    bitmap = lexicon(own)
    if not firsts:
        firsts = [0]
    part = C.bucket_of(F.col("key"), firsts)
    is_first = F.element_at(F.lit(firsts), F.greatest(part, F.lit(1)).cast("int")) == F.col("key")
    before = F.when(part <= 1, F.lit(len(firsts))).otherwise(part - 1)
    spread = own.withColumn("at", F.explode(F.when(is_first, F.array(F.struct(part.alias("part"), F.lit(False).alias("guest")), F.struct(before.alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(part.alias("part"), F.lit(False).alias("guest"))))))
    spread = spread.select("doc_id", "key", "text", F.col("at.part").alias("part"), F.col("at.guest").alias("guest"))
    order = W.partitionBy("part").orderBy("guest", "key", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    both = _with_kept(spread.withColumn("next", F.lead("text", 1, "").over(order)), [F.col("text"), edited], bitmap)
    both = both.select(
        "doc_id", "key", "text", "part", "guest", F.length("text").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
        fingerprint(F.col("__kept")[0]).alias("fingerprint"), fingerprint(F.col("__kept")[1]).alias("edited_fingerprint"),
    )
    last = both.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).filter("NOT guest")
    return last.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
