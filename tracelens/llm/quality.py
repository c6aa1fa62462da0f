"""Quality rules: a table of thresholds, compiled into one projection.

Counts of a text (words, code points, symbols, stop words, letters, lines) are columns; a rule bounds one count, or the ratio of two,
from below, above or both.  compiled() turns the table of rules into the array of the names that a text fails; there are no user functions.
Bounds are whole thousandths and ratios are compared by multiplication, so verdicts are exact.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secrets import bound


class Rule(NamedTuple):
    """least <= 1000 * top / under <= most; without `under` top alone is bounded, and where `under` is zero the rule holds."""

    name: str
    top: str
    under: str | None = None
    least: int | None = None
    most: int | None = None


#: Words end at these characters: the blank, tab, line feed, vertical tab, form feed and carriage return.
BLANKS, BLANK_RUN, SYMBOLS = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+", "#*$%&|<>"
BULLETS = ["-", "*", "•", "‣"]
#: ASCII letters, and what is not ASCII, count as letters.
LETTERS = r"[a-zA-Z\x{80}-\x{10FFFF}]+"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and a in that have it for not on with as you at is are was this by from or "
    "le la les un une des de du et en que qui est dans pour pas sur avec par il elle au plus "
    "der die das und ist den von zu mit sich des auf für im dem nicht ein eine als auch es "
    "el los las y por con no una su para al lo como más o se del"
).split()
#: Base rules, which alone make a row fail as `base_failed`.
BASE = (Rule("few_words", "n_words", None, 50 * 1000), Rule("repeated_words", "n_repeat_words", "n_words", None, 500))
#: The threshold table of the verdict.
THRESHOLDS = (
    Rule("many_words", "n_words", None, None, 100_000 * 1000),
    Rule("word_length", "word_chars", "n_words", 2000, 12_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("few_stop_words", "n_stop_words", None, 2 * 1000),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 10),
    Rule("letters", "n_letters", "word_chars", 500),
    Rule("equal_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 300),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_letters", "n_lines", "n_bullet_lines", "n_cut_lines")


def holds(rule: Rule, count=F.col) -> Column:
    """Whether a row of COUNTS keeps the rule."""
    top, under = 1000 * count(rule.top), count(rule.under) if rule.under else F.lit(1)
    bounds = [F.lit(b) * under <= top for b in (rule.least,) if b is not None] + [top <= F.lit(b) * under for b in (rule.most,) if b is not None]
    both = bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1]
    return both | (under == 0) if rule.under else both


def compiled(rules: tuple[Rule, ...] = THRESHOLDS, count=F.col) -> Column:
    """The names of the rules that a row of COUNTS fails, in the order of the table."""
    return F.filter(F.array(*[F.when(~holds(r, count), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def words_of(text: Column) -> Column:
    """The words of a text, none of a blank one."""
    return bound(F.btrim(text, F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN, -1)))


def repeat_words(words: Column) -> Column:
    """How many of the words stand in a window of three that is found twice or more; windows are told apart by 64-bit hashes.

    Where two hashes are equal, whole numbers of the upper bits of a hash and its place are sorted; only windows whose upper bits
    another one shares are then sorted by the whole hash, with their places, so that equal ones are neighbours.
    """
    windows = F.transform(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - 2)), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    left = lambda x, n: F.call_function("shiftleft", x, n)
    right = lambda x, n: F.call_function("shiftrightunsigned", x, n)

    def among(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))

    def sharing(hashes: Column, bits: Column) -> Column:
        packed = F.sort_array(F.transform(hashes, lambda h, i: left(right(h, bits), bits).bitwiseOR(i.cast("long"))))
        alike = lambda p: F.filter(p, lambda x, i: (right(x, bits) == right(F.get(p, i - 1), bits)) | (right(x, bits) == right(F.get(p, i + 1), bits)))
        place = lambda x: (x - left(right(x, bits), bits)).cast("int")
        return F.transform(bound(packed, alike), lambda x: bound(place(x), lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("at"))))

    def counted(hashes: Column) -> Column:
        bits = F.length(F.bin(F.size(hashes).cast("long")))
        repeated = bound(bits, lambda b: bound(F.sort_array(sharing(hashes, b)), among))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(repeated)

    return bound(windows, counted)


def counts_of(text: Column) -> Column:
    """A struct of COUNTS as longs; null texts count as empty."""

    def from_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: F.left(F.ltrim(x), F.lit(1)).isin(BULLETS))).alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: bound(F.rtrim(x), lambda y: y.endswith("...") | y.endswith("…")))).alias("n_cut_lines"),
        )

    def from_words(words: Column) -> Column:
        stop = F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
        return F.struct(F.size(words).alias("n_words"), stop.alias("n_stop_words"), repeat_words(words).alias("n_repeat_words"), F.array_join(words, "").alias("joined"))

    def from_joined(w: Column) -> Column:
        other = F.regexp_replace(w["joined"], LETTERS, "")
        return bound(other, lambda o: F.struct(
            F.length(w["joined"]).alias("word_chars"), (F.length(w["joined"]) - F.length(o)).alias("n_letters"), (F.length(o) - F.length(F.translate(o, SYMBOLS, ""))).alias("n_symbols"),
            *[w[c].alias(c) for c in ("n_words", "n_stop_words", "n_repeat_words")],
        ))

    def all_of(t: Column) -> Column:
        lines = bound(F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), from_lines)
        told = F.struct(bound(bound(words_of(t), from_words), from_joined).alias("w"), lines.alias("l"))
        return bound(told, lambda z: F.struct(*[z["l" if "lines" in c else "w"][c].cast("long").alias(c) for c in COUNTS]))

    return bound(F.coalesce(text.cast("string"), F.lit("")), all_of)


def quality(docs: DataFrame, text: str = "text", id_column: str = "doc_id", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and failed (names of the rules that the row fails, base rules first): a row for each of docs.

    Null and blank texts have no words, so they fail by `few_words`.  Repeated rows are judged each; other columns of docs are
    not looked at, whatever their names.  An empty table gives an empty result.
    """
    counted = docs.select(F.col(f"`{id_column}`").alias("doc_id"), counts_of(F.col(f"`{text}`")).alias("c"))
    told = counted.select("doc_id", "c.*").withColumns({"__base": compiled(base), "__failed": compiled(rules)})
    base_failed = F.size("__base") > 0
    return told.select("doc_id", *COUNTS, base_failed.alias("base_failed"), (~base_failed & (F.size("__failed") == 0)).alias("kept"), F.concat("__base", "__failed").alias("failed"))


def sql() -> str:
    """The verdict and all counts in DuckDB's SQL; the rules come from the same table, the counts are made another way."""

    def failed(r: Rule) -> str:
        under = r.under or "1"
        broken = [f"1000 * {r.top} < {r.least} * {under}"] * (r.least is not None) + [f"1000 * {r.top} > {r.most} * {under}"] * (r.most is not None)
        return f"CASE WHEN {under} <> 0 AND ({' OR '.join(broken)}) THEN '{r.name}' END"

    names = lambda rules: f"list_filter([{', '.join(map(failed, rules))}], lambda x: x IS NOT NULL)"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
v AS (SELECT k, unnest(range(len(w) - 2)) AS i, w FROM s WHERE len(w) > 2),
x AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i + 1], w[i + 2], w[i + 3]) AS n FROM v),
r AS (SELECT k, count(DISTINCT place) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS place FROM x WHERE n > 1) GROUP BY k),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum(list_concat([0], list_transform(w, lambda x: length(x)))) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
        CAST(length(regexp_replace(t, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+', '', 'g')) AS BIGINT) AS n_letters, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•‣]'))) AS BIGINT) AS n_bullet_lines,
        CAST(len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…) *$'))) AS BIGINT) AS n_cut_lines
      FROM s LEFT JOIN r USING (k)),
f AS (SELECT *, {names(BASE)} AS b, {names(THRESHOLDS)} AS o FROM c)
SELECT doc_id, {', '.join(COUNTS)}, len(b) > 0 AS base_failed, len(b) = 0 AND len(o) = 0 AS kept, list_concat(b, o) AS failed FROM f
"""
