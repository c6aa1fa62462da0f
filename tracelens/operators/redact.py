"""What scrub()'s patterns can't tell: a user's own terms, random-looking tokens, and IPv6 addresses.

Terms are looked for all at once by one automaton, which a broadcast takes to the tasks; their number and bytes are bounded.
Tokens and addresses are found by expressions.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound, col, scrub

TERM, TOKEN, IP = "[TERM]", "[TOKEN]", "[IP]"
#: Terms at most, and bytes of them together: the automaton takes some hundred times the bytes.
MOST_TERMS, MOST_BYTES = 200_000, 4 << 20
#: Characters of a token at least, and bits a character of one that counts as random.
TOKEN_CHARS, RANDOM_BITS = 20, 3.8
TOKEN_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{%d,}+={0,2}" % TOKEN_CHARS
#: Eight groups, or fewer around one double colon; a digit is needed, as names in code are joined by double colons too.
IPV6 = (
    r"(?i)(?<![\w:.])(?=[a-f:]*+[0-9])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}"
    r"|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?)(?![\w:])"
)


def entropy(x) -> Column:
    """Bits a character: the entropy of a text's own character counts; an empty one: 0."""

    def of_counts(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
        return F.coalesce(-F.aggregate(each, F.lit(0.0), lambda s, p: s + p * F.log2(p)), F.lit(0.0))

    return F.when(F.length(col(x)) > 0, bound(F.split(col(x), ""), of_counts)).otherwise(F.lit(0.0))


def without_random_tokens(x, bits: float = RANDOM_BITS) -> Column:
    """The text with TOKEN in place of runs of TOKEN_CHARS and more token characters, letters and digits among them, whose entropy is at least `bits`."""

    def masked(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(TOKEN_RUN), F.lit(0)), lambda m: F.when(entropy(m) >= bits, F.lit(TOKEN)).otherwise(m))
        return F.array_join(F.zip_with(F.split(t, TOKEN_RUN, -1), found, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    return bound(col(x), lambda t: F.when(t.rlike(TOKEN_RUN), masked(t)).otherwise(t))


def without_ipv6(x) -> Column:
    return bound(col(x), lambda t: F.when(F.contains(t, F.lit("::")) | t.rlike("(?i)[0-9a-f]:[0-9a-f]{1,4}:"), F.regexp_replace(t, IPV6, IP)).otherwise(t))


def lowered(text: str) -> str:
    """The text in lower case, as long as it was: characters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(terms: list[str]):
    """An automaton of terms in lower case; blank ones are left out, and none at all gives None."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for t in terms:
        if t and t.strip():
            out.add_word(lowered(t.strip()), len(t.strip()))
    if not len(out):
        return None
    out.make_automaton()
    return out


def spans(text: str, found) -> list[tuple[int, int]]:
    """Where terms stand as whole words, from the left, the longest of each place, without overlaps."""
    wordy = lambda c: c.isalnum() or c == "_"
    longest: dict[int, int] = {}
    for stop, size in found.iter(lowered(text)):
        start = stop + 1 - size
        if (start == 0 or not (wordy(text[start - 1]) and wordy(text[start]))) and (stop + 1 == len(text) or not (wordy(text[stop]) and wordy(text[stop + 1]))):
            longest[start] = max(longest.get(start, 0), stop + 1)
    out, at = [], 0
    for start in sorted(longest):
        if start >= at:
            at = longest[start]
            out.append((start, at))
    return out


def without_terms(rows: DataFrame, terms: DataFrame, text: str = "text", mark: str = TERM) -> DataFrame:
    """rows with `mark` in place of each of terms(term), as whole words in any case, and `n_terms`, how many there were.

    More than MOST_TERMS terms, or MOST_BYTES of them, are an error.  Null texts stay null.
    """
    known = terms.select(F.col("term").cast("string").alias("term")).filter("trim(term) <> ''").distinct()
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if n > MOST_TERMS or size > MOST_BYTES:
        raise ValueError(f"{n} terms of {size} bytes are more than one automaton takes")
    made = automaton([r["term"] for r in known.collect()])
    if made is None:
        return rows.withColumn("n_terms", F.lit(0).cast("long"))
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(made))
    at = rows.columns.index(text)

    def run(parts):
        found = pickle.loads(shared.value)
        for part in parts:
            out, count = [], []
            for t in part.column(at).to_pylist():
                own = spans(t, found) if t else []
                pieces, last = [], 0
                for start, stop in own:
                    pieces += [t[last:start], mark]
                    last = stop
                out.append("".join([*pieces, t[last:]]) if own else t)
                count.append(len(own))
            columns = [pa.array(out, pa.string()) if i == at else part.column(i) for i in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64())], names=[*part.schema.names, "n_terms"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("n_terms", T.LongType())]))


def redacted(rows: DataFrame, terms: DataFrame | None = None, text: str = "text") -> DataFrame:
    """rows with texts without scrub()'s patterns, IPv6 addresses, random-looking tokens and, if given, a user's terms."""
    out = rows.withColumn(text, without_random_tokens(without_ipv6(scrub(text))))
    return without_terms(out, terms, text).drop("n_terms") if terms is not None else out
