"""Parsers of model output as Column expressions: text in, an array of structs (or a map) out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, bound, col, strip_list_prefix, trim_space

OBSERVATION, QUOTE, THEME = "Observation: ", "Quote: ", "THEME: "


def _after(line: Column, prefix: str) -> Column:
    return F.substring(line, F.lit(len(prefix) + 1), F.length(line))


def last_of_each(pairs: Column) -> Column:
    """The map of key and value pairs, the last of each key, whatever the session does with keys that repeat."""
    sorted_pairs = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value"))))
    followed = lambda s, x, i: F.coalesce(x["key"] == F.get(s, i + 1)["key"], F.lit(False))
    last = lambda s: F.transform(F.filter(s, lambda x, i: ~followed(s, x, i)), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    return F.map_from_entries(bound(sorted_pairs, last))


def observations(x) -> Column:
    """array<struct<quote, observation>>: each observation line, with the quote line before it but for blank lines.

    Bullets and numbers before the prefixes go.  Any other line ends a pending quote.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), "\n"), lambda s: trim_space(strip_list_prefix(trim_space(s)))), lambda s: s != "")
    bare = lambda s: F.regexp_replace(F.regexp_replace(trim_space(s), '^"+|"+$', ""), "^[“”]+|[“”]+$", "")

    def item(own: Column, line: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(own, i - 1))
        quote = F.when(F.startswith(before, F.lit(QUOTE)), bare(_after(before, QUOTE)))
        text = trim_space(_after(line, OBSERVATION))
        return F.struct(F.when(quote != "", quote).alias("quote"), F.when(F.startswith(line, F.lit(OBSERVATION)) & (text != ""), text).alias("observation"))

    return F.filter(bound(lines, lambda own: F.transform(own, lambda line, i: item(own, line, i))), lambda o: o["observation"].isNotNull())


def numbered_labels(x, count) -> Column:
    """map<int, string>: of lines "N. label", N in 1..count, the last of each N."""
    lines = F.transform(F.split(F.coalesce(col(x), F.lit("")), "\n"), trim_space)
    pairs = F.transform(lines, lambda s: F.struct(
        F.regexp_extract(s, r"^([+-]?\d{1,9})", 1).try_cast("int").alias("key"),
        F.when(F.contains(s, F.lit(".")), trim_space(F.regexp_replace(s, r"^[^.]*\.", ""))).alias("value"),
    ))
    return last_of_each(F.filter(pairs, lambda p: p["key"].between(F.lit(1), col(count)) & (F.coalesce(p["value"], F.lit("")) != "")))


def themes(x) -> Column:
    """array<string>: what follows the theme prefix, if anything."""
    lines = F.transform(F.split(F.coalesce(col(x), F.lit("")), "\n"), trim_space)
    return F.filter(F.transform(F.filter(lines, lambda s: F.startswith(s, F.lit(THEME))), lambda s: trim_space(_after(s, THEME))), lambda s: s != "")


def theme_map(x) -> Column:
    """map<string, string>: "label -> theme" (or with →) by lower-cased label, the last of each."""
    edge = f"^(?:[\"']|{SPACE})+|(?:[\"']|{SPACE})+$"
    lines = F.transform(F.split(F.coalesce(col(x), F.lit("")), "\n"), lambda s: F.regexp_replace(trim_space(s), "^- ", ""))
    parts = F.transform(lines, lambda s: F.when(F.contains(s, F.lit("→")), F.split(s, "→", 2)).otherwise(F.split(s, "->", 2)))
    pairs = F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: F.struct(F.lower(F.regexp_replace(F.get(p, F.lit(0)), edge, "")).alias("key"), F.regexp_replace(F.get(p, F.lit(1)), edge, "").alias("value")))
    return last_of_each(F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != "")))


def scores(x, side: str) -> Column:
    """map<string, int> of name=digit on the last line of the side (A or B)."""
    lines = F.transform(F.split(F.coalesce(col(x), F.lit("")), "\n"), trim_space)
    line = F.coalesce(F.try_element_at(F.filter(lines, lambda s: F.startswith(s, F.lit(f"RESPONSE_{side}:"))), F.lit(-1)), F.lit(""))
    return last_of_each(F.zip_with(F.regexp_extract_all(line, F.lit(r"(\w+)=(\d)"), F.lit(1)), F.regexp_extract_all(line, F.lit(r"(\w+)=(\d)"), F.lit(2)), lambda k, v: F.struct(k.alias("key"), v.cast("int").alias("value"))))


def preference(x) -> Column:
    """struct<preferred, rationale>: A, B or neither, and why; the last lines count."""
    lines = F.transform(F.split(F.coalesce(col(x), F.lit("")), "\n"), trim_space)
    last = lambda p: F.try_element_at(F.filter(lines, lambda s: F.startswith(s, F.lit(p))), F.lit(-1))
    value = F.upper(trim_space(F.regexp_replace(last("PREFERRED:"), "^PREFERRED:", "")))
    who = F.when(F.startswith(value, F.lit("A")), "A").when(F.startswith(value, F.lit("B")), "B").otherwise("neither")
    return F.struct(who.alias("preferred"), F.coalesce(trim_space(F.regexp_replace(last("RATIONALE:"), "^RATIONALE:", "")), F.lit("")).alias("rationale"))


def json_array(x) -> Column:
    """The JSON array in a text: the whole, the first fenced block, or from the first [ to the last ]; else the text."""
    t = trim_space(x)
    fenced = trim_space(F.regexp_extract(t, r"(?s)```[^\n]*\n(.*?)```", 1))
    inner = F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    return F.when(F.startswith(t, F.lit("[")), t).when(F.startswith(fenced, F.lit("[")), fenced).when(inner != "", inner).otherwise(t)
