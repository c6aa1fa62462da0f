"""Text operators as Column expressions.

Lengths and cuts count UTF-8 bytes.  A cut that would split a character moves to its start.  White space
is Unicode's.  Null in, null out, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0B\u0085\p{Z}]"
#: The characters of SPACE.
BLANKS = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
FENCE = "```"

#: What counts as an empty answer, placeholders, and how answers without content begin.
EMPTY = ["none", "none.", "n/a", "empty", "(none)", "(empty)", "(empty response)"]
PLACEHOLDERS = ["(empty)", "(empty response)", "(none)", "n/a", "none", "empty"]
IRRELEVANT_STARTS = [
    "i don't see", "i couldn't find", "i do not see", "i did not find", "no observations", "no candidate observations",
    "no distinctive", "there are no", "there were no", "none of the", "nothing distinctive", "nothing notable",
    "the conversation", "this conversation", "after review", "after filtering", "understood", "empty response", "ready to",
    "please share", "could you share", "i notice", "it looks like", "i'm ready", "i need", "[some ", "[another ", "[an extracted",
]
LEAST_OBSERVATION_BYTES = 20
LONGEST_ASSISTANT_BYTES = 500


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_space(x) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col(x), f"^{SPACE}+|{SPACE}+$", "")


def fingerprint(*parts) -> Column:
    """SHA-256 (hex) of the parts joined by a NUL; null parts count as empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


def token_estimate(x) -> Column:
    """Bytes * 2 div 9."""
    return F.floor(F.octet_length(col(x)) * 2 / 9).cast("long")


def bound(x: Column, use) -> Column:
    """use(x) with x computed once, however often it is used."""
    return F.transform(F.array(x), use)[0]


def byte_cut(x, limit: int, mark: str = "...") -> Column:
    """The text, or its longest start of whole characters in `limit` bytes and the mark."""
    whole = F.struct(F.lit(0).alias("lo"), F.lit(limit).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(max(1, limit.bit_length())))

    def cut(t: Column) -> Column:
        longest = bound(F.left(t, F.lit(limit)), lambda start: F.left(start, F.aggregate(steps, whole, lambda s, _: _halve(s, start, limit), lambda s: s["lo"])))
        return F.when(F.octet_length(t) <= limit, t).otherwise(F.concat(longest, F.lit(mark)))

    return bound(col(x), cut)


def _halve(s: Column, start: Column, limit: int) -> Column:
    mid = F.ceil((s["lo"] + s["hi"]) / 2).cast("int")
    fits = F.octet_length(F.left(start, mid)) <= limit
    return F.struct(F.when(fits, mid).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(F.greatest(mid - 1, s["lo"])).alias("hi"))


def strip_code_blocks(x) -> Column:
    """Fenced blocks become one line "[code block]"; an open one takes the rest.  Every kept line ends in a line feed."""
    # cut at the fence lines, every other part is inside; a part begins with the line feed before its first line
    parts = F.split(F.concat(F.lit("\n"), col(x)), rf"\n(?:(?!\n){SPACE})*+{FENCE}[^\n]*+", -1)
    shown = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise("\n[code block]")), "")
    return bound(shown, lambda s: F.when(s == "", "").otherwise(F.concat(F.substring(s, F.lit(2), F.length(s)), F.lit("\n"))))


def compress_assistant(x, limit: int = LONGEST_ASSISTANT_BYTES) -> Column:
    """Without code blocks, trimmed, cut at `limit` bytes."""
    return byte_cut(trim_space(strip_code_blocks(x)), limit)


def turn_line(assistant, human, human_source) -> Column:
    """One turn of a conversation as the model reads it; the other side is a peer in human sources."""
    a, h = col(assistant), col(human)
    who = F.when(col(human_source), F.lit("[peer]: ")).otherwise(F.lit("[assistant]: "))
    owner = F.concat(F.lit("[owner]: "), h, F.lit("\n\n"))
    return F.when(a != "", F.concat(who, a, F.lit("\n"), owner)).otherwise(owner)


def strip_list_prefix(x) -> Column:
    """Without one bullet ("- ", "* ", "• ") or one number and dot, and trimmed if there was one."""
    x = col(x)
    bullet, number = r"^(?:- |• |\* )", r"^[0-9]+\."
    return F.when(x.rlike(bullet), trim_space(F.regexp_replace(x, bullet, ""))).when(x.rlike(number), trim_space(F.regexp_replace(x, number, ""))).otherwise(x)


def strip_code_fence(x) -> Column:
    """Trimmed; a leading fence line goes, and with it a fence at the end.  A fence without a line feed stays."""
    t = trim_space(x)
    body = F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise(t)
    return F.when(F.startswith(t, F.lit(FENCE)), trim_space(F.regexp_replace(trim_space(body), f"{FENCE}$", ""))).otherwise(t)


def unfenced(text: str) -> str:
    """strip_code_fence() of one text."""
    t = text.strip(BLANKS)
    if not t.startswith(FENCE):
        return t
    return t.partition("\n")[2].strip(BLANKS).removesuffix(FENCE).strip(BLANKS) if "\n" in t else t.removesuffix(FENCE).strip(BLANKS)


def is_empty(x) -> Column:
    """Blank, or one of EMPTY; null is empty."""
    t = trim_space(F.coalesce(col(x), F.lit("")))
    return (t == "") | F.lower(t).isin(EMPTY)


def is_relevant(x) -> Column:
    """A statement, not an empty answer, a placeholder or talk about finding nothing; null is not."""
    t = trim_space(F.coalesce(col(x), F.lit("")))
    low = trim_space(F.regexp_replace(F.lower(t), r"^\(+", ""))
    starts = "^(?:" + "|".join(s.replace("[", r"\[") for s in IRRELEVANT_STARTS) + ")"
    bracketed = F.startswith(t, F.lit("[")) & F.endswith(t, F.lit("]"))
    return (F.octet_length(t) >= LEAST_OBSERVATION_BYTES) & ~low.isin(PLACEHOLDERS) & ~low.rlike(starts) & ~bracketed


def observation_format(date, quote, text) -> Column:
    """[date], Quote and Observation lines; null or empty date and quote have none."""
    d, q = col(date), col(quote)
    return F.concat_ws("\n", F.when(F.coalesce(d, F.lit("")) != "", F.concat(F.lit("["), d, F.lit("]"))), F.when(F.coalesce(q, F.lit("")) != "", F.concat(F.lit('Quote: "'), q, F.lit('"'))), F.concat(F.lit("Observation: "), col(text)))


def normal_label(x) -> Column:
    """Trimmed, lower case, without quotes around."""
    return F.regexp_replace(F.lower(trim_space(x)), "^[\"']+|[\"']+$", "")


def format_bytes(x) -> Column:
    """B, KB or MB, one decimal."""
    n = col(x)
    return F.when(n >= 1048576, F.format_string("%.1fMB", F.bround(n / 1048576, 1))).when(n >= 1024, F.format_string("%.1fKB", F.bround(n / 1024, 1))).otherwise(F.format_string("%dB", n.cast("long")))


def format_tokens(x) -> Column:
    """A dash for none, whole thousands with a k from 1000."""
    n = col(x).cast("long")
    return F.when(n == 0, "—").when(n >= 1000, F.format_string("%dk", F.floor(n / 1000))).otherwise(n.cast("string"))


def format_duration(millis) -> Column:
    """Milliseconds below a second, else seconds with one decimal."""
    n = col(millis).cast("long")
    return F.when(n < 1000, F.format_string("%dms", n)).otherwise(F.format_string("%.1fs", n / 1000))


def word_wrap(x, width: int, indent: str = "") -> Column:
    """Words in lines of at most `width` bytes, the indent counted; a longer word has a line of its own."""
    words = F.filter(F.split(col(x), f"{SPACE}+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def add(acc: Column, w: Column) -> Column:
        full = F.octet_length(acc["line"]) + 1 + F.octet_length(w) > width
        fresh = F.concat(F.lit(indent), w)
        return (
            F.when(acc["line"] == "", F.struct(acc["done"].alias("done"), fresh.alias("line")))
            .when(full, F.struct(F.concat(acc["done"], acc["line"], F.lit("\n")).alias("done"), fresh.alias("line")))
            .otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["line"], F.lit(" "), w).alias("line")))
        )

    return F.aggregate(words, start, add, lambda acc: F.concat(acc["done"], acc["line"]))


#: The character references of forms, in the order they are replaced; names, hosts and paths have bounds, so that the work is in proportion to the text.
REFERENCES = [("&amp;", "&"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&apos;", "'")]


def html_unescape(x) -> Column:
    out = col(x)
    for name, mark in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(mark))
    return out


def throttled(status, message, remaining=None) -> Column:
    """Whether an answer says to slow down: 429, 403 with no calls remaining, or a message that names a rate limit."""
    left = F.coalesce(col(remaining), F.lit("")) if remaining is not None else F.lit("1")
    said = F.coalesce(col(message), F.lit("")).rlike("429|rate_limit|ThrottlingException|Too many tokens")
    return F.coalesce((col(status) == 429) | ((col(status) == 403) & left.isin("", "0")), F.lit(False)) | said


def retry_after(header, reset, now) -> Column:
    """Seconds to wait: what the header says if it is a number, else until the reset time (both in seconds), else 0."""
    return F.coalesce(col(header).try_cast("long"), F.greatest(col(reset).try_cast("long") - col(now), F.lit(0)), F.lit(0))


def effort(budget) -> Column:
    """high from 12000, medium from 4000, else low."""
    b = col(budget)
    return F.when(b >= 12000, "high").when(b >= 4000, "medium").otherwise("low")


def backoff_seconds(attempt, base: float = 2.0, most: float = 60.0) -> Column:
    """The wait before jitter: base * 2 ** attempt, `most` at most."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), col(attempt)), F.lit(most))


def short_model(x) -> Column:
    """The last dotted part if there are more than two."""
    parts = F.split(col(x), r"\.")
    return F.when(F.size(parts) > 2, F.element_at(parts, -1)).otherwise(col(x))


def repo_of(url) -> Column:
    """owner and repo, the last two parts of a repository URL."""
    parts = F.split(F.regexp_replace(col(url), "/+$", ""), "/")
    return F.struct(F.get(parts, F.size(parts) - 2).alias("owner"), F.get(parts, F.size(parts) - 1).alias("repo"))


def chat_time(ts) -> Column:
    """A chat's "seconds.micros" as a timestamp; micros that are no number count 0, seconds that are none give null."""
    secs = F.split_part(col(ts), F.lit("."), F.lit(1)).try_cast("long")
    micros = F.coalesce(F.split_part(col(ts), F.lit("."), F.lit(2)).try_cast("long"), F.lit(0))
    return F.timestamp_micros(secs * 1000000 + micros)


#: Personal data and secrets by pattern and what stands for them, in the order they are replaced; names, hosts and paths have bounds, so that the work is in proportion to the text.
SCRUBS = [
    (r"AKIA[0-9A-Z]{16}", "[AWS_KEY]"),
    (r"(?i)(secret[\w ]{0,20}[=:]\s*\"?)[A-Za-z0-9/+=]{40}", "$1[AWS_SECRET]"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[TOKEN]"),
    (r"\b(?:ghp|gho|ghs|github_pat)_[A-Za-z0-9_]{20,}", "[TOKEN]"),
    (r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,63}", "[EMAIL]"),
    (r"https?://\S+[?&](?:token|key|sig|auth|access_token)=\S+", "[URL]"),
    (r"\b(PASSWORD|TOKEN)=\S+", "$1=[REDACTED_ENV]"),
    (r"\b\d{12}\b", "[ACCOUNT_ID]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
    (r"(?:/[\w.-]+){2,64}/([\w.-]+)", "$1"),
]


#: What a text must hold for the pattern to match; looked for first, as it takes far less time.
NEEDLES = ["AKIA", None, "eyJ", "_", "@", "://", "=", None, ".", "/"]


def _scrubbed(x: Column, pattern: str, mark: str, needle: str | None) -> Column:
    if needle is None:
        return F.regexp_replace(x, pattern, mark)
    return bound(x, lambda t: F.when(F.contains(t, F.lit(needle)), F.regexp_replace(t, pattern, mark)).otherwise(t))


def scrub(x) -> Column:
    """Texts without the patterns of SCRUBS."""
    out = col(x)
    for (pattern, mark), needle in zip(SCRUBS, NEEDLES):
        out = _scrubbed(out, pattern, mark, needle)
    return out


def form_action(x) -> Column:
    """Where a page's first form is sent; null without one."""
    return html_unescape(F.nullif(F.regexp_extract(col(x), r'(?is)<form\b[^>]*?\baction="([^"]*)"', 1), F.lit("")))


def form_fields(x) -> Column:
    """A map of the names and values of a page's input elements, the last of a name; without a value: empty."""
    inputs = F.regexp_extract_all(col(x), F.lit(r"(?is)<input\b[^>]*>"), F.lit(0))
    one = lambda i, name: F.regexp_extract(i, rf'(?is)\b{name}="([^"]*)"', 1)
    named = F.filter(F.transform(inputs, lambda i: F.struct(one(i, "name").alias("key"), html_unescape(one(i, "value")).alias("value"))), lambda f: f["key"] != "")
    last = F.filter(named, lambda f, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda g: g["key"] == f["key"]))
    return F.map_from_entries(last)


def resolved_url(base, ref) -> Column:
    """A reference seen from a base: whole URLs as they are, others by scheme, root or folder; dot segments are not looked at."""
    b, r = col(base), col(ref)
    origin = F.regexp_extract(b, r"^(https?://[^/?#]*)", 1)
    path = F.regexp_extract(b, r"^https?://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(r.rlike("^https?://"), r).when(F.startswith(r, F.lit("//")), F.concat(F.regexp_extract(b, "^(https?:)", 1), r))
        .when(F.startswith(r, F.lit("/")), F.concat(origin, r)).when(r.rlike("^[?]"), F.concat(origin, path, r)).when(r == "", F.regexp_replace(b, "#.*$", "")).otherwise(F.concat(origin, folder, r))
    )


def short_url(x) -> Column:
    """At most 80 bytes, and three dots if it was longer."""
    return byte_cut(x, 80)
