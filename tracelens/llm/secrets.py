"""Secret scans: candidates by one pattern, false positives removed by a random forest, all as SQL expressions.

A candidate is the value of an assignment to a secret-sounding name, a password in a URL, what follows Bearer or Basic, a block of
a private key, or a run of 16 and more token characters with a digit; names, keywords and quotes before the value are its lead and
are not scored.  The forest looks at length, character transitions, dictionary coverage, the path and the neighbouring words.  It is
grown on labelled findings (FINDINGS of them from labelled_findings(), which scans labelled texts as a scan does, or the caller's own) on the
driver and becomes one CASE expression a tree; scanning runs no Python.
"""

from __future__ import annotations

import random
import re
import string
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES, DEPTH, FINDINGS, SEED, CUTOFF = 15, 6, 6000, 5, 0.5
BEFORE, AFTER, MASK = 48, 24, "[SECRET]"
NAMES = r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
NAMED = NAMES + r"[A-Za-z0-9_-]{0,24}[\"']?\s{0,3}(?::=|=>|[:=])"
ASSIGNED = NAMED + r"\s{0,3}[\"']?(?:(?i:bearer|basic|token)\s{1,3})?"
IN_URL, BEARER = r"://[^\s:/@\"'<>]{0,64}:", r"(?<![A-Za-z])(?i:bearer|basic)\s{1,3}"
#: What stands before the value in a candidate.
LEAD = rf"^(?:{ASSIGNED}|{IN_URL}|{BEARER})(?=\S{{3}})"
CANDIDATE = "|".join([
    ASSIGNED + r"[^\s\"'<>&]{5,}[^\s\"'<>&;,.)\]}]", IN_URL + r"[^\s/@\"'<>]{3,128}(?=@)", BEARER + r"[A-Za-z0-9_.~+/-]{12,}={0,2}",
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]{20,}+-----END [A-Z ]{0,40}PRIVATE KEY-----",
    r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]{16})(?=[A-Za-z_+/-]*+[0-9])(?![A-Za-z0-9_-]{0,40}?" + NAMED + r")[A-Za-z0-9_+/-]{16,}+(?:={1,2}(?![A-Za-z0-9_+/=-]))?",
])
#: Common words whose letters count as covered by a dictionary.
DICTIONARY = "the and for with that this from have not are was you your key token secret password example test data value name user file path config default sample server client version build linux release module class function string number index table column image http https www html json yaml node main master branch feature update service account project public private local remote time date".split()
NEAR = r"(?i)(secret|token|passw|pwd|api[_-]?key|auth|bearer|credential|private|access)"
HARMLESS = r"(?i)(sha|md5|commit|checksum|digest|hash|uuid|guid|etag|integrity|revision|build|card|order|phone|tree|parent|index)"
PLACEHOLDER = r"(?i)(example|xxxx|changeme|your|dummy|sample|placeholder|redacted|123456|abcdef|\$\{|\{\{|environ|getenv|\*\*\*|\.\.\.|^pass(word|wd)?$|^secret$)"
PREFIX = r"^(AKIA|ASIA|gh[opsu]_|github_pat_|xox[abprs]-|[sr]k_live_|sk-|AIza|eyJ|glpat-|npm_|hf_|SG\.|ya29\.|-----BEGIN)"
TEST_PATH = r"(?i)(test|example|sample|doc|fixture|mock|spec)"

#: name: (pattern, of which text, how): n counts matches, r counts them for each character, b says whether there is one.
PATTERNS = {
    "digits": ("[0-9]", "value", "r"), "upper": ("[A-Z]", "value", "r"), "lower": ("[a-z]", "value", "r"),
    "letter_digit": ("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])", "value", "r"), "case_change": ("[a-z](?=[A-Z])", "value", "r"),
    "vowel_consonant": ("(?i)[aeiou](?=[bcdfghjklmnpqrstvwxz])", "value", "r"), "separators": ("[-_/+=.:]", "value", "n"),
    "dictionary": ("(?i)(?:" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")", "value", "n"),
    "hex": ("^[0-9A-Fa-f]+$", "value", "b"), "only_digits": ("^[0-9]+$", "value", "b"), "prefix": (PREFIX, "value", "b"),
    "digest": (r"^(?i:sha|md5)", "value", "b"),
    "placeholder": (PLACEHOLDER, "value", "b"), "near": (NEAR, "before", "b"), "harmless": (HARMLESS, "before", "b"),
    "wordy": ("[A-Za-z][a-z]{3,}", "value", "r"), "code": (r"[(\[{$%]|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$", "value", "b"), "path_like": (r"^[~.]{0,2}/|://", "value", "b"),
    "named": (NAMES + r"[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?$", "before", "b"), "in_url": (r"://[^\s/@:]{0,64}:$", "before", "b"), "bearer": (r"(?i:bearer|basic)\s{1,3}$", "before", "b"),
    "assigned": (r"[:=]\s{0,3}[\"']?$", "before", "b"), "quoted": (r"^[\"']", "after", "b"), "test_path": (TEST_PATH, "path", "b"),
}
FEATURES = ["length", *PATTERNS]


def features_of(value: str, before: str, after: str, path: str) -> list[float]:
    """The features of one finding, as feature_columns() has them."""
    texts = {"value": value, "before": before, "after": after, "path": path}
    out = [float(len(value))]
    for pattern, of, how in PATTERNS.values():
        n = sum(1 for _ in re.finditer(pattern, texts[of]))
        out.append(float(n > 0) if how == "b" else n / max(1, len(value)) if how == "r" else float(n))
    return out


def feature_columns(value: Column, before: Column, after: Column, path: Column) -> Column:
    """A struct of FEATURES as doubles."""
    texts = {"value": value, "before": before, "after": after, "path": path}
    columns = [F.length(value).cast("double").alias("length")]
    for name, (pattern, of, how) in PATTERNS.items():
        if how == "b":
            c = texts[of].rlike(pattern).cast("double")
        else:
            c = F.regexp_count(texts[of], F.lit(pattern)).cast("double")
            c = c / F.greatest(F.lit(1.0), F.length(value)) if how == "r" else c
        columns.append(F.coalesce(c, F.lit(0.0)).alias(name))
    return F.struct(*columns)


def cuts(text: str) -> list[tuple[str, str, str]]:
    """(value, before, after) of each candidate of a text, as findings() has them."""
    out, last, found = [], 0, list(re.finditer(CANDIDATE, text))
    for m, following in zip(found, [*found[1:], None]):
        value = re.sub(LEAD, "", m[0])
        lead = m[0][: len(m[0]) - len(value)]
        out.append((value, (text[last : m.start()][-BEFORE:] + lead)[-BEFORE:], text[m.end() : following.start() if following else len(text)][:AFTER]))
        last = m.end()
    return out


def labelled_text(rng: random.Random) -> tuple[str, str, str | None]:
    """A text made by rule, its path, and the secret that it holds, if any."""
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    own = lambda: pick(string.ascii_lowercase, rng.randint(2, 9))
    known = lambda: rng.choice(DICTIONARY)
    word = lambda: rng.choice([own, known, lambda: pick("éèàüößñ" + string.ascii_lowercase, 6)])()
    words = lambda: " ".join(word() for _ in range(rng.randint(0, 6)))

    def name() -> str:
        base = rng.choice(["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth_token", "secret_key", "client_secret", "secret_access_key", "private_key", "auth"])
        parts = rng.choice([[], [], [own()], [known()], [own(), known()]]) + [base]
        return rng.choice(["_".join(parts), "_".join(parts).upper(), "-".join(parts), "".join(p.title() for p in "_".join(parts).split("_"))])

    def password() -> str:
        made = [known(), own(), pick(string.digits, rng.randint(1, 4)), pick("!#%^*-_@"[:7], rng.randint(0, 2))]
        rng.shuffle(made)
        text = "".join(m.title() if rng.random() < 0.4 else m for m in made)
        return text.replace("e", "3").replace("o", "0") if rng.random() < 0.5 else text

    def secret() -> str:
        return rng.choice([
            lambda: pick(hexes, rng.choice([32, 40, 40, 64])), lambda: pick(alnum + "+/", rng.choice([40, 43, 64])), lambda: pick(alnum + "+/", 43) + "=", lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
            lambda: rng.choice(["ghp_", "gho_", "npm_", "hf_"]) + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), lambda: "AIza" + pick(alnum + "_-", 35),
            lambda: "glpat-" + pick(alnum, 20), lambda: pick(alnum, rng.randint(16, 40)), lambda: pick(alnum + "!#%^*", rng.randint(9, 18)), lambda: "eyJ" + pick(alnum, 30) + ".eyJ" + pick(alnum, 40) + "." + pick(alnum + "_-", 43), password, password,
        ])()

    def harmless() -> str:
        """A value that is not a secret, whatever it is assigned to."""
        return rng.choice([
            lambda: rng.choice(["your_token_here_1", "changeme123", "xxxxxxxxxxxxxxxx1", "example-secret-1", "dummy_password1", "test1234567890", "<redacted>12", "********", "placeholder", "password", "secret-sample", "YOUR_API_KEY", "replace-me-please"]),
            lambda: "${" + name().upper() + "}", lambda: "$" + name().upper(), lambda: "{{ " + name() + " }}", lambda: f'os.environ["{name().upper()}"]', lambda: f"getenv('{name().upper()}')", lambda: "process.env." + name().upper(),
            lambda: rng.choice(["self", "request", "config", "settings", "args"]) + "." + name().lower(), lambda: rng.choice(["get", "read", "load", "make"]) + "_" + name().lower() + rng.choice(["()", "(x)", "(path);"]),
            lambda: rng.choice(["get", "read", "load", "fetch"]) + name().replace("_", " ").title().replace(" ", "") + rng.choice(["()", "('db')", "(x);"]),
            lambda: rng.choice(["None", "required", "string", "undefined", "optional", "deprecated", "boolean", "function", "bearer", "default"]) + rng.choice(["", ";", ","]), lambda: f"{known()} {known()} {own()}", lambda: rng.choice(["", "/", "./", "~/"]) + "/".join(rng.choice([known(), own()]) for _ in range(rng.randint(2, 5))) + rng.choice(["", ".txt", ".pem", ".json"]),
            lambda: "-".join(rng.choice([known(), own()]) for _ in range(rng.randint(2, 4))), lambda: "https://" + own() + ".example.com/" + known(), lambda: pick(string.digits, rng.randint(2, 10)), lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}", lambda: own() * 2, lambda: known() + known(),
        ])()

    def neutral() -> str:
        """A run of token characters that is not a secret, with the words that tell so."""
        return rng.choice([
            lambda: rng.choice(["commit ", "sha1: ", "checksum=", "md5 = ", "digest: ", "sha256-", "revision ", "etag: ", "index ", "tree ", "parent ", "hash=", "build "]) + pick(hexes, rng.choice([32, 40, 64])),
            lambda: rng.choice(["uuid ", "id=", "guid: ", "request_id=", "trace "]) + "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), lambda: pick(string.digits, rng.choice([16, 16, 18, 20])), lambda: "-".join(pick(string.digits, 4) for _ in range(4)),
            lambda: "_".join(rng.choice([known(), own()]) for _ in range(rng.randint(3, 5))) + str(rng.randint(0, 99)), lambda: "/".join(rng.choice([known(), own()]) for _ in range(rng.randint(3, 5))) + "/v" + str(rng.randint(1, 9)),
            lambda: known().title() + known().title() + own().title() + known().title() + str(rng.randint(1, 999)), lambda: "_" * rng.randint(8, 20) + str(rng.randint(1, 9)) + "=" * rng.randint(4, 20), lambda: f"20{rng.randint(10, 30)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}_{rng.randint(10, 59)}_{rng.randint(10, 59)}",
            lambda: "sha512-" + pick(alnum + "+/", 86) + "==", lambda: own() + "://" + own() + ".example.com:" + pick(string.digits, 4) + "/" + known() + "@" + pick(string.digits, 3),
        ])()

    def assigned(value: str) -> str:
        q = rng.choice(['"', "'", '"'])
        return rng.choice([
            lambda: f"{name()} = {q}{value}{q}", lambda: f"{name()}={q}{value}{q}", lambda: f"{name().upper()}={value}", lambda: f"export {name().upper()}={value}", lambda: f"{name()}: {value}", lambda: f'"{name()}": "{value}"',
            lambda: f"--{name().lower()}={value}", lambda: f"{name()} => {q}{value}{q},", lambda: f"{name()} := {q}{value}{q}", lambda: f"?{known()}={own()}&{name()}={value}&{own()}={rng.randint(1, 99)}", lambda: f"{name().upper()}={value}",
        ])()

    def bearer(value: str) -> str:
        return rng.choice(["Authorization: Bearer ", "authorization: bearer ", "Bearer ", '-H "Authorization: Bearer ', "Authorization: token ", "Basic "]) + value

    def in_url(value: str) -> str:
        return f"{rng.choice(['postgres', 'mysql', 'https', 'amqp', 'redis', 'mongodb+srv'])}://{rng.choice([own(), known(), ''])}:{value.replace('/', '_').replace('@', '_')}@{own()}.{rng.choice(['example.com', 'internal', 'local'])}:{rng.randint(80, 9999)}/{own()}"

    path = rng.choice(["src0", "src7", "app/main.py", "config/prod.env", "deploy.yaml", "notes.txt", "tests/test_auth.py", "docs/example.md"])
    kept = None
    if rng.random() < 0.5:
        kept = secret()
        how = rng.random()
        if how < 0.65:
            middle = assigned(kept)
        elif how < 0.78:
            middle = bearer(kept)
        elif how < 0.9:
            kept = kept.replace("/", "_").replace("@", "_")
            middle = in_url(kept)
        elif how < 0.93:
            kept = "-----BEGIN " + rng.choice(["RSA ", "EC ", "OPENSSH ", ""]) + "PRIVATE KEY-----\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(rng.randint(2, 6))) + "\n-----END PRIVATE KEY-----"
            middle = kept
        else:
            kept = rng.choice(["AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(alnum, 36), "sk_live_" + pick(alnum, 24), "glpat-" + pick(alnum, 20)])
            middle = kept
    else:
        middle = rng.choice([
            lambda: assigned(harmless()), lambda: assigned(harmless()), neutral, neutral, lambda: bearer(rng.choice(["authentication", "authorization-code", "credentials", "token_required"])), lambda: in_url(rng.choice(["password", "pass", "secret", "changeme", "${DB_PASSWORD}", "example", "****", "PASSWORD"])),
            lambda: f"{name()}_{rng.choice(['limit', 'count', 'length', 'ttl', 'timeout', 'min_size'])}{rng.choice(['=', ': ', ' = '])}{pick(string.digits, rng.randint(6, 9))}",
            lambda: f"{name()}_{rng.choice(['name', 'file', 'path', 'url', 'type', 'header', 'method', 'class', 'hash_algo', 'ref'])}{rng.choice(['=', ': ', ' = '])}{harmless()}",
        ])()
    return words() + rng.choice([" ", "\n", " "]) + middle + rng.choice(["", " ", "!!", "\n", "\n", ".", " and "]) + words(), path, kept


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """n findings (value, before, after, path, label) that a scan makes of labelled_text()s."""
    rng = random.Random(seed)
    out: list[tuple[str, str, str, str, int]] = []
    while len(out) < n:
        text, path, kept = labelled_text(rng)
        out += [(value, before, after, path, int(kept is not None and (value in kept or kept in value))) for value, before, after in cuts(text)]
    return out[:n]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> tuple | float:
    """A tree: (feature, threshold, at most, more), or at a leaf the part of secrets."""
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return round(float(y.mean()), 4)
    best = (1e9, 0, 0.0)
    for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5) + 2), replace=False):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 15)))
        for t in cuts:
            left = x[:, f] <= t
            n = left.sum()
            if 0 < n < len(y):
                p, q = y[left].mean(), y[~left].mean()
                impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if impurity < best[0]:
                    best = (impurity, f, float(t))
    if best[0] > 1e8:
        return round(float(y.mean()), 4)
    left = x[:, best[1]] <= best[2]
    return int(best[1]), best[2], grow(x[left], y[left], rng, depth - 1), grow(x[~left], y[~left], rng, depth - 1)


def train(findings: list[tuple[str, str, str, str, int]], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """A random forest of labelled findings (value, before, after, path, label)."""
    rng = np.random.default_rng(seed)
    x = np.array([features_of(*f[:4]) for f in findings])
    y = np.array([f[4] for f in findings], float)
    out = []
    for _ in range(trees):
        own = rng.integers(0, len(y), len(y))
        out.append(grow(x[own], y[own], rng, depth))
    return out


@cache
def default_forest() -> list:
    return train(labelled_findings())


def chance(forest: list, features: Column) -> Column:
    """The mean of the trees as an expression over a struct of FEATURES."""

    def walk(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        f, t, left, right = node
        return F.when(features[FEATURES[f]] <= F.lit(t), walk(left)).otherwise(walk(right))

    total = F.lit(0.0)
    for tree in forest:
        total = total + walk(tree)
    return F.round(total / len(forest), 4)


def bound(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.transform(F.array(value), f)[0]


def running(numbers: Column) -> Column:
    """The sums up to and with each number: every round adds what lies twice as far back, so log2(n) rounds do."""
    rounds = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(numbers).cast("double"))).cast("int")))
    step = lambda a, r: F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - F.call_function("shiftleft", F.lit(1), r)), F.lit(0).cast("long")))
    return F.when(F.size(numbers) > 0, F.aggregate(rounds, numbers, step)).otherwise(numbers)


def findings(text: Column, path: Column, forest: list) -> Column:
    """A struct of `pieces`, what lies between candidates, and `found`: start, stop, value, lead (what precedes the value in the match) and score of each; null without candidates.

    Every step is done once a text or once a candidate, so the work is in proportion to the text.
    """
    cut = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("match"), F.split(text, CANDIDATE, -1).alias("pieces"))

    def scored(d: Column) -> Column:
        lead = F.left(d["match"], F.length(d["match"]) - F.length(d["value"]))
        before = F.right(F.concat(F.right(d["left"], F.lit(BEFORE)), lead), F.lit(BEFORE))
        return bound(feature_columns(d["value"], before, d["after"], path), lambda f: F.struct(
            (d["stop"] - F.length(d["value"])).alias("start"), d["stop"].alias("stop"), d["value"].alias("value"), lead.alias("lead"), chance(forest, f).alias("score"),
        ))

    def whole(z: Column) -> Column:
        sizes = F.transform(z["match"], lambda m, i: (F.length(m) + F.length(F.get(z["pieces"], i))).cast("long"))
        drawn = lambda stops: F.transform(z["match"], lambda m, i: bound(F.struct(
            F.get(stops, i).alias("stop"), F.regexp_replace(m, LEAD, "").alias("value"), m.alias("match"),
            F.get(z["pieces"], i).alias("left"), F.substring(F.get(z["pieces"], i + 1), 1, AFTER).alias("after"),
        ), scored))
        return F.struct(z["pieces"].alias("pieces"), bound(running(sizes), drawn).alias("found"))

    return F.when(text.rlike(CANDIDATE), bound(cut, whole))


def _scanned(docs: DataFrame, text: str, path: str | None, forest: list | None) -> DataFrame:
    """row (the columns of docs), text, and findings() as `own`."""
    where = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"), where.alias("path"))
    return rows.select("row", "text", findings(F.col("text"), F.col("path"), forest or default_forest()).alias("own"))


def find_secrets(docs: DataFrame, text: str = "text", path: str | None = "source", forest: list | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, finding, start, stop (code points), value_sha256, n_chars, score, is_secret: a row for each candidate.

    Null and empty texts have none; a null path is empty; ties and repeated rows are scanned each.
    """
    found = _scanned(docs, text, path, forest).select(F.col("row.doc_id").alias("doc_id"), F.posexplode("own.found").alias("finding", "f"))
    return found.select("doc_id", "finding", F.col("f.start").cast("long").alias("start"), F.col("f.stop").cast("long").alias("stop"), F.sha2("f.value", 256).alias("value_sha256"), F.length("f.value").cast("long").alias("n_chars"), "f.score", (F.col("f.score") >= cutoff).alias("is_secret"))


def without_secrets(docs: DataFrame, text: str = "text", path: str | None = "source", forest: list | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs, all columns, with MASK in the text in place of each secret; n_chars, if there, counts the new text."""
    own = _scanned(docs, text, path if path in docs.columns else None, forest)
    told = F.zip_with("own.pieces", "own.found", lambda p, f: F.concat(p, F.coalesce(f["lead"], F.lit("")), F.coalesce(F.when(f["score"] >= cutoff, F.lit(MASK)).otherwise(f["value"]), F.lit(""))))
    secret = F.coalesce(F.exists("own.found", lambda f: f["score"] >= cutoff), F.lit(False))
    own = own.select("row", secret.alias("secret"), F.when(secret, F.array_join(told, "")).otherwise(F.col("text")).alias("told"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {text: F.col("told")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("secret"), F.length("told").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return own.select(*[c.alias(name) for name, c in columns.items()])
