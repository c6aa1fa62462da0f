"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A page is cut into leaf blocks: runs of text between the tags of block elements, each with its open elements.
Features are ancestor tags, the names in their class, id and role attributes, and the text's length, link
density and punctuation.  Names count apart for the nearest element that has any, for those around it, and for what stands around an
article or main element; html and body have none.  Of a compound name the last word and the words before it count apart, and of
"has-sidebar" or "no-ads" only that it is such a one.  Two states, content or not; transitions depend on whether two blocks share their
container.  Trained on PAGES labelled pages that labelled_page() makes by rule (or the caller's own), decoded by Viterbi.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PAGES, EPOCHS, SEED = 500, 12, 3
#: Open elements that are told apart, as browsers bound them; what lies deeper belongs to the last of these.
DEEPEST = 512
#: Elements by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template iframe noembed".split())
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav noscript ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
#: A start tag of these ends an open element of the set.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"button", "label", "option", "legend", "summary", "caption"}
#: What a "<" may begin: a comment, a declaration, or a tag's name.
MARKUP = re.compile(r"<(?:(?P<comment>!--)|(?P<declared>[!?])|(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*))")
#: The rest of a tag: a quote counts as one after an equals sign.  Nothing is tried twice, so the work is that of the characters read.
REST = re.compile(r"((?>[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
#: A name and its value, which is read with it, so that nothing in a value counts as a name.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: First words of names that say what a part has or does, not what it is.
STATES = set("has have with without no not is are hide show enable enabled disable disabled js can uses use".split())


def names_of(value: str) -> tuple[str, ...]:
    """The names of a class, id or role attribute: "name" of a single word, "-name" of the last word of a compound, "name-" of the others."""
    out: list[str] = []
    for token in value.split():
        words = [w.lower() for w in WORD.findall(token)]
        if len(words) > 1 and words[0] in STATES:
            out.append(words[0] + "-")
        elif len(words) == 1:
            out.append(words[0])
        elif words:
            out += [w + "-" for w in words[:-1]] + ["-" + words[-1]]
    return tuple(out)


def own_names(tag: str, attributes: str) -> tuple[str, ...]:
    """The names of an element, and "hidden" if it isn't shown."""
    out: list[str] = []
    for a in ATTRIBUTE.finditer(attributes):
        name, value = a[1].lower(), (a[2] or "").strip("\"'")
        if name == "hidden" and value.lower() not in ("false", "until-found") or name == "aria-hidden" and value.lower() == "true":
            out.append("hidden")
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.append("hidden")
        elif name in ("class", "id", "role") and tag not in ("html", "body"):
            out += names_of(value)
    return tuple(out)


def blocks(page: str) -> list[tuple[tuple[str, ...], tuple[tuple[str, ...], ...], str, int]]:
    """(tags, names of each, text, characters in links) of each leaf block with text, in page order."""
    out = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at, n = 0, 0, 0, len(page)
    quoted = True  # until a tag does not end: from there on quotes don't count, so that no text is lost
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # raw elements that nothing closes any more

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((tuple(t for t, _ in stack), tuple(ws for _, ws in stack), text, linked))
            parts.clear()
        linked = 0

    while at < n:
        m = MARKUP.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        if m["comment"]:
            at = page.find("-->", m.end())
            at = n if at < 0 else at + 3
            continue
        rest = REST.match(page, m.end()) if quoted and m["tag"] else None
        if rest:
            at, attributes = rest.end(), rest[1]
        else:
            quoted = quoted and not m["tag"]
            stop = page.find(">", m.end())
            if stop < 0:  # not markup: the page's last "<" signs are text
                parts.append(page[m.start() :])
                break
            at, attributes = stop + 1, page[m.end() : stop]
        if not m["tag"]:
            continue
        tag, closing = m["tag"].lower(), bool(m["close"])
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/") and tag not in endless:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if close:
                    at = close.end()
                elif tag in ("script", "style"):
                    at = n
                else:
                    endless.add(tag)
            parts.append(" ")
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            continue
        if tag not in BLOCK:
            continue
        end()
        if closing:
            while opened[tag]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
            continue
        close = IMPLIED.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        for _ in range(2):
            if stack and stack[-1][0] in close:
                opened[stack.pop()[0]] -= 1
        if len(stack) >= DEEPEST:
            continue
        stack.append((tag, own_names(tag, attributes)))
        opened[tag] += 1
    end()
    return out


def features(found: list) -> tuple[list[list[str]], list[int]]:
    """Features of each block, and whether it shares its container with the one before."""
    out, same, last = [], [], None
    for tags, names, text, linked in found:
        f = ["1", "in:" + (tags[-1] if tags else "-")]
        f += {"a:" + t for t in tags}
        inside = max((i for i, t in enumerate(tags) if t in ("article", "main")), default=0)
        named = [i for i, ws in enumerate(names) if ws]
        f += {("own:" if i == named[-1] else "up:" if i >= inside else "out:") + w for i in named for w in names[i]}
        if any("hidden" in ws for ws in names):
            f.append("hidden")
        n = len(text)
        f.append(f"n:{min(9, int(math.log2(n + 1)))}")
        density = linked / max(1, n)
        f.append(f"l:{min(4, int(4 * density + 0.01))}")
        f.append("stop" if text[-1] in ".!?…\"”»:" else "open")
        f.append(f"c:{min(3, text.count(','))}")
        if "©" in text or "&copy" in text:
            f.append("copyright")
        if density > 0.5 and n < 60:
            f.append("menu")
        container = tags[:-1]
        same.append(int(container == last))
        last = container
        out.append(f)
    return out, same


def viterbi(score: list[float], same: list[int], move: list[list[list[float]]]) -> list[int]:
    """The best states: score is of state 1, transitions move[same][from][to]."""
    if not score:
        return []
    a, b, back = 0.0, score[0], []
    for s, m in zip(score[1:], same[1:]):
        t = move[m]
        from0, from1 = a + t[0][0], b + t[1][0]
        to0, to1 = a + t[0][1], b + t[1][1]
        back.append((int(from1 > from0), int(to1 > to0)))
        a, b = max(from0, from1), max(to0, to1) + s
    state = int(b > a)
    out = [state]
    for pair in reversed(back):
        state = pair[state]
        out.append(state)
    return out[::-1]


def _add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def train(pages: list[tuple[list, list[int]]], epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-5, seed: int = SEED) -> tuple[dict[str, float], list]:
    """Weights and transitions that maximise the log-likelihood of labelled blocks, by AdaGrad page after page."""
    place: dict[str, int] = {}
    known = []
    for found, labels in pages:
        if found:
            fs, same = features(found)
            flat = np.array([place.setdefault(f, len(place)) for x in fs for f in x])
            sizes = np.array([len(x) for x in fs])
            own, at = np.unique(flat, return_inverse=True)
            known.append((flat, np.cumsum(sizes) - sizes, sizes, own, at, np.array(same), np.array(labels, float)))
    weight, square = np.zeros(len(place)), np.full(len(place), 1e-8)
    move, msquare = np.zeros((2, 2, 2)), np.full((2, 2, 2), 1e-8)
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(known)
        for flat, starts, sizes, own, at, same, labels in known:
            score = np.add.reduceat(weight[flat], starts)
            n, given, steps = len(score), score.tolist(), move.tolist()
            fwd, bwd = [(0.0, given[0])], [(0.0, 0.0)] * n
            for t in range(1, n):
                m, (a, b) = steps[same[t]], fwd[-1]
                fwd.append((_add(a + m[0][0], b + m[1][0]), _add(a + m[0][1], b + m[1][1]) + given[t]))
            for t in range(n - 2, -1, -1):
                m, (a, b) = steps[same[t + 1]], bwd[t + 1]
                b += given[t + 1]
                bwd[t] = (_add(m[0][0] + a, m[0][1] + b), _add(m[1][0] + a, m[1][1] + b))
            z, f, b = _add(*fwd[-1]), np.array(fwd), np.array(bwd)
            g = labels - np.exp(f[:, 1] + b[:, 1] - z)
            slope = np.bincount(at, np.repeat(g, sizes), len(own))
            square[own] += slope**2
            weight[own] = weight[own] * (1 - decay) + rate * slope / np.sqrt(square[own])
            if n > 1:
                # the chance of each pair of states at each step, from and to
                p = np.exp(f[:-1, :, None] + move[same[1:]] + (b[1:] + np.outer(score[1:], (0, 1)))[:, None, :] - z)
                states = np.stack([1 - labels, labels], 1)
                steep = states[:-1, :, None] * states[1:, None, :] - p
                slope = np.stack([steep[same[1:] == k].sum(0) for k in (0, 1)])
                msquare += slope**2
                move += rate * slope / np.sqrt(msquare)
    return {f: float(weight[i]) for f, i in place.items()}, move.tolist()


@cache
def _words(alphabet: str, n: int = 3000) -> list[str]:
    rng = random.Random(f"{SEED}{alphabet}")
    return ["".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(n)]


def labelled_page(rng: random.Random) -> str:
    """A page made by rule; text that is content stands between \x02 and \x03."""
    pool = _words(rng.choice(["etaoinshrdlu", "enirstaduhlä", "esaitnrulodé", "eaosrnidlcñó"]))
    word = lambda: rng.choice(pool)
    words = lambda a, b: " ".join(rng.choices(pool, k=rng.randint(a, b)))
    sentence = lambda a=4, b=25: words(a, b).capitalize() + rng.choice([".", ".", ".", "?", "!", ",", "***", " &amp;&amp;", ""])
    para = lambda: " ".join(sentence() for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 8])))
    yes = lambda s: f"\x02{s}\x03"
    link = lambda a=1, b=4: f'<a href="/{word()}">{words(a, b)}</a>'
    attr = lambda *names: (lambda v: rng.choice([f' class="{v}"', f' id="{v}"', f' class="{v} {word()}"', f' class="{word()}-{v}"']))(rng.choice(names))
    box = lambda tag, names, inside: f"<{tag}{attr(*names) if names else ''}>{inside}</{tag}>"
    part = lambda: rng.choice(["sidebar", "header", "footer", "nav", "menu", "ads", "ad", "comments", "widget", "notice", "banner", "related", "share", "cookie", "popup", "search"])
    state = lambda: rng.choice([f"{rng.choice(sorted(STATES))}-{part()}", f"{part()}-{rng.choice(['left', 'right', 'fixed', 'open', 'on', 'off', 'top', 'sticky', 'layout', 'enabled'])}"])
    idle = lambda: rng.choice(["", "", "", f' title="{words(1, 4)}"', f' data-{word()}="{part()}"', f' lang="{word()}"', ' hidden="until-found"', f" onclick=\"{word()}('{part()}')\"", f' itemid="{part()}"', ' aria-hidden="false"', f' data-hidden="{rng.randint(0, 1)}"'])

    def holder(tag, names, inside):
        """What holds the article: its names may say what else the page has."""
        given = [rng.choice(names)] if names and rng.random() < 0.8 else []
        given = [rng.choice([g, g, f"{word()}-{g}", f"{g}-{word()}"]) for g in given] + [state() for _ in range(rng.choice([0, 0, 1, 2]))] + [word() for _ in range(rng.choice([0, 0, 1]))]
        rng.shuffle(given)
        named = f' class="{" ".join(given)}"' if given else ""
        return f"<{tag}{rng.choice([named + idle(), idle() + named])}>{inside}</{tag}>"

    some = lambda f, a, b: "".join(f() for _ in range(rng.randint(a, b)))
    prose = lambda: f"<p>{para()}</p>" if rng.random() < 0.6 else para()

    def menu():
        items = some(lambda: f"<li>{link()}</li>", 3, 9)
        return rng.choice([f"<nav><ul>{items}</ul></nav>", box("div", ["menu", "nav", "navbar", "navigation", "topnav"], f"<ul>{items}</ul>"), f'<div role="navigation">{some(link, 3, 8)}</div>', box("ul", ["menu", "breadcrumb", "breadcrumbs", "pagination"], items)])

    def advert():
        inner = rng.choice([para(), f"<p>{para()}</p>", link(2, 8), f"{sentence()} {link()}"])
        return rng.choice([box("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"], inner), box("aside", ["ad", "promo", "sponsor"], inner), box("section", ["sponsored", "ads"], inner)])

    def notice():
        inner = rng.choice([para(), f"<p>{para()}</p>", f"<p>{para()}</p><button>{word()}</button>"])
        return rng.choice([box("div", ["notice", "cookie", "cookie-banner", "consent", "alert", "warning", "gdpr", "popup", "modal", "newsletter", "paywall", "disclaimer"], inner), f'<div role="alert">{inner}</div>', f'<div role="dialog">{inner}</div>', f"<noscript>{para()}</noscript>", f'<div style="display:none">{inner}</div>'])

    def form():
        return rng.choice([f"<form><label>{words(1, 3)}</label><input><select><option>{word()}<option>{word()}</select><button>{word()}</button></form>", box("form", ["search", "subscribe", "login"], f"<p>{sentence()}</p><textarea>{words(2, 9)}</textarea><button>{words(1, 2)}</button>"), box("div", ["signup", "subscribe", "search"], f"<form><p>{para()}</p><input></form>")])

    def side():
        inner = some(lambda: rng.choice([f"<h3>{words(1, 4)}</h3><ul>{some(lambda: f'<li>{link(2, 8)}</li>', 2, 6)}</ul>", prose(), advert(), f"<p>{para()}</p>"]), 1, 3)
        return rng.choice([f"<aside>{inner}</aside>", box("aside", ["sidebar", "widget"], inner), box("div", ["sidebar", "side", "widget", "related", "recommended", "trending", "popular"], inner), f'<div role="complementary">{inner}</div>', box("section", ["related", "more", "recommended"], inner)])

    def header():
        inner = rng.choice([f"<h1>{words(1, 4)}</h1><p>{sentence()}</p>", f"<p>{sentence()}</p>", link(1, 3), f"<div>{words(1, 5)}</div>{menu()}", para()])
        return rng.choice([f"<header>{inner}</header>", box("header", ["site", "top", "masthead"], inner), box("div", ["header", "site-header", "masthead", "banner", "topbar"], inner), f'<div role="banner">{inner}</div>'])

    def footer():
        inner = rng.choice([f"&copy; {word()}.example.com &middot; {para()}", f"<p>&copy; 20{rng.randint(10, 26)} {words(1, 4)}. {sentence()}</p>", f"<p>{para()}</p><ul>{some(lambda: f'<li>{link()}</li>', 2, 5)}</ul>", para()])
        return rng.choice([f"<footer>{inner}</footer>", box("footer", ["site", "footer"], inner), box("div", ["footer", "site-footer", "copyright", "legal"], inner), f'<div role="contentinfo">{inner}</div>'])

    def comments():
        one = lambda: box(rng.choice(["div", "li", "article"]), ["comment", "reply", "comment-body"], f"{rng.choice(['', f'<b>{word()}</b> ', f'<h4>{words(1, 2)}</h4>'])}<p>{para()}</p>{some(lambda: f'<p>{para()}</p>', 0, 1)}")
        inner = f"<h2>{words(1, 2)}</h2>" * rng.randint(0, 1) + some(one, 1, 5)
        return rng.choice([box("div", ["comments", "comment-list", "responses", "discussion", "disqus"], inner), box("section", ["comments", "user-comments", "discussion"], inner), box("ul", ["comments", "commentlist"], inner)])

    def body():
        def piece():
            k = rng.random()
            if k < 0.7:
                return rng.choice([f"<p>{yes(para())}</p>", f"<p>{yes(para())}", f"<p><b>{yes(para())}<br>", f"<p>{yes(sentence() + ' <em>' + words(1, 3) + '</em> ' + sentence())}</p>", f"<p>{yes(sentence() + ' ' + link(1, 2) + ' ' + sentence())}</p>", yes(para()) if rng.random() < 0.3 else f"<p>{yes(para())}</p>", f"<div>{yes(para())}</div>"])
            return rng.choice([f"<h{(h := rng.randint(2, 4))}>{yes(words(1, 8))}</h{h}>", f"<ul>{some(lambda: f'<li>{yes(sentence(2, 15))}</li>', 2, 6)}</ul>", f"<ol>{some(lambda: f'<li>{yes(words(1, 12))}', 2, 5)}</ol>", f"<blockquote><p>{yes(para())}</p></blockquote>", f"<blockquote>{yes(para())}</blockquote>", f"<pre>{yes(words(2, 30))}</pre>", f"<table><tr><th>{yes(words(1, 3))}</th><td>{yes(words(1, 6))}</td></tr></table>", f"<figure><img><figcaption>{yes(sentence())}</figcaption></figure>"])

        title = f"<h1>{yes(words(1, 12))}</h1>" * rng.choice([0, 1, 1, 1])
        inner = rng.choice([title, title, f"<header>{title}</header>" if title else ""])
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            inner += piece()
            if rng.random() < 0.06:
                inner += rng.choice([advert, notice, side, form])()
        if rng.random() < 0.12:
            inner += rng.choice([comments, side, advert, lambda: f"<footer>{words(1, 6)}</footer>", lambda: box("div", ["share", "social", "tags"], some(link, 2, 4))])()
        how = rng.random()
        if how < 0.55:
            inner = rng.choice([f"<article{idle()}>{inner}</article>", holder("article", ["post", "entry", "article", "story"], inner)])
        elif how < 0.75:
            inner = rng.choice([f"<main{idle()}>{inner}</main>", holder("main", ["content", "main"], inner), f'<div role="main"{idle()}>{inner}</div>'])
        else:
            inner = holder(rng.choice(["div", "section", "td"]), ["content", "post-content", "entry", "article-body", "story", "main", "text", "body", "post"], inner)
        return rng.choice([inner, inner, f"<main>{inner}</main>", holder("div", ["container", "wrapper", "page", "site"], inner), f"<div>{inner}</div>"])

    before = [f() for f in (header, menu, notice, advert, form, side) if rng.random() < 0.45]
    after = [f() for f in (comments, side, advert, notice, form, menu) if rng.random() < 0.35]
    rng.shuffle(before)
    rng.shuffle(after)
    last = footer() if rng.random() < 0.85 else ""
    inner = "".join(before) + body() + "".join(after) + last
    inner = rng.choice([inner, inner, holder("div", ["wrapper", "page", "container", "site", "layout"], inner), f"<div>{inner}</div>"])
    names = rng.choice(["", f' class="{state()} {state()}"', f' id="{part()}"'])
    return f"<!DOCTYPE html><html{names}><head><title>{words(1, 9)}</title><style>p{{}}</style></head><body{names}>{inner}</body></html>"


def labelled(page: str) -> tuple[list, list[int]]:
    """Blocks of a page that labelled_page() made, and whether each is content."""
    found, labels = [], []
    for tags, names, text, linked in blocks(page):
        labels.append(int("\x02" in text or "\x03" in text))
        text = " ".join(text.replace("\x02", "").replace("\x03", "").split())
        if text:
            found.append((tags, names, text, linked))
        else:
            labels.pop()
    return found, labels


@cache
def default_model() -> tuple[dict[str, float], list]:
    rng = random.Random(SEED)
    return train([labelled(labelled_page(rng)) for _ in range(PAGES)])


def main_text(page: str | None, model: tuple[dict[str, float], list]) -> str:
    """The content blocks of a page, joined by a space; null: empty."""
    weight, move = model
    found = blocks(page or "")
    fs, same = features(found)
    get = weight.get
    states = viterbi([sum([get(f, 0.0) for f in x]) for x in fs], same, move)
    return " ".join(b[2] for b, s in zip(found, states) if s)


def extract(pages: DataFrame, model: tuple[dict[str, float], list] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html): the main text of the whole html.

    Null and empty html, and pages without content, give an empty text.  Repeated rows are read each.  A tag that never
    ends is read up to its first ">", and quotes count no more from there; the work is in proportion to the page.
    """
    spark = pages.sparkSession
    C.batches(spark)
    shared = spark.sparkContext.broadcast(model or default_model())
    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = own.drop("html").schema.add("text", "string").add("n_chars", "long")

    def run(parts):
        for part in parts:
            texts = [main_text(h, shared.value) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.mapInArrow(C.lean(run), schema)
