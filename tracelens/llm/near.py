"""Near duplicates by an n-gram Jaccard join: a MinHash LSH forest, then exact verification.

A text's words (lower-cased runs of ASCII letters, digits and non-ASCII characters) give its set of shingles
of five words.  Equal word sequences are copies: they are one node from the start.  A node has a label in each of
`trees` tries, `longest` MinHash values whose bytes sort as the trie does; a label is matched by a prefix.

The forest is read from the longest prefixes upwards.  At each depth the groups of equal prefixes that branch there
(all groups, at the longest) give the candidates, and those are verified on their exact shingle sets.  A record
shortens its prefixes until its recall is reached: a link of similarity s is found at depth d with probability
p(s) = 1 - (1 - s ** d) ** trees, so the links found, each divided by p(s), tell how many there are; with one more
assumed to lie at the threshold itself, the part that is found must reach `recall`.  A record that finds nothing
goes on to the depth at which p(threshold) reaches it, the least; a record in a group of many copies stops at
long prefixes.  A pair is looked at while either of its records goes on.

A pair is verified once: at the longest prefix that it shares in any trie, in the first such trie.  A group of
more than BLOCK texts is verified as pairs of blocks, with one product of matrices each; links are counted and
joined by a spanning forest, so there is no row for each pair and no group is cut short.

Empty and null texts are alone in their class, as are texts without a word unless their strings are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import words

THRESHOLD, SHINGLE, TREES, LONGEST, RECALL, SEED = 0.8, 5, 16, 8, 0.998, 20240501
#: Texts and words of a block at most; a group of more is verified as pairs of blocks.
BLOCK, BLOCK_WORDS = 512, 2_000_000
#: Bytes of a MinHash value in a label.
VALUE = 2


def stop_depth(threshold: float, trees: int, longest: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold shares one in some tree with the target recall; no record goes on to a shorter one."""
    for depth in range(longest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at {threshold}")


def signatures(texts: list[str | None], width: int, functions: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its word sequence's digest (two halves), the count of its words, and MinHash values (uint32)."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**32, functions, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, functions, dtype=np.uint32)
    digests, counts, mins = [], [], []
    for lo, hi in words.slices(texts):
        part = texts[lo:hi]
        h, bounds = words.words(part)
        n = np.diff(bounds)
        counts.append(n)
        digests.append(sequence_digests(h, bounds))
        each = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        first = np.zeros(len(n) + 1, np.int64)
        np.cumsum(each, out=first[1:])
        doc = np.repeat(np.arange(len(n)), each)
        start = bounds[:-1][doc] + np.arange(len(doc)) - first[doc]
        value = (words.span_hashes(h, start, start + np.minimum(width, n)[doc]) >> np.uint64(32)).astype(np.uint32)
        turned = np.empty_like(value)
        out = np.zeros((hi - lo, functions), np.uint32)
        full = np.flatnonzero(each)
        if len(full):
            at = first[:-1][full]
            for k in range(functions):
                np.multiply(value, a[k], out=turned)
                np.add(turned, b[k], out=turned)
                out[full, k] = np.minimum.reduceat(turned, at)
        mins.append(out)
    if not counts:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros((0, functions), np.uint32)
    return np.concatenate(digests), np.concatenate(counts), np.concatenate(mins)


def sequence_digests(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two hashes of each text's sequence of word hashes."""
    one = words.span_hashes(h, bounds[:-1], bounds[1:])
    two = words.span_hashes(words.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds[:-1], bounds[1:])
    return np.stack([one, two], 1)


def _signed(width: int, trees: int, longest: int, seed: int):
    """doc_id, digest, count of words and label: the MinHash values of all tries, the low bytes of each (the high ones of a long text's are zeros), in the tries' order."""
    schema = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n_words", pa.int64()), ("label", pa.binary())])

    def run(parts):
        for part in parts:
            texts = part.column(1).to_pylist()
            digest, n, mins = signatures(texts, width, trees * longest, seed)
            for i in np.flatnonzero(n == 0):  # no words: by the string itself, or alone
                t = (texts[i] or "").strip().encode("utf-8", "replace")
                digest[i] = words.span_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0] if t else 0
            raw = (mins & np.uint32((1 << 8 * VALUE) - 1)).astype(">u2").tobytes()
            size = trees * longest * VALUE
            d = digest.view(np.int64).reshape(-1, 2)
            labels = pa.array([raw[i * size : (i + 1) * size] for i in range(len(texts))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(n.astype(np.int64)), labels], schema=schema)

    return C.lean(run), "doc_id long, d1 long, d2 long, n_words long, label binary"


def similarities(texts: list[str | None], width: int) -> np.ndarray:
    """Exact Jaccard similarities of the texts' shingle sets; empty sets are like nothing."""
    value, bounds = words.shingles(texts, width)
    n = len(texts)
    size = np.diff(bounds)
    _, feature, count = np.unique(value, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(n), size)
    shared = count[feature] > 1
    doc, feature = doc[shared], feature[shared]
    _, feature = np.unique(feature, return_inverse=True)
    inter = np.zeros((n, n), np.float32)
    if len(feature):
        order = np.argsort(feature, kind="stable")
        doc, feature = doc[order], feature[order]
        chunk = 2048
        for lo in range(0, int(feature[-1]) + 1, chunk):
            i, j = np.searchsorted(feature, [lo, lo + chunk])
            m = np.zeros((n, chunk), np.float32)
            m[doc[i:j], feature[i:j] - lo] = 1
            inter += m @ m.T
    union = size[:, None] + size[None, :] - inter
    return np.where(union > 0, inter / np.maximum(union, 1), 0.0)


def spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links; each of its rows is looked at once."""
    forest = []
    todo = np.ones(len(link), bool)
    for s in range(len(link)):
        if not todo[s]:
            continue
        todo[s] = False
        queue = [s]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(link[x] & todo)
            todo[new] = False
            forest += [(x, int(y)) for y in new]
            queue += new.tolist()
    return forest


def first_shared(labels: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """Which pairs of labels (texts, tries, values) are this trie's at this depth: they share no longer prefix in any trie, and this one in no earlier trie."""
    n, trees, longest = labels.shape
    out = np.ones((n, n), bool)

    def same(t: int, d: int) -> np.ndarray:
        _, key = np.unique(labels[:, t, :d], axis=0, return_inverse=True)
        key = key.ravel()
        return key[:, None] == key[None, :]

    for t in range(tree):
        out &= ~same(t, depth)
    if depth < longest:
        for t in range(trees):
            out &= ~same(t, depth + 1)
    return out


def _verified(threshold: float, width: int, trees: int, longest: int, depth: int, least: int):
    """Verifies a group's block or pair of blocks.  node, links, and the links divided by the chance to find them at each depth from `least` to this one; or node and a linked other."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64()), ("due", pa.list_(pa.float64()))])

    def run(table: pa.Table) -> pa.Table:
        i, j, tree = (table.column(c)[0].as_py() for c in ("i", "j", "tree"))
        ids, texts = table.column("node").to_numpy(), table.column("text").to_pylist()
        h, bounds = words.words(texts)
        # of repeated ids only the row with the node's own word sequence
        own = sequence_digests(h, bounds)[:, 0].view(np.int64) == table.column("d1").to_numpy()
        at = np.array(sorted({int(x): k for k, x in reversed(list(enumerate(ids))) if own[k]}.values()), np.int64)
        ids, texts = ids[at], [texts[k] for k in at]
        block, active = table.column("block").to_numpy()[at], table.column("active").to_numpy(zero_copy_only=False)[at]
        raw = b"".join(table.column("label")[k].as_py() for k in at.tolist())
        labels = np.frombuffer(raw, ">u2").reshape(len(at), trees, longest)
        allowed = first_shared(labels, tree, depth) & (active[:, None] | active[None, :])
        np.fill_diagonal(allowed, False)
        if i != j:
            allowed &= block[:, None] != block[None, :]
        out: list[list] = [[], [], [], []]
        if allowed.any():
            like = similarities(texts, width)
            link = allowed & (like >= threshold - 1e-6)
            count = link.sum(1)
            due = [np.where(link, 1 / np.maximum(1 - (1 - like.astype(np.float64) ** d) ** trees, 1e-9), 0).sum(1) for d in range(least, depth + 1)]
            for k in np.flatnonzero(count).tolist():
                for column, value in zip(out, (int(ids[k]), int(count[k]), None, [float(x[k]) for x in due])):
                    column.append(value)
            for x, y in spanning(link):
                for column, value in zip(out, (int(ids[x]), 0, int(ids[y]), None)):
                    column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run, "node long, links long, other long, due array<double>"


def keyed(docs: DataFrame) -> tuple[DataFrame, int | None, int | None]:
    """docs with __id, its doc_id as a long or, where that is null, a written number that no doc_id has; and the first and last of these."""
    id_ = F.col("doc_id").cast("long")
    named = docs.withColumn("__id", id_).filter("__id IS NOT NULL")
    lost = C.saved(docs.filter(id_.isNull()).withColumn("__id", F.monotonically_increasing_id()), "unnamed")
    last = lost.agg(F.max("__id")).first()[0]
    if last is None:
        return named, None, None
    low, high = named.agg(F.min("__id"), F.max("__id")).first()
    first = 0 if high is None else high + 1
    if first + last >= 2**63:
        first = low - 1 - last
    if first < -(2**63):
        raise ValueError("no numbers left for rows without an id")
    return named.unionByName(lost.withColumn("__id", F.col("__id") + F.lit(first))), first, first + last


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for each distinct doc_id of docs(doc_id long, text), and for each row whose doc_id is null.

    As classes_of(); documents without an id count like others, and class_id is null where no member has one.
    """
    rows, first, last = keyed(docs.select("doc_id", "text"))
    found = classes_of(rows.select(F.col("__id").alias("doc_id"), "text"), **parameters)
    if first is None:
        return found
    found = C.saved(found, "classes")
    name = F.when(~F.col("doc_id").between(first, last), F.col("doc_id"))
    least = found.groupBy(F.col("class_id").alias("__class")).agg(F.min(name).alias("__least"))
    return found.join(least, F.col("class_id") == F.col("__class")).select(name.alias("doc_id"), F.col("__least").alias("class_id"), "n_links", "n_copies")


def classes_of(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for each distinct doc_id of docs(doc_id long, text).

    class_id: the least doc_id of the class; classes are the components of the links.  n_links: other word
    sequences in docs of similarity >= threshold; n_copies: other documents of the same word sequence.
    Nulls and empty texts are alone.  Repeated rows of a doc_id count once (the text of least digest
    counts if they differ); doc_id must not be null here.  Other columns are not looked at.  An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    C.batches(spark)
    least = stop_depth(threshold, trees, longest, recall)
    run, schema = _signed(width, trees, longest, seed)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = C.saved(base.mapInArrow(run, schema), "signatures")
    blank = (F.col("n_words") == 0) & (F.col("d1") == 0) & (F.col("d2") == 0)
    own = signed.withColumn("d2", F.when(blank, F.col("doc_id")).otherwise(F.col("d2")))
    one = own.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("d")).select("doc_id", "d.*")
    nodes = C.saved(one.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    heads = own.filter("n_words > 0").join(nodes, ["d1", "d2"]).filter("doc_id = node").groupBy("node", "d1", "d2").agg(F.first("label").alias("label"), F.first("n_words").alias("n_words"))
    heads = C.saved(heads, "heads")
    # the tries, as far as two nodes share the shortest prefix
    size = longest * VALUE
    members = heads.select("node", "n_words", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "label")
    members = members.select("node", "n_words", "tree", F.substring("label", F.col("tree") * size + 1, F.lit(size)).alias("path"))
    prefix = lambda d: F.substring("path", 1, d * VALUE)
    groups = members.groupBy("tree", prefix(least).alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select(F.col("tree").alias("t"), "key")
    forest = C.saved(members.join(groups, (F.col("tree") == F.col("t")) & (prefix(least) == F.col("key"))).select("node", "n_words", "tree", "path"), "forest")
    shared = forest.select("node").distinct()
    texts = base.join(heads.join(shared, "node").withColumnRenamed("node", "head"), F.col("doc_id") == F.col("head"))
    texts = C.saved(texts.select(F.col("head").alias("node"), "d1", "label", "text"), "texts")
    found, stopped = [], None
    for depth in range(longest, least - 1, -1):
        at = forest.withColumn("key", prefix(depth))
        if stopped is None:
            at = at.withColumn("active", F.lit(True))
        else:
            at = at.join(stopped.withColumnRenamed("node", "done"), F.col("node") == F.col("done"), "left").withColumn("active", F.col("done").isNull()).drop("done")
        longer = prefix(min(depth + 1, longest))
        groups = at.groupBy("tree", "key").agg(
            F.count("*").alias("n"), F.sum("n_words").alias("w"), F.max("active").alias("some"), F.min(longer).alias("low"), F.max(longer).alias("high"),
            F.expr("bit_xor(xxhash64(node))").alias("who"), F.min("node").alias("first"), F.max("node").alias("last"),
        ).filter((F.col("n") > 1) & F.col("some") & (F.lit(depth == longest) | (F.col("low") != F.col("high"))))
        # a group of the same nodes in a later trie has no pair of its own
        groups = groups.groupBy("who", "first", "last", "n", "w").agg(F.min(F.struct("tree", "key")).alias("g"))
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("w") / BLOCK_WORDS)).cast("int")
        groups = groups.select(F.col("g.tree").alias("t"), F.col("g.key").alias("k"), blocks.alias("blocks"))
        placed = at.join(groups, (F.col("tree") == F.col("t")) & (F.col("key") == F.col("k")))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.select(F.col("node").alias("x"), "tree", "key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "active")
        run, schema = _verified(threshold, width, trees, longest, depth, least)
        pairs = placed.join(texts, F.col("x") == F.col("node")).select("tree", "key", "i", "j", "block", "active", "node", "d1", "label", "text")
        found.append(C.saved(pairs.groupBy("tree", "key", "i", "j").applyInArrow(run, schema), f"found{depth}"))
        if depth > least:
            stopped = C.saved(_stopped(found, threshold, trees, least, depth, recall), f"stopped{depth}")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    counts = every.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    linked = C.components(every.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = (
        nodes.join(linked.withColumnRenamed("label", "class_id"), "node", "left")
        .join(counts, "node", "left")
        .select("d1", "d2", F.coalesce("class_id", "node").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    )
    return one.join(classes, ["d1", "d2"]).select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("n_copies").cast("long").alias("n_copies"))


def _stopped(found: list[DataFrame], threshold: float, trees: int, least: int, depth: int, recall: float) -> DataFrame:
    """The nodes that have reached the recall at this depth, by the links found there and before."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    at_threshold = 1 - (1 - threshold**depth) ** trees
    sums = every.filter("links > 0").groupBy("node").agg(F.sum("links").alias("n"), F.sum(F.get("due", F.lit(depth - least))).alias("due"))
    return sums.filter((F.col("n") + at_threshold) / (F.col("due") + 1) >= recall).select("node")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """One row of each class of near duplicates of docs, all columns: that of least doc_id, the first of several, null ids last.

    Every row is a document of its own, those without an id and those that share one too.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = C.saved(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("at")), "rows")
    found = classes_of(rows.select(F.col("at").alias("doc_id"), F.col("row.text").alias("text")), **parameters).select(F.col("doc_id").alias("member"), "class_id")
    named = found.join(rows.select("at", "id"), F.col("member") == F.col("at"))
    kept = named.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "at")).alias("first")).select(F.col("first.at").alias("kept"))
    return rows.join(kept, F.col("at") == F.col("kept"), "left_semi").select("row.*")
