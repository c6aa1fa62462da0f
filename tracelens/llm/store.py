"""A content-addressed store of token ids.

A rolling hash over the last WINDOW ids cuts each document's ids into chunks where its low bits are
zero, so equal passages make equal chunks wherever they stand.  A chunk is addressed by a digest
of its ids and stored once.  A store is a folder of three Parquet tables:

  chunks    digest, ids (uint16, little endian): each distinct chunk once
  recipes   doc_id, start, n_tokens, digests, ends, root: in ascending doc_id order, a document a row; ends are
            the ids up to each chunk's end; root is the Merkle root of its digests
  manifest  range, n_docs, n_tokens, root: a Merkle root of the roots of each range of doc_ids

Reading checks every chunk against its address, every recipe against its root and every range against the manifest; a mismatch fails the job.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import encoder
from .words import mix

WINDOW, MASK, LEAST, MOST = 8, 0x1FF, 128, 4096
END = 1


def cut(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """For each document the ends of its chunks: where the hash of the last ids says so, LEAST to MOST ids on."""
    table = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)).astype(np.uint32)
    value = table[ids]
    h = value.copy()
    for k in range(1, WINDOW):
        v = value[:-k] if k < len(value) else value[:0]
        h[k:] ^= (v << np.uint32(4 * k - 3)) | (v >> np.uint32(35 - 4 * k))
    marks = np.flatnonzero((h & np.uint32(MASK)) == 0) + 1
    at = np.searchsorted(marks, bounds)
    out = []
    for i in range(len(bounds) - 1):
        begin, stop, ends = int(bounds[i]), int(bounds[i + 1]), []
        last = begin
        for m in marks[at[i] : at[i + 1]].tolist():
            while m - last > MOST:
                last += MOST
                ends.append(last - begin)
            if m - last >= LEAST and m < stop:
                last = m
                ends.append(last - begin)
        while stop - last > MOST:
            last += MOST
            ends.append(last - begin)
        ends.append(stop - begin)
        out.append(ends)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256 over the leaves; an odd one goes up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def address(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _chunked(path: str, kind: str, end: int):
    """A row for each document (its recipe, key row) and for each chunk that this task sees first (key its address)."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64())), ("root", pa.binary()), ("ids", pa.binary())])

    def run(parts):
        coder = encoder(path, kind)
        row = TaskContext.get().partitionId() << 33
        seen: set[bytes] = set()
        for part in parts:
            ids, bounds = coder.encode(part.column(1).to_pylist())
            n = part.num_rows
            full = np.full(len(ids) + n, end, np.uint16)  # the end id after each document
            shift = np.arange(n + 1)
            place = np.ones(len(full), bool)
            place[bounds[1:] + shift[:-1]] = False
            full[place] = ids
            bounds = bounds + shift
            out: list[list] = [[] for _ in schema]
            raw = full.astype("<u2").tobytes()
            for i, (doc, ends) in enumerate(zip(part.column(0).to_pylist(), cut(full, bounds))):
                base, last, digests = 2 * int(bounds[i]), 0, []
                for e in ends:
                    piece = raw[base + 2 * last : base + 2 * e]
                    d = address(piece)
                    digests.append(d)
                    if d not in seen:
                        seen.add(d)
                        for column, value in zip(out, (1, d, None, None, None, None, None, piece)):
                            column.append(value)
                    last = e
                for column, value in zip(out, (0, row.to_bytes(8, "big"), doc, ends[-1], digests, ends, merkle(digests), None)):
                    column.append(value)
                row += 1
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run, "kind int, key binary, doc_id long, n_tokens long, digests array<binary>, ends array<long>, root binary, ids binary"


RANGE_ROOT = "sha2(concat_ws('', transform(array_sort(collect_list(struct(doc_id, start, hex(root) AS r))), x -> x.r)), 256)"


def write(docs: DataFrame, folder: str, path: str, kind: str = "word", end: int = END) -> None:
    """Encodes docs(doc_id, text), `end` after each document, and writes a store to the folder.

    A null or empty text is `end` alone.  Rows with equal ids are documents each; null ids come first.
    Other columns are not looked at.  An empty table makes an empty store.
    """
    spark = docs.sparkSession
    C.batches(spark)
    run, schema = _chunked(path, kind, end)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = base.mapInArrow(C.lean(run), schema)
    # one row a chunk: tasks keep the first they see, so a chunk that is everywhere reaches the reducer once a task
    pool = C.saved(rows.dropDuplicates(["kind", "key"]), "pool")
    pool.filter("kind = 1").select(F.col("key").alias("digest"), "ids").write.option("compression", "zstd").parquet(f"{folder}/chunks")
    recipes = pool.filter("kind = 0").select("doc_id", "key", "n_tokens", "digests", "ends", "root")
    starts = C.with_running_sum(recipes.select("doc_id", "key", "n_tokens"), "doc_id", ["key"], "n_tokens", "start").select(F.col("key").alias("k"), "start")
    ordered = recipes.join(starts, F.col("key") == F.col("k")).drop("k", "key")
    ordered = ordered.repartitionByRange(C.width(spark), F.col("start")).sortWithinPartitions("start")
    ordered.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    written = spark.read.parquet(f"{folder}/recipes")
    manifest = _ranges(written).groupBy("range").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.expr(RANGE_ROOT).alias("root"))
    manifest.write.parquet(f"{folder}/manifest")


def _ranges(recipes: DataFrame, size: int = 1 << 22) -> DataFrame:
    """Ranges of the store by tokens, so that each holds a bounded number of documents."""
    return recipes.withColumn("range", (F.col("start") / size).cast("long"))


@cache
def _shifts() -> list[np.ndarray]:
    """For each k, tables of what 2**k zero bytes after it make of a CRC-32, by its four bytes (the standard's polynomial)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    values = [np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)]
    tables = [np.stack([(v >> np.uint32(8)) ^ one[v & 255] for v in values])]
    for _ in range(40):
        t = tables[-1]
        tables.append(np.stack([_shifted_once(t, t[b]) for b in range(4)]))
    return tables


def _shifted_once(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def crc_before(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds (by xor) to that of the whole in which `after` bytes follow it."""
    crc = crc.astype(np.uint32)
    for k, table in enumerate(_shifts()):
        on = (after >> k) & 1 == 1
        if on.any():
            crc[on] = _shifted_once(table, crc[on])
    return crc


def _checked(parts):
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())])
    for part in parts:
        crcs, counts = [], []
        for digest, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if address(raw) != digest:
                raise ValueError(f"chunk {digest.hex()} does not match its address")
            counts.append(len(raw) // 2)
            crcs.append(zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], schema=schema)


def _recipe_checked(parts):
    for part in parts:
        for digests, root in zip(part.column("digests").to_pylist(), part.column("root").to_pylist()):
            if merkle(digests) != root:
                raise ValueError(f"recipe {root.hex()} does not match its root")
        yield part


def recipes_of(spark: SparkSession, folder: str) -> DataFrame:
    """The recipes, each checked against its root and each range against the manifest as it is read."""
    written = spark.read.parquet(f"{folder}/recipes")
    fresh = _ranges(written).groupBy("range").agg(F.expr(RANGE_ROOT).alias("now"))
    manifest = spark.read.parquet(f"{folder}/manifest").select(F.col("range").alias("r"), F.col("root").alias("then"))
    bad = fresh.join(manifest, F.col("range") == F.col("r"), "full").filter("NOT (now <=> then)").limit(1).collect()
    if bad:
        raise ValueError(f"range {bad[0]['range']} does not match the manifest")
    return written.mapInArrow(_recipe_checked, written.schema)


def digests_of(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the store's files.

    Every chunk is read and checked once; a document's CRC-32 is the xor of its chunks' ones, each shifted by the bytes after it, so chunks are not moved.
    """
    C.batches(spark)
    chunks = spark.read.parquet(f"{folder}/chunks").select("digest", "ids").mapInArrow(_checked, "digest binary, n long, crc long")
    parts = recipes_of(spark, folder).select("doc_id", "start", "n_tokens", F.explode(F.arrays_zip("digests", "ends")).alias("p"))
    parts = parts.select("doc_id", "start", F.col("p.digests").alias("d"), ((F.col("n_tokens") - F.col("p.ends")) * 4).alias("after"))

    def shifted(batches):
        for b in batches:
            crc = crc_before(b.column(3).to_numpy(), b.column(4).to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc)], names=["doc_id", "start", "n", "crc"])

    joined = parts.join(chunks, F.col("d") == F.col("digest")).select("doc_id", "start", "n", "crc", "after")
    added = joined.mapInArrow(shifted, "doc_id long, start long, n long, crc long")
    whole = added.groupBy("start", "doc_id").agg(F.sum("n").alias("n_tokens"), F.expr("bit_xor(crc)").alias("ids_crc32"))
    return whole.select("doc_id", "start", "n_tokens", "ids_crc32")


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (uint16, little endian) of every document, rebuilt from its chunks."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    parts = recipes_of(spark, folder).select("doc_id", "start", F.posexplode("digests").alias("i", "d"))
    joined = parts.join(chunks, F.col("d") == F.col("digest")).groupBy("start", "doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("p"))
    return joined.select("doc_id", "start", F.aggregate("p", F.expr("cast('' AS binary)"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def stored(docs: DataFrame, path: str, kind: str = "word", end: int = END) -> DataFrame:
    """Writes docs to a store in the shared folder and returns digests_of() it."""
    spark = docs.sparkSession
    folder = f"{C.scratch_root(spark)}/llm-{uuid.uuid4().hex[:12]}/store"
    write(docs, folder, path, kind, end)
    C.held(folder)
    return digests_of(spark, folder)
