"""Packing documents into training sequences in the order of a space-filling curve.

Each document's token ids are hashed to a vector (the mean of a random direction for each id), projected to
three dimensions and placed on a Hilbert curve.  Documents are ordered along it by range, laid end to end,
and cut every `length` ids; what is left at the end is cut at powers of two, so no sequence is padded.
Neighbours on the curve share sequences.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import encoder

LENGTH, END, DIMENSIONS, BITS, SEED = 1024, 0, 3, 10, 11


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of points, whole numbers of `bits` bits.

    From coordinates to the transposed index as J. Skilling gives it (Programming the Hilbert curve, 2004).
    """
    x = [points[:, i].astype(np.uint64) for i in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(len(x)):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(points), np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & np.uint64(q)) > 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    key = np.zeros(len(points), np.uint64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << np.uint64(1)) | (((v ^ flip) >> np.uint64(b)) & np.uint64(1))
    return key


@cache
def _directions(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((1 << 16, DIMENSIONS)).astype(np.float32)


def curve_keys(ids: np.ndarray, bounds: np.ndarray, doc: np.ndarray, seed: int = SEED) -> np.ndarray:
    """30 bits of the curve and 23 of the document's hash, so that equal vectors do not make one key."""
    directions = _directions(seed)
    n = np.diff(bounds)
    mean = np.zeros((len(n), DIMENSIONS))
    full = n > 0
    for d in range(DIMENSIONS):
        total = np.append(0.0, np.cumsum(directions[ids, d], dtype=np.float64))
        mean[full, d] = ((total[bounds[1:]] - total[bounds[:-1]])[full]) / n[full]
    cell = np.minimum((1 << BITS) - 1, ((1 << BITS) / (1 + np.exp(-8 * mean))).astype(np.int64))
    return ((hilbert(cell, BITS) << np.uint64(23)) | (doc & np.uint64((1 << 23) - 1))).astype(np.int64)


def encoded(docs: DataFrame, path: str, kind: str, end: int) -> DataFrame:
    """row, doc_id, key, n, ids (uint16, little endian, with the end id) for each row of docs(doc_id, text), as a work table."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(parts):
        from .words import mix

        coder = encoder(path, kind)
        row = TaskContext.get().partitionId() << 33
        for part in parts:
            ids, bounds = coder.encode(part.column(1).to_pylist())
            m = part.num_rows
            rows = np.arange(row, row + m, dtype=np.int64)
            row += m
            name = pa.compute.fill_null(part.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            key = curve_keys(ids, bounds, mix(name))
            raw, tail = ids.astype("<u2").tobytes(), np.array([end], "<u2").tobytes()
            cut = (bounds * 2).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), part.column(0), pa.array(key), pa.array(np.diff(bounds) + 1), pa.array([raw[a:b] + tail for a, b in zip(cut, cut[1:])], pa.binary())],
                schema=schema,
            )

    C.batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return C.saved(base.mapInArrow(C.lean(run), "row long, doc_id long, key long, n long, ids binary"), "ids")


def cuts_after(total: int, length: int) -> list[int]:
    """Where the sequences of the rest that does not fill a whole one begin: one for each bit of its size."""
    rest, at, out = total % length, total - total % length, []
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append(at)
        at, rest = at + size, rest - size
    return out


def pack(docs: DataFrame, path: str, kind: str = "byte", length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (uint16).

    A document is its text's ids and `end`; a null or empty text is `end` alone.  Rows with equal ids are
    packed each; other columns are not looked at.  An empty table gives an empty result.
    """
    table = encoded(docs, path, kind, end)
    placed = C.saved(C.with_running_sum(table.select("row", "key", "n"), "key", ["row"], "n", "position").select(F.col("row").alias("r"), "position"), "positions")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    begins = np.array(cuts_after(total, length), np.int64)
    full = total // length
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(parts):
        for part in parts:
            out: list[list] = [[] for _ in schema]
            for doc, n, raw, at in zip(*(part.column(i).to_pylist() for i in range(4))):
                wide = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                start = 0
                while start < n:
                    p = at + start
                    if p < full * length:
                        seq, first, last = p // length, p - p % length, p - p % length + length
                    else:
                        k = int(np.searchsorted(begins, p, "right")) - 1
                        seq, first, last = full + k, int(begins[k]), int(begins[k + 1]) if k + 1 < len(begins) else total
                    size = min(n - start, last - p)
                    row = (doc, start, size, zlib.crc32(wide[4 * start : 4 * (start + size)]), n, seq, p - first, raw[2 * start : 2 * (start + size)])
                    for column, value in zip(out, row):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    # a sort-merge join at every size: the places of all rows are no side to broadcast
    joined = table.select("row", "doc_id", "n", "ids").join(placed.hint("merge"), F.col("row") == F.col("r")).select("doc_id", "n", "ids", "position")
    return joined.mapInArrow(run, ddl)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n, ids (uint16 end to end) of the pieces that pack() gives with ids."""
    ordered = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.expr("cast('' AS binary)"), lambda a, p: F.concat(a, p["ids"]))
    return ordered.select("sequence_id", "n", joined.alias("ids"))
