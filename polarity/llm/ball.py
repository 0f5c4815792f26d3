"""Vector codes by product quantisation, the codebooks trained with ball k-means.

A vector is cut into equal consecutive parts; every part position has a codebook of its own, and a vector's
code is the number of each part's nearest entry.  All arithmetic is on integers (components times ``SCALE``,
floored), so results are exact and do not depend on how rows are dealt.

Ball k-means: the parts assigned to an entry are its ball, the largest distance of one its radius r.
Another entry can be as near to a part of the ball only if it is at most 2 r away: these are the ball's
neighbours.  A part at distance d of its entry is in the stable core if no neighbour is within 2 d, and
keeps its entry without another distance; else it lies in the ring between the m-th and the next
neighbour (by their distance) and is held against the m nearest ones alone.  Distances that tie count as
near, so the lower entry wins exactly as over all entries.  Balls are taken over the rows of a batch: a part's
candidates are those of its own distance either way, and no pass over the table is spent on radii.

A round reads the vectors with the codes of the round before, writes them with new codes into the
shared folder and sums every entry's parts there by partial aggregation; entries (a number fixed by the parameters, not by
the data) are all that the driver sees.  The table before is deleted once its successor is written.

Defined results: vectors that are null or empty, hold null or non-finite components, cannot be cut into equal parts, or have another
length than the kept vector of the smallest id are left out; rows that repeat an id are vectors of their own (of equal ids the
least vector comes first, null ids come last); with fewer vectors than entries the codebooks are as large as the table; an empty table has an
empty result (and no codebooks); other columns take no part.  A component beyond what exact 64-bit distances allow (about 23,000 at 64 components) raises
a ValueError; none is clipped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.llm.common import ship_by_value
from polarity.session import remove_path, table_path, write_table

ship_by_value(__name__)

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def quantised(rows: DataFrame, key: str, vector: str, label: str, parts: int) -> DataFrame:
    """(id, label, v array<int>) of the rows that are kept, not yet held against the common length."""
    v = F.col(vector)
    sound = (v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0)
             & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    limit = F.floor(F.sqrt(F.lit(float(1 << 59)) / F.size(v))) - 1          # four times a squared distance stays below 2**63
    fits = F.forall(v, lambda x: F.abs(x.cast("double") * SCALE) < F.least(limit, F.lit(1 << 30)).cast("double"))
    checked = F.when(fits, scaled).otherwise(F.raise_error(F.lit("component too large for exact distances")).cast("array<bigint>"))
    return rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.when(sound, checked).cast("array<int>").alias("v")).filter("v IS NOT NULL")


class Balls:
    """The neighbours of every entry of a codebook [entry, component] by distance."""

    def __init__(self, book: np.ndarray):
        self.book = book
        apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, -1)                                         # the entry itself comes first and is cut off
        self.near = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.near, axis=1)

    def assign(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest entry, squared distance, distances computed) of parts x [row, component] that had the entries ``code``."""
        own = ((x - self.book[code]) ** 2).sum(axis=1)
        radius = np.zeros(len(self.book), np.int64)
        np.maximum.at(radius, code, own)
        neighbours = int((self.apart <= 4 * radius[:, None]).sum(axis=1).max(initial=0))        # of the ball that reaches most
        best, least, done = code.copy(), own.copy(), len(x)
        live = np.arange(len(x))
        for t in range(neighbours):
            live = live[self.apart[code[live], t] <= 4 * own[live]]         # those whose ring lies beyond the t-th neighbour
            if not len(live):
                break
            other = self.near[code[live], t]
            d = ((x[live] - self.book[other]) ** 2).sum(axis=1)
            done += len(live)
            wins = (d < least[live]) | ((d == least[live]) & (other < best[live]))
            at = live[wins]
            best[at], least[at] = other[wins], d[wins]
        return best, least, done


def _cut(vectors: pa.Array, parts: int) -> np.ndarray:
    """[part, row, component] of a list column."""
    flat = vectors.flatten().to_numpy().astype(np.int64)
    return flat.reshape(len(vectors), parts, -1).transpose(1, 0, 2)


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` (id, label, v, code binary) with the codes of these codebooks [part, entry, component] and
    ``error``, the sum of squared distances to them."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            old = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(-1, parts).astype(np.int64)
            new, error = np.empty((batch.num_rows, parts), np.uint16), np.zeros(batch.num_rows, np.int64)
            for p, x in enumerate(_cut(batch.column(2), parts)):
                new[:, p], d, _ = balls[p].assign(x, old[:, p])
                error += d
            codes = pa.array([r.tobytes() for r in new], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], codes, pa.array(error)], names=["id", "label", "v", "code", "error"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label", "v"))
    return rows.select("id", "label", "v", "code").mapInArrow(run, f"{kinds}, code binary, error bigint")


def entry_sums(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): number and component sums of the parts of every entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, parts).astype(np.int64)
            for p, x in enumerate(_cut(batch.column(0), parts)):
                entries, index = np.unique(code[:, p], return_inverse=True)
                total = np.zeros((len(entries), width), np.int64)
                np.add.at(total, index, x)
                n = np.bincount(index)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entries), p)), pa.array(entries), pa.array(n), *map(pa.array, total.T)],
                                                 names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    names = [f"s{i}" for i in range(width)]
    sums = rows.select("v", "code").mapInArrow(run, "part bigint, entry bigint, n bigint, " + ", ".join(f"{c} bigint" for c in names))
    # sums may pass 64 bits on many large components
    return sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names])


def _moved(books: np.ndarray, sums: list, width: int) -> np.ndarray:
    """The codebooks of floored means; an entry without parts stays."""
    out = books.copy()
    for r in sums:
        out[r.part, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return out


class Codebooks:
    """[part, entry, component] integers, and their digest."""

    def __init__(self, books: np.ndarray):
        self.books = books

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """((id, label, v, code array<int>, error), codebooks) of the kept rows; (empty frame, None) if there are none."""
    spark = rows.sparkSession
    sound = write_table(quantised(rows, key, vector, label, parts), "ball-vectors")
    low = sound.orderBy(F.asc_nulls_last("id"), "v").limit(1).select(F.size("v").alias("size")).collect()
    if not low:
        none = sound.select("id", "label", "v", F.array().cast("array<int>").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return none, None
    size = low[0]["size"]
    width = size // parts
    first = sound.filter(F.size("v") == size).orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()        # the first entries: a parameter
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    zero = bytes(2 * parts)
    now = sound.filter(F.size("v") == size).withColumn("code", F.lit(zero))
    table = sound
    for _ in range(rounds):
        found = write_table(assigned(now, books).drop("error"), "ball-round")
        books = _moved(books, entry_sums(found, parts, width).collect(), width)                # parts x entries rows
        remove_path(spark, table_path(table))
        now = table = found
    # two little-endian bytes a part
    hexed = F.hex("code")
    code = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.conv(
        F.concat(F.substring(hexed, i * 4 + 3, F.lit(2)), F.substring(hexed, i * 4 + 1, F.lit(2))), 16, 10).cast("int"))
    out = write_table(assigned(now, books).select("id", "label", "v", code.alias("code"), "error"), "ball-codes")
    remove_path(spark, table_path(table))
    return out, Codebooks(books)


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the error summed over equal labels (nulls are equal); sums beyond 64 bits stop at the largest."""
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    told = codes.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("bigint").alias("label_error"))
    return codes.join(told, codes["label"].eqNullSafe(told["_label"])).drop("_label")
