"""MinHash near-dedup.

A document's set is its distinct 5-word shingles.  672 universal hash functions (odd multiplier
plus offset on 32-bit shingle hashes) give its minima; 96 bands of 7 minima are its buckets: two
documents of similarity 0.75 share none with probability 1e-6, of 0.8 with 2e-11.  Documents of
equal sets are one class (equal 128-bit digests of the sets), so copies never meet in buckets.

Links are found without pairing buckets up:

1. every class is held against the smallest class that it shares a bucket with,
2. then against the smallest of each of its buckets, unless already connected,
3. if some of these pairs are still in different components, the classes of those components go through an exact prefix and
   positional filter: shingles in order of rarity among them, two classes of different components
   are held against each other only if they share an early enough shingle (a class with too many
   shingles of its own meets nobody, nor do those of one component meet each other).

A candidate passes a size bound, then signature verification (512 one-bit minima, six standard
deviations below the threshold), then the exact test on the full sets.  Classes are
known by the number of one of their rows (ids may repeat), and stand in sketches and texts as that
row.  Components come from alternating large-star and small-star; every round of links works on what the earlier ones joined.
All tables in between are written to the shared folder.

Defined results: null, empty or word-less text has an empty set and no links; a row with a null
id is never linked (component null, kept); rows that repeat an id each belong to their own
text's class, and of a component all rows with its smallest id stay; all texts whole; an empty table has an empty
result; columns other than id and text take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.llm.common import located, ship_by_value
from polarity.llm.components import components
from polarity.llm.shingles import mix, shingle_sets
from polarity.session import write_table

ship_by_value(__name__)

PERCENT = 75
BANDS, ROWS = 96, 7
_BITS = 512
#: Least agreeing bits of 512 at similarity p: mean (1 + p) / 2, less six standard deviations.


def _least_bits(percent: int) -> int:
    agree = (1 + percent / 100) / 2
    return int(_BITS * agree - 6 * (_BITS * agree * (1 - agree)) ** 0.5)


def _parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Minimum of a * x + b (32 bits) over the set x for each hash function, in cache-sized blocks."""
    out = np.full(len(a), np.uint32(0xFFFFFFFF))
    step = max(1, min(len(x), 4096))
    rows = max(1, block // step)
    work = np.empty((rows, step), np.uint32)
    for s in range(0, len(x), step):
        part = x[s:s + step]
        for k in range(0, len(a), rows):
            ak = a[k:k + rows, None]
            w = work[:len(ak), :len(part)]
            np.multiply(ak, part[None, :], out=w)
            w += b[k:k + rows, None]
            np.minimum(out[k:k + rows], w.min(axis=1), out=out[k:k + rows])
    return out


def sketch_bits(m: np.ndarray) -> np.ndarray:
    """One bit of each minimum, 0 or 1.  Of the mixed minimum: the lowest bit of a * x + b is that of
    x, b alone deciding whether it is turned, so unmixed every function would tell the same of x."""
    return mix(m.astype(np.uint64)) & np.uint64(1)


def signatures(placed: DataFrame) -> DataFrame:
    """(id, file, row, n, digest, bands, s0..s7) per row (id, file, row, text): set size, 128-bit
    digest of the set, band hashes, 512 one-bit minima."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _parameters(BANDS * ROWS)
        weights = np.random.default_rng(5).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sizes, digests, bands, bits = [], [], [], []
                for s in shingle_sets(part.column(3)):
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    m = minima((s >> np.uint64(32)).astype(np.uint32), a, b)
                    bands.append(mix((m.reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64)))
                    bits.append((sketch_bits(m[:_BITS]).reshape(8, 64) * bit).sum(axis=1, dtype=np.uint64))
                bits = np.array(bits, np.uint64).reshape(-1, 8).view(np.int64)
                offsets = pa.array(np.arange(0, (len(sizes) + 1) * BANDS, BANDS, dtype=np.int32))
                flat = np.concatenate(bands).view(np.int64) if bands else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(flat)), *(pa.array(bits[:, i]) for i in range(8))],
                    names=["id", "file", "row", "n", "digest", "bands", *(f"s{i}" for i in range(8))])

    kind = placed.schema["id"].dataType.simpleString()
    sketch = ", ".join(f"s{i} bigint" for i in range(8))
    return placed.select("id", "file", "row", "text").mapInArrow(run, f"id {kind}, file string, row bigint, n bigint, digest binary, bands array<bigint>, {sketch}")


def verified(candidates: DataFrame, percent: int) -> DataFrame:
    """Of rows (u, v, u_text, v_text), the pairs whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                u, v, ut, vt = batch.slice(start, 200).columns
                keep = []
                for a, b in zip(shingle_sets(ut), shingle_sets(vt)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
                yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    kind = candidates.schema["u"].dataType.simpleString()
    return candidates.select("u", "v", "u_text", "v_text").mapInArrow(run, f"u {kind}, v {kind}")


def _confirm(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the pairs (u, v): sizes, signature, then full sets."""
    def side(df, k):
        return df.select(*[F.col(c).alias(k if c == "node" else f"{k}_{c}") for c in df.columns])

    near = pairs.join(side(sketches, "u"), "u").join(side(sketches, "v"), "v")
    agree = _BITS - sum(F.bit_count(F.col(f"u_s{i}").bitwiseXOR(F.col(f"v_s{i}"))) for i in range(8))
    near = (near.filter(100 * F.least("u_n", "v_n") >= percent * F.greatest("u_n", "v_n"))
            .filter(agree >= _least_bits(percent)).select("u", "v"))
    whole = near.join(side(texts, "u"), "u").join(side(texts, "v"), "v")
    return write_table(verified(whole, percent), "near-links")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, n, shingles) of rows (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                nodes, part = batch.slice(start, 500).columns
                sets = [x.view(np.int64) for x in shingle_sets(part)]
                yield pa.RecordBatch.from_arrays(
                    [nodes, pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                    names=["node", "n", "shingles"])

    kind = texts.schema["node"].dataType.simpleString()
    return texts.select("node", "text").mapInArrow(run, f"node {kind}, n bigint, shingles array<bigint>")


def _prefix_pairs(member: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of members (node, c) of different c that can be similar enough, by prefix, size
    and positional filter on their shingles in order of rarity."""
    sets = write_table(_sets(texts.join(member.select("node"), "node", "left_semi")).join(member, "node"), "near-sets")
    tokens = sets.select("node", F.explode("shingles").alias("token"))
    count = write_table(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "near-rarity")
    # A shingle of one member only comes first in its order and joins nothing: only its number counts.
    shared = (tokens.join(count, "token").groupBy("node")
              .agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("order")))
    ranked = write_table(
        sets.select("node", "n", "c").join(shared, "node")
        .select("node", "n", "c", F.size("order").alias("k"), F.posexplode("order").alias("p", "o"))
        .select("node", "n", "c", (F.col("k") - F.col("p")).alias("left"), F.col("o.token").alias("token"))
        .filter(100 * F.col("left") >= percent * F.col("n")), "near-prefixes")
    # Tokens of one component alone pair nobody; of the others, the classes of the token's largest component are
    # held against the rest, not against each other.
    per = ranked.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
    most = write_table(per.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.count(F.lit(1)).alias("cs"))
                       .filter("cs > 1").select("token", "most"), "near-tokens")
    ranked = write_table(ranked.join(most, "token"), "near-shared")
    x = ranked.filter("c != most").select("token", "most", *[F.col(k).alias(k + "1") for k in ("node", "n", "c", "left")])
    y = ranked.select("token", *[F.col(k).alias(k + "2") for k in ("node", "n", "c", "left")])
    return (x.join(y, "token")
            .filter((F.col("c1") != F.col("c2")) & ((F.col("c2") == F.col("most")) | (F.col("node1") < F.col("node2")))
                    & ((100 + percent) * F.least("left1", "left2") >= percent * (F.col("n1") + F.col("n2"))))
            .select(F.least("node1", "node2").alias("u"), F.greatest("node1", "node2").alias("v")).distinct())


def _merge(known: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(node, component) after new links; ``known`` maps nodes to earlier components."""
    if links.isEmpty():
        return known
    if known is None:
        return write_table(components(links), "near-comp")
    moved = write_table(components(_lift(_lift(links, known, "u"), known, "v")), "near-moved")
    nodes = known.select("node").union(links.select("u")).union(links.select("v")).distinct()
    own = _lift(nodes.withColumn("component", F.col("node")), known, "component")
    return write_table(_lift(own, moved, "component"), "near-comp")


def _lift(df: DataFrame, known: DataFrame, col: str) -> DataFrame:
    """``col`` replaced by its component where it has one."""
    names = df.columns
    m = known.select(F.col("node").alias("_node"), F.col("component").alias("_to"))
    out = df.join(m, df[col] == m["_node"], "left")
    return out.select(*[F.coalesce("_to", c).alias(c) if c == col else F.col(c) for c in names])


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n (set size), component_id, class_id (smallest id of the
    same set), file, row, kept."""
    placed = located(docs)
    file, row = placed.columns[-2:]
    placed = placed.select(F.col(id_col).alias("id"), F.col(file).alias("file"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    rows = write_table(signatures(placed).withColumn("node", F.monotonically_increasing_id()), "near-sign")
    linkable = rows.filter("n > 0 AND id IS NOT NULL")
    # Copies collapse in each task before the exchange; equal sets have equal signatures.
    classes = linkable.groupBy("digest").agg(F.min("node").alias("node"), F.first("bands").alias("bands"))
    reps = linkable.groupBy("digest").agg(F.min("node").alias("node"), F.min("id").alias("rep"))
    # The smallest of a bucket is written and joined, so that a hot bucket's rows can be split.
    low = write_table(
        linkable.select("node", F.explode("bands").alias("bucket")).groupBy("bucket")
        .agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("bucket", "first"), "near-low")
    meets = write_table(
        classes.select("node", F.explode("bands").alias("bucket")).join(low, "bucket").filter("first < node")
        .select("bucket", F.col("first").alias("u"), F.col("node").alias("v")), "near-meets")

    nodes = meets.select(F.col("u").alias("node")).union(meets.select("v")).distinct()
    one = rows.join(nodes, "node", "left_semi")        # a row for each class
    sketches = write_table(one.select("node", "n", *[f"s{i}" for i in range(8)]), "near-sketches")
    texts = write_table(placed.select("file", "row", "text").join(one.select("file", "row", "node"), ["file", "row"])
                        .select("node", "text"), "near-texts")

    first = write_table(meets.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "near-first")
    known = _merge(None, _confirm(first, sketches, texts, percent))
    if known is None:
        known = write_table(first.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0), "near-comp")

    def open_pairs(pairs):
        """The pairs whose ends are in different components."""
        both = pairs.withColumns({"cu": F.col("u"), "cv": F.col("v")})
        return _lift(_lift(both, known, "cu"), known, "cv").filter("cu != cv")

    stars = write_table(meets.select("u", "v").distinct().join(first, ["u", "v"], "left_anti"), "near-stars")
    known = _merge(known, _confirm(open_pairs(stars).select("u", "v"), sketches, texts, percent))

    # Components that some pair of classes of one bucket still holds apart: all that their classes could link to
    # is among them, so the buckets themselves are not needed again.
    apart = write_table(open_pairs(stars.union(first)).select("cu", "cv"), "near-apart")
    apart = apart.select(F.col("cu").alias("c")).union(apart.select("cv")).distinct()
    member = _lift(sketches.select("node").withColumn("c", F.col("node")), known, "c").join(apart, "c", "left_semi")
    member = write_table(member.select("node", "c"), "near-members")
    if not member.isEmpty():
        known = _merge(known, _confirm(_prefix_pairs(member, texts, percent), sketches, texts, percent))

    named = write_table(_lift(reps.withColumn("component", F.col("node")), known, "component"), "near-named")
    label = write_table(named.groupBy("component").agg(F.min("rep").alias("label")), "near-labels")
    named = write_table(named.join(label, "component").select("digest", "rep", "label"), "near-classes")
    out = linkable.select("id", "n", "digest", "file", "row").join(named, "digest")
    alone = rows.filter("n = 0 OR id IS NULL")
    return (out.select("id", "n", F.col("label").alias("component_id"), F.col("rep").alias("class_id"), "file", "row")
            .union(alone.select("id", "n", F.col("id").alias("component_id"), F.col("id").alias("class_id"), "file", "row"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that are near copies of one with a smaller id; all columns as
    they were."""
    placed = located(docs)
    file, row = placed.columns[-2:]
    lost = (near_components(placed, id_col, text_col, percent).filter("NOT kept")
            .select(F.col("file").alias(file), F.col("row").alias(row)))
    return placed.join(lost, [file, row], "left_anti").select(*[f"`{c}`" for c in docs.columns])
