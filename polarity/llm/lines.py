"""Line dedup: an exact set-similarity join of all lines, later matches removed.

A line's tokens are its distinct 5-word shingles (the whole line if it has fewer words).  Tokens are
ordered by rarity: a table of 2**20 slots holds the counts of tokens that a task meets
clearly more often than others, summed by Spark (the table's size does not grow; any order gives the same result, the counts make it quick).  Lines of equal sets become one
class before anything is paired, so a line that a third of all documents hold is one row; classes are numbered by
their first lines (by document, then line number).  A class enters the join with the tokens of its prefix; candidates share one of
them and pass the length and the positional filter and an exact bound from 256-bit maps of their sets (a bit that one set lacks is a
token that it lacks); their full token sets, read again from the documents, decide Jaccard similarity.

All links are found: every pair of similar classes is confirmed once, so a class knows how many other classes it is similar to
and the earliest of them.  A line is removed if an earlier line is similar to it.  Copies are not expanded into pairs; a family of
many different near-equal lines costs a candidate a pair of its classes, which is what its links are.

Defined results: null and empty texts have no lines; lines without words have no tokens, no links and
stay; a null id orders before all others; rows that repeat an id are documents of their own (their
lines follow in a fixed order of files and rows); texts and lines are read whole; an
empty table has an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.llm.common import fresh_names, located, ship_by_value, text_or_empty
from polarity.llm.shingles import group_shingles, hash_words, mix, shingle_sets, utf8
from polarity.session import remove_path, settings, table_path, write_table

ship_by_value(__name__)

PERCENT = 75
SLOTS = 1 << 20
_MAPS = ("m0", "m1", "m2", "m3")


def line_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lines of some texts: (text of each line, line of each token, token hashes), tokens in
    reading order, repeats included."""
    raw, bounds = utf8(texts)
    h, start = hash_words(raw, bounds)
    ends = np.flatnonzero(raw == 10)
    # a line begins with each text and behind each line end
    of_text = np.searchsorted(ends, bounds[:-1]) + np.arange(len(texts))        # first line of each text
    n_lines = len(ends) + len(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(of_text, n_lines)))
    line = np.searchsorted(ends, start) + np.searchsorted(bounds[:-1], start, "right") - 1
    group, tokens = group_shingles(h, np.bincount(line, minlength=n_lines))
    return owner, group, tokens


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)


def _parts(batches, size: int = 400):
    for b in batches:
        for s in range(0, b.num_rows, size):
            yield b.slice(s, size)


def _by_rarity(line: np.ndarray, tokens: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each line by rarity, then hash."""
    # line, rank of the slot's count, leading bits of the hash in one sortable number
    rank = rarity[_slot(tokens)].astype(np.uint64)
    key = (line.astype(np.uint64) << np.uint64(44)) | (rank << np.uint64(37)) | (tokens >> np.uint64(27))
    o = np.argsort(key)
    a, t = key[o], tokens[o]
    if (line[-1:] >= 1 << 20).any() or ((a[1:] == a[:-1]) & (t[1:] != t[:-1])).any():      # the number does not tell all
        o = np.lexsort((tokens, rank, line))
        t = tokens[o]
    line = line[o]
    new = np.ones(len(line), bool)
    new[1:] = (t[1:] != t[:-1]) | (line[1:] != line[:-1])
    return line[new], t[new]


def token_rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank (0 to 127, half steps of the logarithm) of the number of tokens of all lines in each of ``SLOTS`` slots: one array of
    fixed size.  A task sends the slots that stand out from its mean load (more than twice that and two); the others rank as rare."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for part in _parts(batches):
            slots, n = np.unique(_slot(line_tokens(part.column(0))[2]), return_counts=True)
            total[slots] += n
        some = np.flatnonzero(total > 2 * total.mean() + 2)
        for s in range(0, len(some), 1 << 16):
            at = some[s:s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    sums = docs.select(text_col).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    rank = F.least(F.floor(2 * F.log2(F.col("n") + 1)), F.lit(127)).cast("tinyint")
    with settings(docs.sparkSession):
        told = sums.filter("n > 1").select("slot", rank.alias("rank")).toArrow()          # at most SLOTS rows of 5 bytes
    out = np.zeros(SLOTS, np.uint8)
    out[told["slot"].to_numpy()] = told["rank"].to_numpy()
    return out


def _line_rows(rarity, percent: int):
    """Rows (id, file, row, line, n, a, b, m0..m3, prefix): the line's place, number of tokens, 128-bit
    digest and 256-bit map of its set, and prefix tokens in order of rarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = rarity.value
        for part in _parts(batches):
            owner, line, tokens = line_tokens(part.column(3))
            n_lines = len(owner)
            number = np.arange(n_lines) - np.searchsorted(owner, owner)
            line, tokens = _by_rarity(line, tokens, ranks)
            n = np.bincount(line, minlength=n_lines)
            digest = []
            for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                total = np.zeros(n_lines, np.uint64)
                some = n > 0
                if some.any():
                    total[some] = np.add.reduceat(mix(tokens + np.uint64(salt)), (np.cumsum(n) - n)[some])
                digest.append(total.view(np.int64))
            bit, word, maps = np.uint64(1) << (tokens & np.uint64(63)), (tokens >> np.uint64(6)) & np.uint64(3), []
            for k in range(4):
                total = np.zeros(n_lines, np.uint64)
                if some.any():
                    total[some] = np.bitwise_or.reduceat(np.where(word == k, bit, np.uint64(0)), (np.cumsum(n) - n)[some])
                maps.append(total.view(np.int64))
            keep = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            in_prefix = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(keep, n)
            offsets = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(number), pa.array(n),
                 *map(pa.array, digest + maps), pa.ListArray.from_arrays(offsets, pa.array(tokens[in_prefix].view(np.int64)))],
                names=["id", "file", "row", "line", "n", "a", "b", *_MAPS, "prefix"])
    return run


def _sets(wanted: DataFrame, kind: str) -> DataFrame:
    """(class, tokens) of rows (text, asked: array of (line, class))."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts([b], 1000):
                asked = part.column(1).to_pylist()
                lines = [t.split("\n") for t in part.column(0).to_pylist()]
                chosen = [x[a["line"]] for x, of in zip(lines, asked) for a in of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a["class"] for of in asked for a in of], pa.int64()),
                     pa.array([x.view(np.int64) for x in shingle_sets(pa.array(chosen, pa.string()))], pa.list_(pa.int64()))],
                    names=["class", "tokens"])

    return wanted.mapInArrow(run, kind)


def _possible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose maps leave enough tokens that both can have."""
    def side(k):
        return maps.select(F.col("class").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("n", *_MAPS)])

    def both(k, other):        # tokens of k that the other may have
        lacking = sum(F.bit_count(F.col(f"{k}_{m}").bitwiseAND(F.bitwise_not(f"{other}_{m}"))) for m in _MAPS)
        return F.col(f"{k}_n") - lacking

    joined = pairs.join(side("u"), "u").join(side("v"), "v")
    return (joined.filter((100 + percent) * F.least(both("u", "v"), both("v", "u")) >= percent * (F.col("u_n") + F.col("v_n")))
            .select("u", "v"))


def _similar(candidates: DataFrame, percent: int) -> DataFrame:
    """Of rows (u, v, u_tokens, v_tokens), the pairs whose sets are similar enough."""
    both = F.size(F.array_intersect("u_tokens", "v_tokens"))
    return candidates.filter(100 * both >= percent * (F.size("u_tokens") + F.size("v_tokens") - both)).select("u", "v")


def _drop(*tables: DataFrame) -> None:
    for t in tables:
        remove_path(t.sparkSession, table_path(t))


def _links(classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(class, earlier, links): every class that is similar to others, with the earliest before it (or null) and their number."""
    # size and place of a token in one number: the index is the largest thing that is exchanged
    entry = (classes.select("class", "n", F.posexplode("prefix").alias("p", "token"))
             .select("token", "class", F.shiftleft("n", 32).bitwiseOR(F.col("p").cast("bigint")).alias("np")))
    # tokens of one class pair nobody; the others are few, so the whole index is exchanged once, and gone before the next step
    several = write_table(entry.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token"), "line-several")
    shared = write_table(entry.join(several, "token"), "line-shared")
    _drop(several)
    ends = shared.select("class").distinct()
    asked = (classes.join(ends, "class", "left_semi")
             .groupBy(F.col("first.file").alias("file"), F.col("first.row").alias("row"))
             .agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "class")).alias("asked")))
    sets = write_table(_sets(texts.join(asked, ["file", "row"]).select("text", "asked"), "class bigint, tokens array<bigint>"), "line-sets")
    maps = classes.select("class", "n", *_MAPS)

    def size(np_):
        return F.shiftright(np_, 32)

    def left(np_):        # tokens of the prefix's line from this one on
        return size(np_) - np_.bitwiseAND(F.lit((1 << 32) - 1))

    def fits(a, b):
        return ((100 * F.least(size(a), size(b)) >= percent * F.greatest(size(a), size(b)))
                & ((100 + percent) * F.least(left(a), left(b)) >= percent * (size(a) + size(b))))

    u, v = (shared.select("token", F.col("class").alias(k), F.col("np").alias(f"{k}np")) for k in ("u", "v"))
    pairs = write_table(u.join(v, "token").filter((F.col("u") < F.col("v")) & fits(F.col("unp"), F.col("vnp"))).select("u", "v").distinct(), "line-pairs")
    possible = write_table(_possible(pairs, maps, percent), "line-possible")
    _drop(shared, pairs)
    u, v = (sets.select(F.col("class").alias(k), F.col("tokens").alias(f"{k}_tokens")) for k in ("u", "v"))
    found = write_table(_similar(possible.join(u, "u").join(v, "v"), percent), "line-pairs-similar")
    _drop(possible, sets)
    both = (found.select(F.col("v").alias("class"), F.col("u").alias("earlier"))
            .unionByName(found.select(F.col("u").alias("class"), F.lit(None).cast("bigint").alias("earlier"))))
    out = write_table(both.groupBy("class").agg(F.min("earlier").alias("earlier"), F.count(F.lit(1)).alias("links")), "line-links")
    _drop(found)
    return out


def similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per line that has words: id, file (its path's 64-bit hash), row, line (from 0), class_id (equal
    for lines of equal sets; in order of the classes' first lines), n_tokens, n_copies (lines in the class), n_links (other classes
    similar to this one), earlier_class (the earliest of them whose first line comes before this one's first; null if there is none), removed."""
    spark = docs.sparkSession
    placed = located(docs)
    file, row = placed.columns[-2:]
    texts = placed.select(F.col(id_col).alias("id"), F.xxhash64(file).alias("file"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    rarity = spark.sparkContext.broadcast(token_rarity(texts.select("text"), "text"))
    kind, maps = docs.schema[id_col].dataType.simpleString(), ", ".join(f"{m} bigint" for m in _MAPS)
    lines = texts.mapInArrow(_line_rows(rarity, percent), f"id {kind}, file bigint, row bigint, line bigint, n bigint, a bigint, b bigint, {maps}, prefix array<bigint>").filter("n > 0")
    wide = write_table(lines, "lines")
    place = F.struct("id", "file", "row", "line")
    grouped = wide.groupBy("a", "b").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"),
                                         F.first("prefix").alias("prefix"), *[F.first(m).alias(m) for m in _MAPS])
    # ranges and sorted within them: a class's number tells its place
    classes = write_table(grouped.repartitionByRange("first").sortWithinPartitions("first").withColumn("class", F.monotonically_increasing_id()), "line-classes")
    narrow = write_table(wide.select("id", "file", "row", "line", "n", "a", "b"), "line-places")
    _drop(wide)
    linked = _links(classes, texts, percent)
    known = write_table(classes.select("a", "b", "class", "first", "copies").join(linked, "class", "left"), "line-known")
    _drop(classes, linked)
    return (narrow.join(known, ["a", "b"])
            .select("id", "file", "row", "line", F.col("class").alias("class_id"), F.col("n").alias("n_tokens"), F.col("copies").alias("n_copies"),
                    F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.col("earlier").alias("earlier_class"),
                    (F.col("earlier").isNotNull() | (F.col("first") < F.struct("id", "file", "row", "line"))).alias("removed")))


def drop_later_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with the removed lines taken out of the text; all columns and rows stay (a null text
    stays null)."""
    placed = located(docs)
    file, row = placed.columns[-2:]
    lost, place = fresh_names(placed, "_lost", "_place")
    gone = (similar_lines(placed, id_col, text_col, percent).filter("removed")
            .groupBy(F.col("file").alias(place), F.col("row").alias(row)).agg(F.collect_set("line").alias(lost)))
    out = placed.withColumn(place, F.xxhash64(file)).join(gone, [place, row], "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(lost), i.cast("bigint"))), "\n")
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(kept)
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
