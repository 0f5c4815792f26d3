"""Best-fit packing of token sequences, exact complements first.

Documents become pieces of at most ``capacity`` tokens.  Which lengths share a sequence is
decided on the histogram of lengths alone (at most ``capacity`` numbers, whatever the corpus):
for each length, longest first, an index of single lengths, pair sums and triple sums gives
combinations that fill the rest exactly, and each is consumed as often as the availability
counts allow; what is left is packed best-fit, longest first, counts at a time.  The outcome is a
short list of slots (a range of ranks within a length -> sequences and offset), and every
piece finds its slot by its rank within its length, which a distributed ranking gives.

Defined results: null text counts as empty (a document of the end token alone); each row is a
document, repeated ids included; very long texts are cut into pieces and packed like others; an
empty table gives no pieces; other columns take no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.llm.common import ship_by_value
from polarity.llm.ranking import rank_within
from polarity.session import write_table

ship_by_value(__name__)

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"       # the vocabulary that defines the ids
RANKS = "byte_bpe_50k.tiktoken"       # the same vocabulary as merge ranks

# Characters whose classes are the same in all versions of Unicode that the two libraries use.
_SETTLED = re.compile("[^\x00-ɏ‐-‧₠-₵]")


class Encoder:
    """Text -> ids of the tokenizer file.  Where the merge ranks are given, texts of settled
    characters are encoded from them (the same ids at a quarter of the time)."""

    def __init__(self, tokenizer: str, ranks: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(tokenizer), None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding(tokenizer, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)

    @classmethod
    def shared(cls, tokenizer: str, ranks: str | None) -> Encoder:
        """One for each worker process, kept for its later tasks."""
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
        if (tokenizer, ranks) not in kept:
            kept[tokenizer, ranks] = cls(tokenizer, ranks)
        return kept[tokenizer, ranks]

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and (text.isascii() or not _SETTLED.search(text)):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:      # its pattern gives up on very long runs of blanks
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cuts(n: int, capacity: int) -> list[int]:
    """Bounds of the pieces of n tokens: full pieces, a shorter one first if need be."""
    return [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) per piece; ids little-endian unsigned 32-bit."""
    if tokenizer is None:
        tokenizer, ranks = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.shared(tokenizer, ranks)
        for b in batches:
            owner, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = np.append(encode(t.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for k, (s, e) in enumerate(pairwise(cuts(len(ids), capacity))):
                    part = ids[s:e].tobytes()
                    owner.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(part)
            cols = [b.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def _complement(avail: np.ndarray, gap: int, pairs: np.ndarray) -> Counter | None:
    """One to three available lengths that sum to ``gap`` exactly, large ones first.
    ``pairs`` tells which sums two available lengths can have (it may name some too many)."""
    def enough(parts):
        need = Counter(parts)
        return need if all(avail[x] >= k for x, k in need.items()) else None

    def pair(total, top):
        a = np.arange(min(total - 1, top), (total + 1) // 2 - 1, -1)
        for x in a[(avail[a] > 0) & (avail[total - a] > 0)]:
            yield int(x), int(total - x)

    if avail[gap]:
        return Counter([gap])
    if pairs[gap]:
        for x, y in pair(gap, gap):
            if found := enough((x, y)):
                return found
    a = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
    for x in a[(avail[a] > 0) & pairs[gap - a]]:
        for y, z in pair(gap - int(x), int(x)):
            if found := enough((int(x), y, z)):
                return found
    return None


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(lengths with how many of each go into a sequence, number of such sequences)]."""
    avail = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        avail[length] = n
    plan = []

    def pair_sums():
        there = (avail[1:] > 0).astype(np.float64)
        sums = np.zeros(capacity + 1, bool)
        if there.any():
            size = 2 * len(there)
            both = np.fft.irfft(np.fft.rfft(there, size) ** 2, size)     # sums of indexes, each + 1
            n = min(len(both), capacity - 1)
            sums[2:2 + n] = both[:n] > 0.5
        return sums

    pairs = pair_sums()
    for length in range(capacity, 0, -1):
        while avail[length]:
            avail[length] -= 1
            rest = _complement(avail, capacity - length, pairs) if length < capacity else Counter()
            avail[length] += 1
            if rest is None:
                break
            rest[length] += 1
            times = int(min(avail[x] // k for x, k in rest.items()))
            for x, k in rest.items():
                avail[x] -= times * k
            plan.append((dict(rest), times))
        pairs = pair_sums() if length % 64 == 0 else pairs

    # Best fit of the rest: open sequences by the room they have left.
    room: dict[int, list] = {}
    for length in range(capacity, 0, -1):
        left = int(avail[length])
        while left:
            gaps = [g for g, of in room.items() if g >= length and of]
            gap = min(gaps) if gaps else capacity
            each = gap // length
            if gaps:
                content, times = room[gap].pop()
            else:
                content, times = {}, max(1, left // each)
            take = min(times, left // each)
            each = each if take else left           # the last ones do not fill even one sequence
            take = take or 1
            if times > take:
                room.setdefault(gap, []).append((content, times - take))
            room.setdefault(gap - each * length, []).append((content | {length: each}, take))
            left -= each * take
    return plan + [x for of in room.values() for x in of]


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of this length in each, offset)."""
    used, sequence, out = Counter(), 0, []
    for content, times in plan:
        offset = 0
        for length in sorted(content, reverse=True):
            each = content[length]
            out.append((length, used[length], used[length] + each * times, sequence, each, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a stored table of pieces) with the sequence and place of every piece."""
    spark = cut.sparkSession
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}     # at most capacity rows
    table = slots(packing_plan(counts, capacity))
    where = spark.createDataFrame(table, "slot_length bigint, lo bigint, hi bigint, sequence bigint, each bigint, at bigint")
    ranked = rank_within(cut, "length", ["id", "piece"], "rank")
    # A slot for each length of each pattern: bounded by the capacity, not by the corpus.
    placed = ranked.join(F.broadcast(where), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    turn = F.col("rank") - F.col("lo")
    return placed.select(*cut.columns, (F.col("sequence") + F.floor(turn / F.col("each"))).alias("sequence_id"),
                         (F.col("at") + (turn % F.col("each")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   with_ids: bool = False, **tokenizer) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    cut = write_table(pieces(docs, id_col, text_col, capacity, with_ids=with_ids, **tokenizer), "pieces")
    return pack(cut, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pieces packed with their ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), inside.alias("p"))
            .select("sequence_id", "length", F.expr("aggregate(p.ids, X'', (a, b) -> concat(a, b))").alias("ids")))
