"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

Counts are gathered from the whole corpus, whatever its size.  Documents are dealt into blocks; a
block explodes its texts into n-grams of all orders (64-bit hashes of lower-cased words), combines
equal ones and asks for their counts with one message for each range of hashes (the count tables'
partitions).  A partition sums up the counts of an n-gram over all blocks and joins the sums back
to what was asked; the answers meet the block's documents again, where every position takes the
highest order seen outside its own document,

    S(w | context) = alpha ** steps * count(context w) / count(context)

down to count(w) / words, and the logarithms are summed per document.  Counts leave out the document
that is scored, so a text does not vouch for itself.  Because a block sends an n-gram once however
often it holds it, a frequent n-gram weighs no more in the exchange than a rare one.  Messages are
sorted, delta-coded and compressed; the block and partition sizes grow with the square root of the
corpus, so that a message never has less than some hundred n-grams.

Defined results: null, empty or word-less text has 0 words and a null score; a word that no other
document has counts as half an occurrence; rows that repeat are documents of their own and vouch for
each other; texts are read whole; an empty table has an empty result; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.llm.common import ship_by_value, text_or_empty
from polarity.llm.shingles import hash_words, mix, utf8
from polarity.session import write_table

ship_by_value(__name__)

ORDER = 3
ALPHA = 0.4
UNSEEN = 0.5
BLOCK_BYTES = 8 << 20        # text in a block, at least
MESSAGE_BYTES = 192          # of text for each message, at least (block x partition = this x corpus)


def _pack(x: np.ndarray) -> bytes:
    """Unsigned integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def _ngrams(texts, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(document of each word, words of each document, by order the hashes of the n-grams, by order
    the words that they end at) of a block."""
    raw, bounds = utf8(texts)
    words, start = hash_words(raw, bounds)
    sizes = np.diff(np.searchsorted(start, bounds))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes, at, value = [], [], words
    for k in range(order):
        if k:   # the n-gram one word shorter that ends a word earlier, then this word
            value = np.concatenate([words[:1], value[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]])
        here = np.flatnonzero(place >= k)
        at.append(here)
        hashes.append(mix(value[here] + np.uint64(k + 1)))
    return doc, sizes, hashes, at


def _bounds(distinct: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's range of hashes begins in the sorted hashes; the end last."""
    edges = [(p << 64) // parts for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(distinct, np.array(edges, np.uint64)), [len(distinct)]]).astype(np.int64)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, text) as one compressed bundle for each block in a batch."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))
    for batch in batches:
        order = np.argsort(blocks := batch.column(0).to_numpy(), kind="stable")
        edges = np.flatnonzero(np.diff(blocks[order], prepend=-1)).tolist()
        rows = batch.select([1, 2]).take(pa.array(order))
        out = []
        for s, e in zip(edges, [*edges[1:], len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                # a copy without the rows around it
                writer.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(s, e - s)]) for c in rows.columns], schema=rows.schema))
            out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks[order][edges]), pa.array(out, pa.binary())], names=["block", "rows"])


def _unbundle(bundles: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(x.as_py()).read_all() for x in bundles["rows"])


def _requests(order: int, parts: int):
    def run(bundles: pa.Table) -> pa.Table:
        hashes = np.concatenate(_ngrams(_unbundle(bundles)["text"].combine_chunks(), order)[2])
        hashes.sort()
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[:len(hashes)])
        distinct, counts = hashes[first], np.diff(first, append=len(hashes))
        del hashes
        bounds = _bounds(distinct, parts)
        out = [(p, _pack(np.diff(distinct[s:e], prepend=np.uint64(0))), _pack(counts[s:e].astype(np.uint32)))
               for p, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if e > s]
        part, asked, count = zip(*out) if out else ((), (), ())
        return pa.table({"part": pa.array(part, pa.int64()), "block": pa.array([bundles["block"][0].as_py()] * len(out), pa.int64()),
                         "hashes": pa.array(asked, pa.binary()), "counts": pa.array(count, pa.binary())})
    return run


def _answers(rows: pa.Table) -> pa.Table:
    """Total count of every n-gram that a block asked this partition for."""
    asked = [np.cumsum(_unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in rows["hashes"]]
    counts = np.concatenate([_unpack(x.as_py(), np.uint32) for x in rows["counts"]]).astype(np.int64)
    hashes = np.concatenate(asked)
    o = np.argsort(hashes)
    s = hashes[o]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    totals = np.empty(len(o), np.uint64)
    totals[o] = np.add.reduceat(counts[o], np.flatnonzero(new))[np.cumsum(new) - 1]
    ends = np.cumsum([len(a) for a in asked])
    return pa.table({"block": rows["block"], "part": rows["part"],
                     "totals": pa.array([_pack(x) for x in np.split(totals, ends[:-1])], pa.binary())})


def _scores(order: int, alpha: float):
    def run(bundles: pa.Table, answers: pa.Table) -> pa.Table:
        block = _unbundle(bundles)
        doc, sizes, hashes, at = _ngrams(block["text"].combine_chunks(), order)
        n_docs, n = len(sizes), len(doc)
        in_order = np.argsort(np.array(answers["part"].to_pylist(), np.int64))
        totals = [_unpack(answers["totals"][int(i)].as_py(), np.uint64).astype(np.int64) for i in in_order]
        totals = np.concatenate(totals) if totals else np.empty(0, np.int64)
        hashes = np.concatenate(hashes)
        o = np.argsort(hashes).astype(np.int32)
        new = hashes[o[1:]] != hashes[o[:-1]]
        number = np.empty(len(hashes), np.int32)            # of each position's n-gram among the block's
        number[o] = np.concatenate([[0], np.cumsum(new, dtype=np.int32)])[:len(hashes)]
        n_distinct = int(new.sum()) + 1
        del hashes, o, new
        # counts outside the position's document, by order; -1 where the n-gram would begin before it
        other, start = [], 0
        for here in at:
            num = number[start:start + len(here)]
            start += len(here)
            key = doc[here] * n_distinct + num
            o = np.argsort(key)
            new = np.ones(len(key), bool)
            new[1:] = key[o][1:] != key[o][:-1]
            group = np.cumsum(new) - 1
            own = np.empty(len(key), np.int64)
            own[o] = np.bincount(group)[group] if len(key) else 0
            count = np.full(n, -1, np.int64)
            count[here] = totals[num] - own
            other.append(count)
        log_sum, by_order, top = np.zeros(n), [], np.minimum(np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1, order)
        open_ = np.ones(n, bool)
        for k in range(order, 1, -1):
            seen = np.flatnonzero(open_ & (other[k - 1] > 0))
            # the context ends a word earlier
            log_sum[seen] = np.log(other[k - 1][seen] / other[k - 2][seen - 1]) + (top[seen] - k) * math.log(alpha)
            open_[seen] = False
            by_order.append(np.bincount(doc[seen], minlength=n_docs))
        rest = np.flatnonzero(open_)
        log_sum[rest] = np.log(np.maximum(other[0][rest], UNSEEN)) + (top[rest] - 1) * math.log(alpha)
        by_order.append(np.bincount(doc[rest], minlength=n_docs))
        unseen = np.bincount(doc[rest[other[0][rest] == 0]], minlength=n_docs)
        return pa.table({"id": block["id"], "n_words": pa.array(sizes),
                         "log_sum": pa.array(np.bincount(doc, weights=log_sum, minlength=n_docs).astype(np.float64)),
                         "n_unseen": pa.array(unseen.astype(np.int64)),
                         "by_order": pa.array([x.tolist() for x in np.stack(by_order, 1).astype(np.int64)], pa.list_(pa.int64()))})
    return run


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                   alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, by_order (positions scored by the highest order
    ... by single words), n_unseen, log_score (sum of logarithms), score (its mean per word)."""
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    each = max(block_bytes, math.isqrt(MESSAGE_BYTES * size))
    blocks = parts = size // each + 1
    dealt = (docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).alias("block"), F.col(id_col).alias("id"),
                         text_or_empty(text_col).alias("text"))
             .mapInArrow(_bundle, "block bigint, rows binary"))
    asked = dealt.groupBy("block").applyInArrow(_requests(order, parts), "part bigint, block bigint, hashes binary, counts binary")
    told = asked.groupBy("part").applyInArrow(_answers, "block bigint, part bigint, totals binary")
    kind = docs.schema[id_col].dataType.simpleString()
    sums = write_table(dealt.groupBy("block").cogroup(told.groupBy("block"))
                       .applyInArrow(_scores(order, alpha), f"id {kind}, n_words bigint, log_sum double, n_unseen bigint, by_order array<bigint>"), "lm-sums")
    words = sums.agg(F.sum("n_words")).first()[0] or 0
    others = F.greatest(F.lit(words) - F.col("n_words"), F.lit(1)).cast("double")
    log_score = F.when(F.col("n_words") > 0, F.col("log_sum") - F.element_at("by_order", order) * F.log(others))
    return sums.select("id", "n_words", "by_order", "n_unseen", log_score.alias("log_score"),
                       (log_score / F.col("n_words")).alias("score"))
