"""Rows dealt out by a column as packed chunks.

A shuffle of n-gram rows holds every string, key and count once a row.  Here a task sorts a bounded number of rows at a time and puts those
that go to the same partition into one compressed value: distinct values once, small codes, differences of sorted numbers.  Spark shuffles these
values, at less than half of the bytes, and a partition's rows, a bounded share of the input, are joined, summed or collected as an Arrow table.
"""

from __future__ import annotations

import pickle
import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

# packing travels with its tasks: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART = "_part"
CHUNK_ROWS = 1 << 21            # rows that a task holds to pack them
SAMPLE_PER_PART = 50            # rows drawn for each range to be found

_INTS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def _small(x: np.ndarray) -> tuple[int, bytes]:
    """Non-negative numbers in the fewest bytes, the lowest byte of all first."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in _INTS if top < 1 << 8 * w)
    return width, np.ascontiguousarray(x.astype(_INTS[width]).view(np.uint8).reshape(-1, width).T).tobytes()


def _unsmall(stored: tuple[int, bytes]) -> np.ndarray:
    width, raw = stored
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(_INTS[width]).ravel()


def _steps(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers as differences, the sign in the lowest bit."""
    d = np.diff(x.astype(np.int64), prepend=np.int64(0))
    return _small(((d << 1) ^ (d >> 63)).view(np.uint64))


def _unsteps(stored: tuple[int, bytes]) -> np.ndarray:
    u = _unsmall(stored).astype(np.uint64)
    return np.cumsum((u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64))


def _values(x: pa.Array):
    """Distinct values, one of which may be null."""
    null = int(np.flatnonzero(x.is_null().to_numpy(zero_copy_only=False))[0]) if x.null_count else -1
    if pa.types.is_string(x.type):
        bounds = np.frombuffer(x.buffers()[1], np.int32)[x.offset:x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int32)
        data = x.buffers()[2]
        return "s", null, _small(np.diff(bounds)), data.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_pybytes() if data else b""
    if pa.types.is_signed_integer(x.type):
        return "i", null, _steps(x.fill_null(0).to_numpy())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", x.type)])) as out:
        out.write_batch(pa.record_batch([x], names=["x"]))
    return "a", null, sink.getvalue().to_pybytes()


def _unvalues(stored, kind: pa.DataType) -> pa.Array:
    how, null, *rest = stored
    if how == "a":
        return pa.ipc.open_stream(rest[0]).read_all()["x"].combine_chunks()
    if how == "i":
        x = _unsteps(rest[0])
        return pa.array(x, mask=np.arange(len(x)) == null).cast(kind)
    size = _unsmall(rest[0])
    bounds = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype(np.int32)
    valid = pa.py_buffer(np.packbits(np.arange(len(size)) != null, bitorder="little").tobytes()) if null >= 0 else None
    return pa.Array.from_buffers(pa.string(), len(size), [valid, pa.py_buffer(bounds.tobytes()), pa.py_buffer(rest[1])])


def _plain(x: pa.Array) -> pa.Array:
    """Fractions as the whole numbers of their bits, so that no two of them count as equal; one type of string."""
    if pa.types.is_float64(x.type):
        return x.view(pa.int64())
    return x.cast(pa.string()) if pa.types.is_large_string(x.type) else x


def _encode(x: pa.Array):
    x = _plain(x)
    coded = x.dictionary_encode(null_encoding="encode")
    if pa.types.is_signed_integer(x.type) and not x.null_count and 4 * len(coded.dictionary) > len(x):
        return "d", _steps(x.to_numpy())
    codes = coded.indices.to_numpy().astype(np.int64)
    step = np.diff(codes, prepend=0)
    if len(step) and step.min() >= 0:                # sorted: a step of one where the value changes
        return "m", _small(step), _values(coded.dictionary)
    return "c", _small(codes), _values(coded.dictionary)


def _decode(stored, kind: pa.DataType) -> pa.Array:
    how, numbers, *values = stored
    plain = pa.int64() if pa.types.is_float64(kind) else kind
    if how == "d":
        return pa.array(_unsteps(numbers)).cast(plain).view(kind)
    codes = _unsmall(numbers)
    x = _unvalues(values[0], plain).take(pa.array(np.cumsum(codes) if how == "m" else codes))
    return x.view(kind) if plain != kind else x


def pack(columns: list[pa.Array]) -> bytes:
    raw = pickle.dumps([_encode(x) for x in columns], protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(payload: bytes, kinds: list[pa.DataType]) -> list[pa.Array]:
    raw = pa.Codec("zstd").decompress(payload[8:], int.from_bytes(payload[:8], "little"), asbytes=True)
    return [_decode(x, kind) for x, kind in zip(pickle.loads(raw), kinds)]


def _rank(x: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the distinct ones, and these in order (null last)."""
    coded = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    coded = _plain(coded).dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def _pack_rows(table: pa.Table, sort: list[str], part: np.ndarray, names: np.ndarray, name: str) -> pa.RecordBatch:
    """(the part's name, payload) of each partition that has some of the rows."""
    order = np.lexsort([*(_rank(table[c])[0] for c in reversed(sort)), part])
    part = part[order]
    table = table.take(pa.array(order)).combine_chunks()
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(cuts[1:], len(part))
    columns = [x.chunk(0) if x.num_chunks == 1 else x.combine_chunks() for x in table.columns]
    payloads = [pack([x.slice(a, b - a) for x in columns]) for a, b in zip(cuts.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(names[part[cuts]]), pa.array(payloads, pa.binary())], names=[name, "payload"])


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of int values."""
    def turn(v, k):
        return v << np.uint32(k) | v >> np.uint32(32 - k)

    h = np.uint32(42) ^ turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
    for k, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(k)) * np.uint32(m)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def _names(n: int) -> np.ndarray:
    """A number for each of ``n`` partitions that Spark's hash sends there, so that no two of them meet in one."""
    found, size = np.full(n, -1), 4 * n
    while (found < 0).any():
        found[np.mod(_hash(np.arange(size)), n)[::-1]] = np.arange(size)[::-1]
        size *= 2
    return found.astype(np.int32)


def _types(schema: StructType) -> pa.ListType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(ArrayType(StructType([StructField(f.name, f.dataType) for f in schema.fields])))


def _joined(payloads: list[bytes], whole: pa.ListType) -> pa.Table:
    names, kinds = [f.name for f in whole.value_type], [f.type for f in whole.value_type]
    parts = [pa.table(unpack(p, kinds), names=names) for p in payloads or ()]
    return pa.concat_tables(parts) if parts else pa.table([pa.array([], kind) for kind in kinds], names=names)


def _at_its_part(rows: DataFrame, by: str, sort: list[str], n: int, name: str) -> DataFrame:
    """(by_part, name): the packed rows of each of ``n`` partitions, sorted by ``sort`` as far as they were packed together."""
    names, limit, part = _names(n), CHUNK_ROWS, f"{by}_part"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, limit):
            yield _pack_rows(table.drop_columns([part]), sort, table[part].to_numpy(), names, part)

    some = rows.withColumn(part, F.pmod(F.hash(by), F.lit(n))).mapInArrow(packed, f"{part} int, payload binary")
    return some.repartition(n, part).groupBy(part).agg(F.collect_list("payload").alias(name))


def join_parts(many: DataFrame, one: DataFrame, on: str, how: str, n: int) -> DataFrame:
    """Equi-join ("inner" or "left") by ``on``: both sides are packed and dealt out by ``on``, partitions meet by their number, and the rows of two
    partitions are joined by a hash table in the task.  (on, the other columns of ``many``, those of ``one``.)"""
    left, right, part = _types(many.schema), _types(one.schema), f"{on}_part"
    columns = [on, *(c for c in many.columns if c != on), *(c for c in one.columns if c != on)]
    fields = {f.name: StructField(f.name, f.dataType) for f in [*one.schema.fields, *many.schema.fields]}
    kind = {"inner": "inner", "left": "left outer"}[how]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                found = _joined(b["many"][row].as_py(), left).join(_joined(b["one"][row].as_py(), right), on, join_type=kind, use_threads=False)
                yield from found.select(columns).combine_chunks().to_batches(max_chunksize=10_000)

    both = _at_its_part(many, on, [on], n, "many").join(_at_its_part(one, on, [on], n, "one").hint("shuffle_hash"), part, how)
    return both.mapInArrow(met, StructType([fields[c] for c in columns]))


def collect_parts(rows: DataFrame, by: list[str], n: int, norm_of: str | None = None) -> DataFrame:
    """(by, _t, n_terms, norm): the other columns as an array of structs in their order, for each value of ``by``, dealt out by the first of these,
    with the array's size and the Euclidean norm of one of its fields.  A row whose first other column is null is no element; a value of
    ``by`` with no other rows has an empty array."""
    others = [c for c in rows.columns if c not in by]
    whole, sort = _types(rows.schema), [*by, *others]
    kinds = {f.name: f for f in whole.value_type}
    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in by),
                         StructField("_t", ArrayType(StructType([StructField(c, rows.schema[c].dataType) for c in others]))),
                         StructField("n_terms", IntegerType()), *([StructField("norm", DoubleType())] if norm_of else [])])

    def collected(table: pa.Table) -> pa.Table:
        ranks = {c: _rank(table[c])[0] for c in sort}
        order = np.lexsort([ranks[c] for c in reversed(sort)])
        table = table.take(pa.array(order)).combine_chunks()
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in by:
            new[1:] |= np.diff(ranks[c][order]) != 0
        stays = table[others[0]].is_valid().to_numpy()
        bounds = np.append(np.append(0, np.cumsum(stays))[np.flatnonzero(new)], stays.sum())
        kept = table.select(others).filter(pa.array(stays)).combine_chunks()
        values = pa.StructArray.from_arrays([kept[c].combine_chunks() for c in others], fields=[kinds[c] for c in others])
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
        size = np.diff(bounds)
        out = table.select(by).take(pa.array(np.flatnonzero(new))).append_column("_t", lists).append_column("n_terms", pa.array(size.astype(np.int32)))
        if norm_of:
            x = kept[norm_of].fill_null(0.0).to_numpy()
            out = out.append_column("norm", pa.array(np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), x * x, len(size)))))
        return out

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payloads in b["packed"]:
                yield from collected(_joined(payloads.as_py(), whole)).combine_chunks().to_batches(max_chunksize=32)

    return _at_its_part(rows, by[0], sort, n, "packed").select("packed").mapInArrow(opened, schema)


def sum_ranges(rows: DataFrame, by: str, bounds: list[str]) -> DataFrame:
    """(by, sums of the other columns): each value of the string column ``by`` once, in ranges cut at ``bounds`` that follow each other as the
    partitions do.  A task sums its rows a chunk at a time before they are packed; a range is summed as a whole."""
    n, limit, whole = len(bounds) + 1, CHUNK_ROWS, _types(rows.schema)
    others = [c for c in rows.columns if c != by]
    every = np.arange(n, dtype=np.int32)

    def summed(table: pa.Table) -> pa.Table:
        found = table.group_by(by, use_threads=False).aggregate([(c, "sum") for c in others])
        return pa.table({f.name: found[f.name if f.name == by else f"{f.name}_sum"].cast(f.type) for f in whole.value_type})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, limit):
            table = summed(table)
            rank, values = _rank(table[by])
            starts = [bisect_left(values, b, key=lambda v: v.as_py()) for b in bounds]
            yield _pack_rows(table, [by], np.searchsorted(np.array(starts, np.int64), rank, side="right"), every, PART)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [p for b in batches for p in b["payload"].to_pylist()]
        if held:
            yield from summed(_joined(held, whole)).sort_by(by).combine_chunks().to_batches(max_chunksize=10_000)

    return (rows.mapInArrow(packed, f"{PART} int, payload binary").repartitionById(n, PART)
            .mapInArrow(opened, StructType([StructField(f.name, f.dataType) for f in rows.schema.fields])))


def range_bounds(values: DataFrame, by: str, n: int) -> list[str]:
    """Up to ``n`` - 1 values of the string column ``by`` that cut ``values`` into ranges of about as many rows."""
    if n < 2:
        return []
    count = values.count()
    every = max(1, count // (SAMPLE_PER_PART * n))
    found = values.where(F.pmod(F.xxhash64(*values.columns), F.lit(every)) == 0).select(by).where(F.col(by).isNotNull())
    drawn = sorted(r[0] for r in found.collect())                       # about SAMPLE_PER_PART rows a range
    return sorted({drawn[k * len(drawn) // n] for k in range(1, n)}) if drawn else []
