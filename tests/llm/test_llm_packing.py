import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_cases import edge_rows
from tokenizers import Tokenizer

from polarity.llm.common import table
from polarity.llm.packing import RANKS, TOKENIZER, Encoder, pack_documents, packing_plan, sequences, slots


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def ids_of(slow, text):
    return slow.encode(text or "", add_special_tokens=False).ids + [0]


def brute_pieces(slow, rows, capacity=2048):
    out = []
    for i, t, *_ in rows:
        ids, start, k = ids_of(slow, t), 0, 0
        while start < len(ids):
            n = (len(ids) - start) % capacity or capacity
            out.append((i, k, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes())))
            start, k = start + n, k + 1
    return sorted(out, key=repr)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for of in by.values():
        end = 0
        for offset, length in sorted(of):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [1, 2, 5, 8, 16, 50, 200])
def test_plan(capacity):
    rng = random.Random(capacity)
    for _ in range(40):
        counts = Counter(rng.randint(1, capacity) if rng.random() < 0.7 else max(1, capacity // 2) for _ in range(rng.choice([0, 1, 3, 30, 300])))
        plan, got = packing_plan(counts, capacity), Counter()
        for content, times in plan:
            assert times > 0 and sum(x * k for x, k in content.items()) <= capacity
            for x, k in content.items():
                got[x] += k * times
        assert got == counts
        used = Counter()
        for length, lo, hi, _, each, _ in slots(plan):
            assert lo == used[length] and (hi - lo) % each == 0
            used[length] = hi
        assert used == counts


def test_exact_complements_are_consumed_first():
    plan = packing_plan({6: 5, 4: 2, 3: 3, 1: 3, 2: 9}, 10)
    assert sum(t for c, t in plan if sum(x * k for x, k in c.items()) == 10) == sum(t for _, t in plan) - 1


def test_few_sequences(slow, spark):
    rows = pack_documents(table(spark, "/root/testdata/sf0.001", "documents")).collect()
    least = -(-sum(r.length for r in rows) // 2048)
    assert check_places(rows, 2048) <= 1.02 * least + 1


def test_documents_round_trip(slow, edge, nothing):
    packed = pack_documents(edge, with_ids=True)
    rows = packed.collect()
    assert sorted([(r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=repr) == brute_pieces(slow, edge_rows())
    check_places(rows, 2048)
    texts = {r.sequence_id: r for r in sequences(packed).collect()}
    for r in rows:
        s = texts[r.sequence_id]
        assert bytes(s.ids)[4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    assert sum(s.length for s in texts.values()) == sum(r.length for r in rows)
    assert pack_documents(nothing).count() == 0


def test_encoder_gives_the_tokenizers_ids(slow):
    encode = Encoder(public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))
    rng = random.Random(3)
    odd = [chr(c) for c in range(0x250)] + ["<|endoftext|>", " <|endoftext|> ", "'s", "'LL", "  ", "\n\n", " \n", "’", "中", "\U0001f600"]
    texts = ["".join(rng.choice(odd) if rng.random() < 0.5 else rng.choice("abc ABC 019 \n\t.,") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t in [*texts, " " * 1_100_000, "a" * 200_000]:
        assert encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids
