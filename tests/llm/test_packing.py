from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pairlens.llm.packing import best_fit_decreasing, default_tokenizer, pack

ROWS = [
    (1, "One two  three"), (2, None), (3, ""), (4, "word " * 40), (5, "\t \n"), (6, "hé's 12 x!!"),
    (6, "hé's 12 x!!"), (None, "no id"), (7, "a\x1cb c d"),
]


def brute_force_bins(sizes, capacity):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fitting = [r for r in rooms if r >= size]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - size)
        else:
            rooms.append(capacity - size)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_moves_equal_piecewise_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 10, 64])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    counts = defaultdict(int)
    for s in sizes:
        counts[s] += 1
    used = defaultdict(set)
    for size, rank, n, first, per, offset in best_fit_decreasing(counts, capacity).tolist():
        for j in range(n):
            place = range(offset + j % per * size, offset + j % per * size + size)
            assert not used[first + j // per] & set(place) and place.stop <= capacity
            used[first + j // per] |= set(place)
    assert sum(map(len, used.values())) == sum(sizes)
    assert sorted(capacity - len(u) for u in used.values()) == brute_force_bins(sizes, capacity)


def test_pieces_are_the_documents_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, length string")
    rows = pack(docs, capacity=16, with_ids=True).collect()
    byid = defaultdict(list)
    for r in rows:
        byid[r.doc_id].append(r)
    for doc_id, text in set(ROWS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        copies = [i for i, _ in ROWS].count(doc_id)
        assert len(byid[doc_id]) == copies * -(-len(ids) // 16)
        for r in byid[doc_id]:
            own = ids[r.piece * 16 : r.piece * 16 + 16]
            assert list(r.ids) == own and r.length == len(own) and r.start == r.piece * 16
            assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 16


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
