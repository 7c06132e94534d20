import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm.op3 import tokenizer_path
from textloom.llm.packing import best_fit, lower_bound, packed, plan

from .util import EDGES, docs, prose


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def expected(tokenizer, texts, capacity):
    out = Counter()
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[s : s + capacity], "<u4")
            out[(i, k, s, len(part), zlib.crc32(part.tobytes()))] += 1
    return out


def checked(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_ids_and_places(spark, tokenizer):
    texts = EDGES + [prose(k, 3 * k) for k in range(40)] + ["It's DON'T we'll 12 345!!! ﬁ Å Å ſ İ", "<|endoftext|> a b\x85c\x0bd", "é ́x"]
    rows = packed(docs(spark, texts), tokenizer_path(), capacity=128).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected(tokenizer, texts, 128)
    assert checked(rows, 128) <= -(-sum(r.length for r in rows) // 128) + 1


def test_repeated_rows_and_empty_table(spark, tokenizer):
    df = docs(spark, ["a b c"] * 5, [1] * 5)
    rows = packed(df, tokenizer_path(), capacity=9).collect()
    assert len(rows) == 5 and checked(rows, 9) == 3
    assert packed(docs(spark, []), tokenizer_path()).collect() == []


def test_ids_come_with_the_pieces(spark, tokenizer):
    rows = packed(docs(spark, [prose(1, 50)]), tokenizer_path(), capacity=64, with_ids=True).collect()
    assert [i for r in sorted(rows, key=lambda r: r.piece) for i in r.ids] == tokenizer.encode(prose(1, 50), add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("seed", range(6))
def test_plan_against_exhaustive_search(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 20) for _ in range(9)]
    best = [len(sizes)]

    def search(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= 20:
                bins[i] += sizes[k]
                search(k + 1, bins)
                bins[i] -= sizes[k]
        search(k + 1, [*bins, sizes[k]])

    search(0, [])
    made = plan(Counter(sizes), 20)
    assert Counter(x for members, times in made for x in members * times) == Counter(sizes)
    assert all(sum(members) <= 20 for members, _ in made)
    assert sum(times for _, times in made) <= best[0] + 1


def test_plan_of_many_lengths_reaches_the_bound():
    r = random.Random(1)
    sizes = Counter(min(2048, int(r.expovariate(1 / 700)) + 1) for _ in range(100_000))
    made = plan(sizes)
    assert sum(t for _, t in made) <= -(-sum(k * n for k, n in sizes.items()) // 2048) * 1.001


def least(sizes, capacity):
    best = len(sizes)

    def search(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= sizes[k]:
                search(k + 1, [*rooms[:i], room - sizes[k], *rooms[i + 1 :]])
        search(k + 1, [*rooms, capacity - sizes[k]])

    search(0, [])
    return best


def test_plan_goes_back_where_the_first_filling_is_not_the_best():
    made = plan(Counter([13, 11, 11, 6, 6, 4, 4, 3]), 20)
    assert sum(times for _, times in made) == 3


def test_plan_is_the_optimum_of_small_jobs():
    for seed in range(400):
        r = random.Random(seed)
        sizes = sorted((r.randint(2, r.choice([9, 13, 20])) for _ in range(r.randint(6, 11))), reverse=True)
        made, best = plan(Counter(sizes), 20), least(sizes, 20)
        assert Counter(x for members, times in made for x in members * times) == Counter(sizes)
        assert all(sum(members) <= 20 for members, _ in made)
        assert sum(times for _, times in made) == best >= lower_bound(Counter(sizes), 20), sizes


def test_best_fit_in_bulk_is_best_fit_of_single_pieces():
    for seed in range(100):
        r = random.Random(seed)
        sizes = Counter(r.randint(1, 60) for _ in range(300))
        rooms = []
        for k in sorted(sizes.elements(), reverse=True):
            i = min((i for i, room in enumerate(rooms) if room >= k), key=lambda i: rooms[i], default=None)
            if i is None:
                rooms.append(100 - k)
            else:
                rooms[i] -= k
        made = best_fit(sizes, 100)
        assert Counter(x for members, times in made for x in members * times) == sizes
        assert sorted(100 - sum(members) for members, times in made for _ in range(times)) == sorted(rooms)
