"""Best-fit packing of tokenised documents into sequences, by bin completion.

Only the histogram of piece lengths (at most `capacity` numbers, whatever the corpus) reaches the
driver. There fillings of least waste around the largest length left are used in bulk, for as many
sequences as the counts allow; best-fit decreasing gives another plan. The better one is the incumbent.
Where it opens more sequences than the lower bound, bin completion packs its last pieces again: it
branches over the undominated fillings of each sequence, and prunes by the waste that a better plan
may have, until the bound is met or its budget spent. The plan goes back as runs "ranks a..b of length n begin at offset o of
sequences s, s + 1, ..." and each piece finds its run by its rank among pieces of its length.

Defined cases: a null or empty text is one piece that holds the end id alone; a text of exactly the
capacity with its end id is one full piece; pieces of equal length are ranked by doc_id, then place;
repeated rows are packed once each; no rows give no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._store import keep
from ._text import pieces as row_slices, text_buffers
from ._worker import in_batches
from .tokens import chunks

CAPACITY = 2048
END_ID = 0
#: Ranks are dealt in so many parts of each length at least, and in one for so many pieces.
_PARTS, _PART_ROWS = 64, 1 << 19
#: Fillings that a search looks at before it keeps its incumbent.
_NODES = 4000
#: Pieces that are packed again by branching where a plan is over the lower bound, and fillings that this looks at.
_BRANCHED, _LOOKS = 96, 200_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of every document: doc_id, piece, start, length, ids_crc32 (and ids)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        table = chunks(tokenizer)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            data, offs = text_buffers(batch.column("text"))
            for i, j in row_slices(offs):
                ids, at = table.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                out = ([], [], [], [], [], [])
                for doc, a, b in zip(doc_ids[i:j], at[:-1].tolist(), at[1:].tolist()):
                    own = np.full(b - a + 1, end_id, "<u4")
                    own[:-1] = ids[a:b]
                    for k, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        for column, value in zip(out, (doc, k, start, len(part), zlib.crc32(part))):
                            column.append(value)
                        if with_ids:
                            out[5].append(part.astype(np.int64))
                arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(out[5], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return in_batches(rows, run, _PIECES + (", ids array<long>" if with_ids else ""))


def completion(largest: int, left: dict[int, int], sizes: list[int], capacity: int) -> list[int]:
    """The filling around `largest` with the least waste; sizes: those with a count, ascending."""
    best: list[int] = []
    best_room = room = capacity - largest
    looked = 0

    def search(room: int, top: int, chosen: list[int]) -> bool:
        nonlocal best, best_room, looked
        if room < best_room:
            best, best_room = list(chosen), room
        if not best_room:
            return True
        if left.get(room, 0) > chosen.count(room) + (room == largest) and room <= top:
            best, best_room = [*chosen, room], 0
            return True
        at = bisect_right(sizes, min(room, top)) - 1
        while at >= 0:
            size = sizes[at]
            looked += 1
            if looked > _NODES:
                return True
            rest = room - size
            if left[size] > chosen.count(size) + (size == largest):
                # what is left after this one can be filled by smaller ones only if the smallest fits
                if rest == 0 or rest >= sizes[0] or rest < best_room:
                    chosen.append(size)
                    if search(rest, size, chosen):
                        return True
                    chosen.pop()
                elif rest >= best_room:
                    pass
            at -= 1
        return False

    search(room, room, [])
    return best


def _greedy(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """A plan of least-waste fillings around the largest length left, in bulk."""
    left = {k: n for k, n in histogram.items() if n > 0}
    sizes = sorted(left)
    out = []
    while sizes:
        largest = sizes[-1]
        fill = completion(largest, left, sizes, capacity) if capacity - largest >= sizes[0] else []
        members = [largest, *fill]
        times = min(left[k] // members.count(k) for k in set(members))
        out.append((members, times))
        for k in members:
            left[k] -= times
        sizes = [k for k in sizes if left[k]]
    return out


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """The plan of best-fit decreasing, in bulk."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []

    def put(members: list[int], times: int, room: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((members, times))

    for size in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        n = histogram[size]
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                members, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, members, times = capacity, [], -(-n // (capacity // size))
            # a sequence with a piece of this size is the tightest for the next one, until none fits
            each = room // size
            full = min(times, n // each)
            put(members + [size] * each, full, room - each * size)
            n -= full * each
            if full < times:
                put(members + [size] * n, int(n > 0), room - n * size)
                put(members, times - full - (n > 0), room) if members else None
                n = 0
    return [x for room in rooms for x in open_[room]]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any plan needs: by the total, and by lengths that exclude each other (Martello and Toth's L2)."""
    sizes = sorted(k for k, n in histogram.items() if n > 0)
    count, total = [0], [0]
    for k in sizes:
        count.append(count[-1] + histogram[k])
        total.append(total[-1] + k * histogram[k])
    best = -(-total[-1] // capacity)
    half = bisect_right(sizes, capacity // 2)
    for least in [0, *sizes[:half]]:
        low, high = bisect_left(sizes, least), bisect_right(sizes, capacity - least)
        over = total[half] - total[low] - ((count[high] - count[half]) * capacity - (total[high] - total[half]))
        best = max(best, count[-1] - count[half] + max(0, -(-over // capacity)))
    return best


def _dominated(members: list[int], room: int, left: dict[int, int]) -> bool:
    """Whether a piece outside takes the place of some members (two or more, or smaller ones) and fits; the first member stays."""
    sums = several = 0  # bit t: some members, two or more of them, are t long together
    singles = 0
    for k in members[1:]:
        several |= (several | singles) << k
        singles |= 1 << k
    sums = 1 | singles | several
    for y, n in left.items():
        if n > members.count(y):
            low = max(0, y - room)
            if several >> y & 1 or low < y and sums >> low & ((1 << (y - low)) - 1):
                return True
    return False


def branched(histogram: dict[int, int], capacity: int, incumbent: list[list[int]], bound: int, budget: int) -> list[list[int]]:
    """The least sequences by bin completion, or the best found when `budget` looks are spent.

    Branches over the undominated fillings around the largest length left, least waste first; waste that no
    better plan than the incumbent can have ends a branch, a plan of `bound` sequences the search.
    """
    left = dict(histogram)
    best, made, looked = incumbent, [], 0
    rest = sum(k * n for k, n in left.items())

    def fillings(largest: int, waste: int) -> list[tuple[int, list[int]]]:
        sizes = sorted(k for k, n in left.items() if n)
        out, chosen = [], [largest]

        def extend(at: int, room: int) -> None:
            nonlocal looked
            looked += 1
            if looked > budget:
                return
            if room <= waste and not _dominated(chosen, room, left):
                out.append((room, list(chosen)))
            for i in range(min(at, bisect_right(sizes, room) - 1), -1, -1):
                k = sizes[i]
                if left[k] > chosen.count(k):
                    chosen.append(k)
                    extend(i, room - k)
                    chosen.pop()

        extend(len(sizes) - 1, capacity - largest)
        return sorted(out, key=lambda x: x[0])

    def search() -> None:
        nonlocal best, rest
        largest = max((k for k, n in left.items() if n), default=0)
        if not largest:
            if len(made) < len(best):
                best = list(made)
            return
        waste = (len(best) - 1 - len(made)) * capacity - rest
        for room, members in fillings(largest, waste) if waste >= 0 else ():
            if len(best) <= bound or room > (len(best) - 1 - len(made)) * capacity - rest:
                break
            for k in members:
                left[k] -= 1
            rest -= sum(members)
            made.append(members)
            search()
            made.pop()
            rest += sum(members)
            for k in members:
                left[k] += 1
            if looked > budget:
                break

    search()
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences), largest member first.

    The better of the least-waste and the best-fit-decreasing plan; where it is over the lower bound, its last
    sequences of up to _BRANCHED pieces (a small job is branched whole) are packed again by branched().
    """
    bound = lower_bound(histogram, capacity)
    made = lambda planned: sum(times for _, times in planned)
    best = _greedy(histogram, capacity)
    if made(best) > bound:
        best = min(best, best_fit(histogram, capacity), key=made)
    if made(best) > bound:
        # sequences with the most room last, as they are worth opening
        fixed = sorted(best, key=lambda x: capacity - sum(x[0]))
        opened: list[list[int]] = []
        pieces = 0
        while fixed and pieces + len(fixed[-1][0]) <= _BRANCHED:
            members, times = fixed.pop()
            taken = min(times, (_BRANCHED - pieces) // len(members))
            opened += [members] * taken
            pieces += taken * len(members)
            if taken < times:
                fixed.append((members, times - taken))
        again: dict[int, int] = {}
        for members in opened:
            for k in members:
                again[k] = again.get(k, 0) + 1
        least = max(lower_bound(again, capacity), bound - made(fixed))
        best = fixed + [(members, 1) for members in branched(again, capacity, opened, least, _LOOKS)]
    return best


def _runs(planned: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and per run its first sequence less that rank, and its offset."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for members, times in planned:
        offset = 0
        for k in members:
            r = rank.get(k, 0)
            rows.append(((k << 44) + r, sequence - r, offset))
            rank[k] = r + times
            offset += k
        sequence += times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))


def pack(found: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """found (doc_id, piece, start, length, ..., read twice) with sequence_id and offset."""
    spark = found.sparkSession
    histogram = {r[0]: r[1] for r in found.groupBy("length").count().toLocalIterator()}  # capacity rows at most
    runs = spark.sparkContext.broadcast(_runs(plan(histogram, capacity)))
    parts = max(_PARTS, -(-sum(histogram.values()) // _PART_ROWS))
    dealt = found.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    own = Window.partitionBy("length", "_part").orderBy(*[c for c in found.columns if c not in ("length", "ids")])
    ranked = dealt.withColumn("_rank", F.row_number().over(own)).join(before, ["length", "_part"])
    names = found.columns
    rows = ranked.select(*names, (F.col("_rank") - 1 + F.col("_before")).cast("long").alias("sequence_id"))

    def place(batches):
        keys, base, offset = runs.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("sequence_id").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            arrays = [batch.column(c) for c in names] + [pa.array(base[at] + rank, pa.int64()), pa.array(offset[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    schema = StructType([*found.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return in_batches(rows, place, schema)


def packed(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document in sequences of at most `capacity` ids; only longer documents are cut."""
    return pack(keep(tokenized(docs, tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces"), capacity=capacity)
