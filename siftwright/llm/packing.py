"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one remainder. The histogram of remainders is a cutting-stock problem: choose how
often to use each pattern (how many remainders of each length share a sequence) so that every remainder is placed and the padded
length is least. Remainders of more than half a sequence may be cut once, after half a sequence; the program decides how many. The linear program over patterns is solved by the revised simplex method; an integer knapsack over the duals,
solved by dynamic programming for every total at once, prices new patterns until none can lower the bound by more than ``gap``.
Pattern counts are rounded down, and what is left, at most about one sequence for each length, is packed by exact subset sums.
Then each length's remainders, ranked by document, take the slots of its length in order.

The histogram has as many entries as the sequence has tokens, and patterns are as few, so driver and broadcasts hold a bounded
amount whatever the number of documents. Ranks come from range partitioning, so documents of one length spread over all tasks.

Sequences are padded to ``size`` unless their length is a power of two; those are left as they are.

Defined cases: null text counts as empty and gives just the end id; repeated rows are packed once for each row; a null id is kept;
an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.bitplanes import _POLY, _shift
from siftwright.llm.common import ship, stored, text_or_empty

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(total: int, size: int) -> int:
    """Length of a sequence with its padding."""
    return total if total & (total - 1) == 0 else size


def _best(duals: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each total up to size, the largest sum of duals of lengths that add up to it, and the length added last."""
    value, last = np.full(size + 1, -np.inf), np.zeros(size + 1, np.int64)
    value[0] = 0.0
    for w in range(1, size + 1):
        with_last = duals[1 : w + 1] + value[w - 1 :: -1][:w]
        last[w] = k = int(np.argmax(with_last)) + 1
        value[w] = with_last[k - 1]
    return value, last


def _inverse(a: np.ndarray) -> np.ndarray:
    """By elimination: the matrices are small, and a threaded LAPACK stalls beside busy executors on one machine."""
    n = len(a)
    work = np.hstack([a, np.eye(n)])
    for i in range(n):
        k = i + int(np.argmax(np.abs(work[i:, i])))
        if k != i:
            work[[i, k]] = work[[k, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0.0
        work -= np.outer(factor, work[i])
    return work[:, n:]


def linear_program(need: np.ndarray, size: int, gap: float = 0.002, most_rounds: int = 3000, each: int = 16) -> list[tuple[dict[int, int], float]]:
    """Patterns (length: copies) and how often each is used, fractions allowed. need: for each length up to size, the number to be placed.

    A pattern may hold -1 copies: cutting a length above half the size makes one of half the size and one of the rest, {n: 1,
    half: -1, n - half: -1}, at a small price. Each round prices by dynamic programming and lets up to ``each`` patterns enter."""
    half = size // 2
    lengths = np.arange(1, size + 1)
    b = need[1:].astype(float) + 1e-7 * lengths  # a little more of each, against ties
    patterns: list[dict[int, int]] = [{int(n): size // int(n)} for n in lengths]
    costs = np.full(size, float(size))
    inverse = np.diag([1.0 / p[int(n)] for p, n in zip(patterns, lengths, strict=True)])
    uses = inverse @ b
    for step in range(most_rounds):
        if step % 200 == 199:  # a fresh inverse, against rounding
            base = np.zeros((size, size))
            for j, p in enumerate(patterns):
                for n, a in p.items():
                    base[n - 1, j] = a
            inverse = _inverse(base)
            uses = np.maximum(inverse @ b, 0.0)
        duals = np.concatenate([[-np.inf], costs @ inverse])
        value, last = _best(duals, size)
        # for each length, the best pattern that holds it
        saving = duals[1:] + np.maximum.accumulate(value)[size - 1 :: -1][:size] - size
        found: list[tuple[float, dict[int, int], float]] = []
        for i in np.argsort(-saving)[:each]:
            if saving[i] > 1e-6 * size:
                entering, rest = {int(i) + 1: 1}, int(np.argmax(value[: size - i]))
                while rest:
                    entering[int(last[rest])] = entering.get(int(last[rest]), 0) + 1
                    rest -= int(last[rest])
                found.append((saving[i], entering, float(size)))
        cutting = duals[half + 1 :] - duals[half] - duals[1 : size - half + 1] - size / 1000
        found += [(cutting[i], dict([(half + 1 + int(i), 1), (half, -1)]) | {int(i) + 1: -2 if int(i) + 1 == half else -1}, size / 1000) for i in np.argsort(-cutting)[:each] if cutting[i] > 1e-6 * size]
        if not found or max(f[0] for f in found) <= gap * size:  # the optimum is at least the present cost over 1 + gap
            break
        duals = duals[1:].copy()
        for _, entering, c in sorted(found, key=lambda f: -f[0])[:each]:
            column = np.zeros(size)
            for n, a in entering.items():
                column[n - 1] = a
            gain = duals @ column - c
            if gain <= 1e-6:
                continue
            change = inverse @ column
            up = change > 1e-9
            if not up.any():
                continue
            steps = np.where(up, uses / np.where(up, change, 1.0), np.inf)
            out = int(np.argmin(steps))
            by = steps[out]
            uses -= by * change
            uses[out] = by
            np.maximum(uses, 0.0, out=uses)
            pivot = inverse[out] / change[out]
            duals -= gain * pivot
            inverse -= np.outer(change, pivot)
            inverse[out] = pivot
            patterns[out], costs[out] = entering, c
    return list(zip(patterns, uses.tolist(), strict=True))


def _fill(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """Lengths, no more of each than are left, that fill room as nearly as can be. Sets of reachable totals are bits of an integer."""
    reached, trail, mask = 1, [], (1 << room + 1) - 1
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(left[n], room // n)):
            more = (reached | reached << n) & mask
            trail.append((n, reached))
            reached = more
        if reached >> room & 1:
            break
    total, out = reached.bit_length() - 1, []
    for n, before in reversed(trail):
        if not before >> total & 1:
            out.append(n)
            total -= n
    return out


def patterns_for(need: np.ndarray, size: int, grain: int = 8) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Patterns and how many sequences are made by each, together placing every remainder once; and how many of each length are cut.

    The linear program sees lengths in steps of ``grain``, rounded up; its patterns are then written out for true lengths."""
    half, cuts = size // 2, np.zeros(size, np.int64)
    left = {n: int(c) for n, c in enumerate(need) if n and c}
    if not left:
        return [], cuts
    out: list[tuple[dict[int, int], int]] = []

    def cut(n: int, times: int) -> None:
        cuts[n] += times
        for m, a in ((n, -times), (half, times), (n - half, times)):
            left[m] = left.get(m, 0) + a

    def take(n: int, a: int) -> list[tuple[int, int]]:
        """Up to a of the longest that are left of n steps."""
        got = []
        for m in range(min(n * grain, size - 1), (n - 1) * grain, -1):
            if a and left.get(m, 0):
                got.append((m, min(a, left[m])))
                a -= got[-1][1]
        return got

    steps = np.zeros(size // grain + 1, np.int64)
    np.add.at(steps, -(-np.arange(1, size) // grain), need[1:])
    solved = [(p, int(x + 1e-3)) for p, x in linear_program(steps, size // grain)]
    for p, x in solved:
        if x and min(p.values()) < 0:
            for m, a in take(max(p), x):
                cut(m, a)
    for p, x in solved:
        while x > 0 and min(p.values()) > 0:
            exact: dict[int, int] = {}
            for n, a in p.items():
                exact.update(take(n, a))
            if sum(exact.values()) < sum(p.values()):
                break
            times = min(x, *(left[m] // a for m, a in exact.items()))
            out.append((exact, times))
            for m, a in exact.items():
                left[m] -= a * times
            x -= times
    left = {n: c for n, c in left.items() if c}
    while left:
        order = sorted(left, reverse=True)
        first = order[0]
        left[first] -= 1
        chosen = [first, *_fill(order, left, size - first)]
        # what doesn't fill is cut, unless it was cut from another: those are never cut again
        if first > half and cost(sum(chosen), size) > sum(chosen) * 1.01:
            left[first] += 1
            cut(first, 1)
        else:
            for n in chosen[1:]:
                left[n] -= 1
            out.append(({n: chosen.count(n) for n in chosen}, 1))
        left = {n: c for n, c in left.items() if c}
    return out, cuts


class Slots:
    """Where the k-th remainder of a length goes."""

    WIDE = 1 << 50

    def __init__(self, plan: list[tuple[dict[int, int], int]], first_sequence: int) -> None:
        entries, given, sequence = [], {}, first_sequence
        for p, times in plan:
            offset = 0
            for n, a in sorted(p.items(), reverse=True):
                entries.append((n, given.get(n, 0), sequence, a, offset))
                given[n] = given.get(n, 0) + a * times
                offset += n * a
            sequence += times
        self.table = np.array(sorted(entries), np.int64).reshape(-1, 5)
        self.keys = self.table[:, 0] * self.WIDE + self.table[:, 1]
        self.sequences = sequence

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.table[np.searchsorted(self.keys, length * self.WIDE + rank, "right") - 1]
        nth = rank - t[:, 1]
        return t[:, 2] + nth // t[:, 3], t[:, 4] + nth % t[:, 3] * length


def _times_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_times, element by element."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    out = np.zeros(len(a), np.int64)
    for k in range(31, -1, -1):
        out ^= np.where(a >> k & 1, b, 0)
        b = b >> 1 ^ np.where(b & 1, _POLY, 0)
    return out


def measure(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """doc_id, doc_tokens, crcs (of each full piece, and of the remainder or, if longer, of its first half sequence and the rest), one row for each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from siftwright.llm.tokens import encoder

        e = encoder(tokenizer)
        for batch in batches:
            lo = 0
            for ids, counts in e.with_ends(batch.column(1), end_id):
                data, crcs, begin = memoryview(ids.astype("<u4", copy=False)).cast("B"), [], 0
                for end in (4 * np.cumsum(counts)).tolist():
                    full = begin + (end - begin) // (4 * size) * 4 * size
                    at = [*range(begin, full, 4 * size), *range(full, end, 2 * size), end]
                    crcs.append([zlib.crc32(data[i:j]) for i, j in zip(at, at[1:])])  # noqa: B905
                    begin = end
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(counts)), pa.array(counts, pa.int64()), pa.array(crcs, schema.field(2).type)], schema=schema)
                lo += len(counts)

    ship(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 1024) -> DataFrame:
    """The pieces (see PIECES) that documents are cut into, with the place of each in the sequences."""
    rest = (F.col("doc_tokens") % size).cast("int")
    measured = stored(measure(docs, tokenizer, end_id, size)).withColumn("rest", rest)
    # one row for each length at most
    histogram = {r["rest"]: r["n"] for r in measured.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}

    wide = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("part", pa.int32()), ("nth", pa.int64()), ("full_before", pa.int64())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, full = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            q = b.column(1).to_numpy() // size
            before = full + np.cumsum(q) - q
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(nth, nth + b.num_rows)), pa.array(before)], schema=wide)
            nth, full = nth + b.num_rows, full + int(q.sum())

    ordered = measured.repartitionByRange("rest", "doc_id").sortWithinPartitions("rest", "doc_id", "doc_tokens", "crcs").drop("rest")
    numbered = stored(ordered.mapInArrow(number, "doc_id long, doc_tokens long, crcs array<long>, part int, nth long, full_before long"))
    # one row for each partition
    sums = sorted(map(tuple, numbered.groupBy("part").agg(F.count(F.lit(1)), F.sum(F.floor(F.col("doc_tokens") / size))).collect()))
    top = sums[-1][0] + 1 if sums else 0
    rows_before, full_before = np.zeros(top, np.int64), np.zeros(top, np.int64)
    rows = full = 0
    for part, n, q in sums:
        rows_before[part], full_before[part] = rows, full
        rows, full = rows + n, full + int(q)
    length_before = np.zeros(size, np.int64)
    length_before[1:] = np.cumsum([histogram.get(n, 0) for n in range(size)])[:-1]
    need = np.array([0, *(histogram.get(n, 0) for n in range(1, size))], np.int64)
    plan, cuts = patterns_for(need, size)
    slots = Slots(plan, full)
    half = size // 2
    # of half sequences, those that are remainders come first, then those cut, by length; of other lengths, too, the remainders first
    halves_before = need[half] + np.cumsum(cuts) - cuts
    shifts = np.array([_shift(4 * n) for n in range(half)], np.uint32)

    out_schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, crcs = b.column(1).to_numpy(), b.column(2).flatten().to_numpy()
            part, nth, before = (b.column(i).to_numpy() for i in (3, 4, 5))
            n = np.diff(b.column(2).offsets.to_numpy())
            first = np.cumsum(n) - n
            q, rest = tokens // size, tokens % size
            base = full_before[part] + before
            doc = np.repeat(np.arange(len(q)), q)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(q) - q, q)
            rows = [(doc, piece * size, np.full(len(doc), size), crcs[first[doc] + piece], base[doc] + piece, np.zeros(len(doc), np.int64))]
            rank = rows_before[part] + nth - length_before[rest]
            long = rest > half
            divided = long & (rank < cuts[rest])
            last = first + q

            def add(d: np.ndarray, shift: int, length: np.ndarray, crc: np.ndarray, rank: np.ndarray, rows: list = rows, q: np.ndarray = q) -> None:
                if len(d):
                    sequence, offset = slots.of(length, rank)
                    rows.append((d, q[d] * size + shift, length, crc, sequence, offset))

            d = np.flatnonzero((rest > 0) & ~long)
            add(d, 0, rest[d], crcs[last[d]], rank[d])
            d = np.flatnonzero(long & ~divided)
            add(d, 0, rest[d], _times_all(shifts[rest[d] - half], crcs[last[d]]) ^ crcs[last[d] + 1], rank[d] - cuts[rest[d]])
            d = np.flatnonzero(divided)
            add(d, 0, np.full(len(d), half), crcs[last[d]], halves_before[rest[d]] + rank[d])
            add(d, half, rest[d] - half, crcs[last[d] + 1], need[rest[d] - half] + rank[d])
            doc, start, length, crc, sequence, offset = (np.concatenate(c) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), *map(pa.array, (start, length, crc.astype(np.int64), tokens[doc], sequence, offset))], schema=out_schema)

    return numbered.mapInArrow(place, PIECES)


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer: str, end_id: int = 0, size: int = 1024) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. A sequence gathers at most size ids. doc_id must name one row here."""
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from siftwright.llm.tokens import encoder

        e = encoder(tokenizer)
        for b in batches:
            rows = []
            for ids, places in zip(e.encode(b.column(0)), b.column(1).to_pylist(), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                rows += [{"sequence_id": p["sequence_id"], "offset": p["offset"], "ids": ids[p["start"] : p["start"] + p["length"]].astype(np.int32)} for p in places]
            yield pa.RecordBatch.from_pylist(rows, schema)

    ship(docs.sparkSession)
    places = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places"))
    cuts = docs.select("doc_id", text_or_empty().alias("text")).join(places, "doc_id").select("text", "places").mapInArrow(cut, "sequence_id long, offset long, ids array<int>")
    return cuts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
