"""Packing of documents into sequences by swap-based local search.

Documents become pieces of at most the capacity; only longer documents are cut,
their first piece taking the remainder. Pieces are packed in groups of bounded
size, each inside one task: a best-fit start, then exchanges between underfull
bins (one for one, two for one, one for two, or a plain move) that raise the sum
of squared fills, so bins fill up or become empty. The pieces of bins that stay
open meet those of other groups in the next level, until one group holds them or
a level no longer helps.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.chunks import library_encoder
from tracewright.llm.common import column, record, steps, whole_text
from tracewright.session import shuffle_width, stage


@dataclass(frozen=True)
class Packing:
    """`group`: pieces packed together; `closed`: share of the capacity from which a bin is final before the last level."""

    capacity: int = 2048
    group: int = 50_000
    closed: float = 0.995
    passes: int = 6


class Bins:
    """Bins of one group with an index of the pieces by length."""

    def __init__(self, lengths: Sequence[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self._best_fit()

    def _best_fit(self) -> None:
        """Longest first, each into the fullest bin that has room."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0  # bit r: a bin has room r
        for i in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            n = self.lengths[i]
            fit = rooms >> n
            if fit:
                room = n + (fit & -fit).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
                self.items[b].append(i)
                self.fill[b] += n
            else:
                b, room = len(self.items), self.capacity
                self.items.append([i])
                self.fill.append(n)
            left = room - n
            by_room[left].append(b)
            rooms |= 1 << left

    def squared(self) -> int:
        return sum(f * f for f in self.fill)

    def search(self, passes: int) -> int:
        """Exchange pieces between underfull bins until a pass changes nothing; returns the number of exchanges."""
        changes = 0
        for _ in range(passes):
            done = self._pass()
            changes += done
            if not done:
                break
        keep = [b for b in range(len(self.items)) if self.items[b]]
        self.items, self.fill = [self.items[b] for b in keep], [self.fill[b] for b in keep]
        return changes

    def _pass(self) -> int:
        """Fill the fuller bins, one after the other, from the emptiest ones."""
        order = sorted((b for b in range(len(self.items)) if 0 < self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], b))
        missing = sum(self.capacity - self.fill[b] for b in order)
        # as many bins as could be emptied if all room were filled, and as many again to choose from
        givers = order[max(1, len(order) - 2 * (missing // self.capacity) - 8) :] if len(order) > 1 else []
        where: dict[int, list[tuple[int, int]]] = {}
        sizes = 0  # bit n: some giver holds a piece of length n
        for b in givers:
            for i in self.items[b]:
                where.setdefault(self.lengths[i], []).append((b, i))
                sizes |= 1 << self.lengths[i]
        changes, taker_of = 0, {b: k for k, b in enumerate(order)}
        home = {i: b for b in givers for i in self.items[b]}

        def longest(limit: int) -> int:
            low = sizes & ((1 << (limit + 1)) - 1)
            return low.bit_length() - 1 if low > 1 or limit == 0 and low else (0 if low else -1)

        def find(n: int, taker: int) -> int | None:
            """A piece of length n in a bin that is less full than the taker."""
            stack = where.get(n, [])
            for k in range(len(stack) - 1, -1, -1):
                b, i = stack[k]
                if home.get(i) != b:
                    stack.pop(k)  # moved away
                elif b != taker and self.fill[b] and taker_of[b] > taker_of[taker]:
                    return i
            return None

        for a in order:
            if not self.fill[a]:
                continue
            while (room := self.capacity - self.fill[a]) > 0:
                best = None  # (gain, pieces that leave a, pieces that come)
                options: dict[int, tuple[int, ...]] = {0: ()}
                for i in self.items[a]:
                    options.setdefault(self.lengths[i], (i,))
                own = list(options.items())
                for x, (n1, p1) in enumerate(own[1:], 1):
                    for n2, p2 in own[x:]:
                        if p1 != p2:
                            options.setdefault(n1 + n2, p1 + p2)
                for out, pieces in options.items():
                    n = longest(out + room)
                    if n > out and (best is None or n - out > best[0]) and (y := find(n, a)) is not None and home[y] != a:
                        best = (n - out, pieces, (y,))
                    if best and best[0] == room:
                        break
                if best is None or best[0] < room:
                    for out, pieces in own[:8]:  # two for one
                        if len(pieces) > 1:
                            continue
                        y1 = longest(out + room)
                        i1 = find(y1, a) if y1 > 0 else None
                        if i1 is None:
                            continue
                        y2 = longest(out + room - y1)
                        i2 = find(y2, a) if y2 > 0 else None
                        if i2 is not None and i2 != i1 and y1 + y2 - out > (best[0] if best else 0):
                            best = (y1 + y2 - out, pieces, (i1, i2))
                if best is None:
                    break
                gain, leave, come = best
                before = self.fill[a] ** 2 + sum(self.fill[b] ** 2 for b in {home[i] for i in come})
                giver = home[come[-1]]
                touched = {home[i] for i in come}
                after_fill = {b: self.fill[b] for b in touched}
                for i in come:
                    after_fill[home[i]] -= self.lengths[i]
                after_fill[giver] += sum(self.lengths[i] for i in leave)
                after = (self.fill[a] + gain) ** 2 + sum(f * f for f in after_fill.values())
                if after <= before or after_fill[giver] > self.capacity:
                    break
                for i in come:
                    b = home[i]
                    self.items[b].remove(i)
                    self.items[a].append(i)
                    home[i] = a
                for i in leave:
                    self.items[a].remove(i)
                    self.items[giver].append(i)
                    home[i] = giver
                    where.setdefault(self.lengths[i], []).append((giver, i))
                    sizes |= 1 << self.lengths[i]
                for b, f in after_fill.items():
                    self.fill[b] = f
                self.fill[a] += gain
                for i in come:
                    n = self.lengths[i]
                    if not any(home.get(p) == b for b, p in where.get(n, [])):
                        sizes &= ~(1 << n)
                        where.pop(n, None)
                changes += 1
        return changes


def pack(lengths: Sequence[int], packing: Packing = Packing()) -> list[list[int]]:
    """Bins of piece numbers of one group."""
    bins = Bins(lengths, packing.capacity)
    bins.search(packing.passes)
    return bins.items


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int, packing: Packing = Packing()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; a null text is empty and still has its end id."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end, cap = end_id.to_bytes(4, "little"), packing.capacity

    def run(batches):
        enc = library_encoder(vocabulary)
        for b in steps(batches):
            rows = []
            for d, ids in zip(column(b, "doc_id").to_pylist(), enc.encode(column(b, "text").to_pylist())):
                ids += end
                n = len(ids) // 4
                start, stop, k = 0, n % cap or min(n, cap), 0
                while start < n:
                    rows.append((d, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, k = stop, stop + cap, k + 1
            d, k, start, length, crc = zip(*rows)
            yield record(schema, doc_id=d, piece=k, start=start, length=length, ids_crc32=crc)

    return whole_text(docs, "doc_id").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pack_level(pieces: DataFrame, packing: Packing, level: int, tasks: int) -> DataFrame:
    schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill")])

    def group(table: pa.Table, number: int):
        lengths = table.column("length").to_pylist()
        order, ids, offsets, fills = [], [], [], []
        # level, task, group and bin make up the number
        first = ((level << 24 | TaskContext.get().partitionId()) << 12 | number) << 20
        for b, items in enumerate(pack(lengths, packing)):
            total, at = sum(lengths[i] for i in items), 0
            for i in items:
                order.append(i)
                ids.append(first | b)
                offsets.append(at)
                fills.append(total)
                at += lengths[i]
        kept = table.take(pa.array(order, pa.int64()))
        columns = [kept.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(x, pa.int64()) for x in (ids, offsets, fills)]
        return pa.Table.from_arrays(columns, schema=schema).to_batches()

    def run(batches):
        held, rows, number = [], 0, 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, packing.group - rows)
                held.append(part)
                rows += part.num_rows
                b = b.slice(part.num_rows)
                if rows == packing.group:
                    yield from group(pa.Table.from_batches(held), number)
                    held, rows, number = [], 0, number + 1
        if rows:
            yield from group(pa.Table.from_batches(held), number)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"
    # dealt in turn, so that no value decides which pieces meet
    return stage(pieces.repartition(tasks).mapInArrow(run, kinds))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, packing: Packing = Packing()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Every row of `docs` is packed: nulls count as empty texts, repeated rows each
    have their own place, an empty table gives no pieces.
    """
    wanted = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces = stage(cut_documents(docs, vocabulary, end_id, packing))
    count = pieces.count()
    closed, level, out = int(packing.closed * packing.capacity), 0, None
    while True:
        tasks = max(1, min(-(-count // packing.group), 4 * shuffle_width(docs.sparkSession)))
        packed = _pack_level(pieces, packing, level, tasks)
        final = packed if tasks == 1 else packed.where(F.col("fill") >= closed)
        left = 0 if tasks == 1 else packed.where(F.col("fill") < closed).count()
        if left > count // 2:  # mixing groups no longer helps
            final, left = packed, 0
        out = final.select(wanted) if out is None else out.unionByName(final.select(wanted))
        if not left:
            return out
        pieces, count, level = packed.where(F.col("fill") < closed), left, level + 1
