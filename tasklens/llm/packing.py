"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' ids in ascending doc_id order. Of T ids in all, N = ceil(T / window) windows are
dealt: by window w, a source of L ids has given floor(w * L / N) of them, so every window holds its target share to
within one id, the fraction left over is the deficit carried to the next window, and all queues end together. That sum
has a closed form, so any task can place its ids alone, without state from other partitions. Inside a window the
sources stand in turn. With target shares, a source gives its share of every window until it ends, and what it leaves
goes to the others in proportion to theirs. Beyond MOST_QUEUES sources the driver holds no list of them: runs of ids are
sorted by window and source and placed by their running sum, which gives the same places. The stream of all windows is cut into sequences of 1024 ids; only the last one is shorter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklens.llm.common import map_rows, map_stream, shuffle_partitions, sized, table
from tasklens.llm.tokens import encoder

SEQUENCE, WINDOW_SEQUENCES, MOST_QUEUES = 1024, 16, 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Schedule:
    """How many ids a queue has given before each window. shares: of the queues that have a target, by their names.

    The other queues divide what the targets leave by their lengths.
    """

    def __init__(self, total: int, window: int, shares: dict[str, float] | None = None, named: dict[str, int] | None = None):
        self.windows, self.total, self.shares = max(1, -(-total // window)), total, shares or {}
        if not self.shares:
            return
        named = named or {}  # lengths of those of shares that are there
        if any(not 0 < x <= 1 for x in self.shares.values()) or sum(self.shares.values()) > 1 + 1e-9:
            raise ValueError("shares must be above 0 and make up 1 at most")
        self.others, self.left = total - sum(named.values()), max(0.0, 1 - sum(self.shares.values()))
        if self.others and self.left < 1e-9:
            raise ValueError("the shares make up 1, but there are sources without one")
        # virtual time goes on as a queue gives its share times it; a kink for each queue that ends
        ends = [(x / self.shares[q], x, self.shares[q]) for q, x in named.items()] + ([(self.others / self.left, self.others, self.left)] if self.others else [])
        self.times = np.array([0.0, *sorted({t for t, _, _ in ends})])
        self.dealt = np.array([sum(min(x, p * t) for _, x, p in ends) for t in self.times])

    def rate(self, name: str, size):
        return self.shares.get(name) or self.left * size / self.others

    def given(self, size, rate, w: int):
        """For one queue, or arrays of their sizes and rates."""
        if not self.shares:
            return w * (size // self.windows) + w * (size % self.windows) // self.windows
        if w >= self.windows:
            return size
        time = np.interp(w * (self.total / self.windows), self.dealt, self.times)
        return np.minimum(size, np.floor(rate * time + 1e-6).astype(np.int64))

    def window(self, size: int, rate, at: int) -> int:
        """The last window before which the queue has given at ids or fewer."""
        if not self.shares:
            return ((at + 1) * self.windows - 1) // size
        low, high = 0, self.windows
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.given(size, rate, mid) <= at else (low, mid)
        return low

    def cuts(self, name: str, size: int, at: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(window, at, length) of the ids at .. at + n of a queue, cut at the borders of windows."""
        rate, end = self.rate(name, size) if self.shares else None, at + n
        while at < end:
            w = self.window(size, rate, at)
            take = min(end, int(self.given(size, rate, w + 1))) - at
            yield w, at, take
            at += take


class Dealer:
    """Places of ids in the stream of all windows, for queue lengths that need not be alike."""

    def __init__(self, lengths: list[int], window: int, names: list[str] | None = None, shares: dict[str, float] | None = None):
        self.names = names or [str(k) for k in range(len(lengths))]
        self.lengths, self.total = lengths, sum(lengths)
        self.schedule = Schedule(self.total, window, shares, {q: x for q, x in zip(self.names, lengths) if shares and q in shares})
        self.windows, self.sizes = self.schedule.windows, np.array(lengths, np.int64)
        self.rates = np.array([self.schedule.rate(q, x) for q, x in zip(self.names, lengths)]) if shares else None
        self.kept: dict[int, tuple[np.ndarray, int]] = {}

    def given(self, w: int) -> tuple[np.ndarray, int]:
        """What each queue has given before window w, and their sum."""
        got = self.kept.get(w)
        if got is None:
            if len(self.kept) > 64:
                self.kept.clear()
            each = self.schedule.given(self.sizes, self.rates, w)
            got = self.kept[w] = (each, int(each.sum()))
        return got

    def runs(self, queue: int, at: int, n: int) -> Iterator[tuple[int, int]]:
        """(place, length) of the ids at .. at + n of a queue, cut at the borders of windows."""
        for w, at, take in self.schedule.cuts(self.names[queue], self.lengths[queue], at, n):
            before, start = self.given(w)
            after, _ = self.given(w + 1)
            yield start + int((after[:queue] - before[:queue]).sum()) + at - int(before[queue]), take


def _in_order(placed: DataFrame, schedule: Schedule, sequence: int, n: int) -> DataFrame:
    """The pieces of placed (queue, doc_id, at, n, ids, size) for any number of queues."""

    def cut():
        def rows(batch: pa.RecordBatch):
            for name, doc_id, first, long, ids, size in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), batch.column(5).to_pylist()):
                raw = ids.as_py()
                for w, at, take in schedule.cuts(name, size, first, long):
                    yield w, name, at, doc_id, at - first, take, long, raw[2 * (at - first) : 2 * (at - first + take)]

        return rows

    runs = map_rows(placed.select("queue", "doc_id", "at", "n", "ids", "size"), "w long, queue string, at long, doc_id long, start long, take long, n long, ids binary", cut)
    ordered = runs.repartitionByRange(n, "w", "queue", "at").sortWithinPartitions("w", "queue", "at")

    def summed():
        part = TaskContext.get().partitionId()

        def stream(batches):
            before = 0
            for batch in batches:
                for doc_id, start, take, long, ids in zip(*(batch.column(k).to_pylist() for k in range(3, 7)), batch.column(7)):
                    yield part, before, doc_id, start, take, long, ids.as_py()
                    before += take

        return stream

    made = table(map_stream(ordered, "part int, before long, doc_id long, start long, take long, n long, ids binary", summed), "dealt")
    sums = sorted((r.part, r.n) for r in made.groupBy("part").agg(F.sum("take").alias("n")).collect())  # a row for each partition
    ahead, so_far = {}, 0
    for part, size in sums:
        ahead[part], so_far = so_far, so_far + size

    def pieces():
        def rows(batch: pa.RecordBatch):
            for part, before, doc_id, start, length, size, ids in zip(*(batch.column(k).to_pylist() for k in range(6)), batch.column(6)):
                wide, to, at = np.frombuffer(ids.as_py(), "<u2").astype("<u4"), ahead[part] + before, 0
                while at < length:
                    take = min(length - at, sequence - to % sequence)
                    yield doc_id, start + at, take, zlib.crc32(wide[at : at + take]), size, to // sequence, to % sequence
                    at, to = at + take, to + take

        return rows

    return map_rows(made, PIECES, pieces)


def pack(docs: DataFrame, path: str, end_id: int = 0, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES, shares: dict[str | None, float] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of docs (doc_id, text, source).

    A null or empty text is end_id alone. A null source is a queue of its own. shares are the target shares of some or
    all sources in the windows; the others divide the rest by their lengths, and without shares all do. Rows of one
    doc_id stand in the order of their texts. No rows give no pieces.
    """
    n = shuffle_partitions(docs.sparkSession)
    names = docs.select("source").distinct().limit(MOST_QUEUES + 1).count()
    wanted = {"n" if q is None else f"s{q}": x for q, x in (shares or {}).items()}
    queue = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    dealt = docs.select(queue.alias("queue"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "queue", "doc_id").sortWithinPartitions("queue", "doc_id", "text")

    def tokenized():
        encode, end, part = encoder(__name__, path, keeps_space=True).encode, struct.pack("<H", end_id), TaskContext.get().partitionId()

        def stream(batches):
            now, before = None, 0
            for batch in batches:
                for name, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    ids = encode(text.as_py()) + end
                    if name != now:
                        now, before = name, 0
                    yield part, name, doc_id, before, len(ids) // 2, ids
                    before += len(ids) // 2

        return stream

    made = table(map_stream(dealt, "part int, queue string, doc_id long, before long, n long, ids binary", tokenized), "packed_ids")
    sums = made.groupBy("queue", "part").agg(F.sum("n").alias("n"))  # a row for each partition and queue border, no more
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = table(sums.select("queue", "part", ahead.alias("ahead")), "queue_starts")
    if names > MOST_QUEUES:
        sizes = table(sums.groupBy("queue").agg(F.sum("n").alias("size")), "queue_sizes")
        there = {r.queue: r.size for r in sizes.where(F.col("queue").isin(list(wanted))).collect()} if wanted else {}
        schedule = Schedule(sizes.agg(F.sum("size")).first()[0], sequence * window_sequences, {q: wanted[q] for q in there}, there)
        placed = made.join(sized(table(starts.join(sizes, "queue"), "queue_places")), ["queue", "part"]).select("queue", "doc_id", (F.col("ahead") + F.col("before")).alias("at"), "n", "ids", "size")
        return _in_order(placed, schedule, sequence, n)
    totals = sorted((r.queue, r.n) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect())  # MOST_QUEUES + 1 rows at most
    place = {name: k for k, (name, _) in enumerate(totals)}
    lengths = [x for _, x in totals]

    def pieces():
        dealer = Dealer(lengths, sequence * window_sequences, list(place), {q: x for q, x in wanted.items() if q in place})

        def rows(batch: pa.RecordBatch):
            for name, doc_id, at, size, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                raw, start = ids.as_py(), 0
                wide = np.frombuffer(raw, "<u2").astype("<u4")
                spans: list[list[int]] = []
                for to, length in dealer.runs(place[name], at, size):
                    if spans and spans[-1][0] + spans[-1][1] == to:
                        spans[-1][1] += length
                    else:
                        spans.append([to, length])
                for to, length in spans:
                    while length:
                        take = min(length, sequence - to % sequence)
                        yield doc_id, start, take, zlib.crc32(wide[start : start + take]), size, to // sequence, to % sequence
                        start, to, length = start + take, to + take, length - take

        return rows

    # queues and partitions bound the rows of starts
    placed = made.join(F.broadcast(starts), ["queue", "part"]).select("queue", "doc_id", (F.col("ahead") + F.col("before")).alias("at"), "n", "ids")
    return map_rows(placed, PIECES, pieces)
