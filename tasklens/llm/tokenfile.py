"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block codes up to BLOCK_IDS ids of consecutive documents as up to MOST_LANES lanes that run side by side over one
model, each lane over a run of the block's ids. The model mixes three predictions of the next id x:

    P(x) = a * [x is the id that stands for the same two ids before it]   (order 2)
         + b * [x is the id last seen after the same id]                  (order 1)
         + c * frequency of x so far                                      (order 0)

The weights a, b and c add up to 1 and are learned for each pair of the contexts' confidences, by how often each
prediction was the first one to be right. All are whole numbers of 2^-WEIGHT_BITS, frequencies of 2^-TOTAL_BITS, so the
interval of an id is exact whole arithmetic, the same on any machine. It drives one carryless 64-bit range coder for
each lane, with 16-bit output. Model and coder start anew in each block, so any block can be read alone, and a CRC-32
of its ids is checked on reading.

Layout of a block, little-endian: magic "TLB2", u32 documents, u64 ids, u32 lanes, u32 words, u32 CRC-32 of the ids as
u16, u32 alphabet (greatest id + 1), u32 bytes of lengths; then zlib-packed u32 lengths of the documents; then `words`
u16 of code, in the order in which a decoder takes them: four for each lane, then one whenever a lane needs one. Words
of 0 at the very end are left out.

Blocks are rows of a Parquet table in the shared folder: (part, seq, doc_ids, ids, before, block), part and seq
ascending with doc_id, which Spark's own writer commits, so lost executors leave no half-written files. `before` counts
the ids of the same part's earlier blocks.
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

from tasklens.llm.common import map_rows, map_stream, shuffle_partitions, table
from tasklens.llm.tokens import encoder

MAGIC, HEADER = b"TLB2", struct.Struct("<4sIQIIIII")
BLOCK_IDS, MOST_LANES, LANE_IDS = 1 << 22, 8192, 512
TOTAL_BITS, WEIGHT_BITS, CONTEXT_BITS = 20, 10, 18
U = np.uint64
_ALL, _TOP, _BOTTOM = U(TOTAL_BITS + WEIGHT_BITS), U(1 << 48), U(1 << 40)
_S16, _S48, _LOW = U(16), U(48), U((1 << 40) - 1)
_SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Confidence of a context: 0 (never seen), then 1 to 7.
LEVELS = 8
STATES = LEVELS * LEVELS


class _Model:
    """The mixed prediction; the coder and the decoder drive it through the same steps, one for each row of lanes.

    ids are int32, which halves the memory that each step moves; places in tables are int64, as numpy wants them.
    """

    def __init__(self, alphabet: int):
        self.alphabet = alphabet
        self.one, self.two = np.zeros(1 << 16, np.int32), np.zeros(1 << CONTEXT_BITS, np.int32)  # id, level << 16
        self.counts, self.fresh = np.zeros(alphabet, np.int64), []
        # how often each prediction was the first to be right; a context never seen can't be
        self.can = np.ones((STATES, 3), np.int64)
        self.can[:LEVELS, 0] = self.can[::LEVELS, 1] = 0
        self.right = np.zeros(STATES * 4, np.int64)  # by state, order 2 right, order 1 right
        self.steps, self.next_table = 0, 0

    def tables(self) -> None:
        """The weights, and at steps that grow further apart the order-0 frequencies."""
        if self.steps == self.next_table:
            self.next_table = max(self.steps + 1, self.steps * 3 // 2)
            if self.fresh:
                self.counts += np.bincount(np.concatenate(self.fresh), minlength=self.alphabet)
                self.fresh = []
            total, spare = int(self.counts.sum()), (1 << TOTAL_BITS) - self.alphabet
            freq = 1 + (self.counts * spare // total if total else np.full(self.alphabet, spare // self.alphabet))
            freq[0] += (1 << TOTAL_BITS) - int(freq.sum())
            self.freq, self.start = freq.astype(np.int32), (np.cumsum(freq) - freq).astype(np.int32)
            self.slots = None
        if self.steps < 32 or self.steps % 4 == 0:
            # every prediction that can be right keeps a weight, however rarely it has been
            second = self.right.reshape(STATES, 2, 2) * self.can[:, :1, None]
            first = self.right.reshape(STATES, 2, 2).sum(1) - second[:, 1]
            hits = np.stack([second[:, 1].sum(1), first[:, 1] * self.can[:, 1], first[:, 0] + first[:, 1] * (1 - self.can[:, 1])], axis=1)
            hits = 2 * hits + self.can
            weights = self.can + hits * ((1 << WEIGHT_BITS) - 3) // hits.sum(axis=1, keepdims=True)
            weights[:, 2] += (1 << WEIGHT_BITS) - weights.sum(axis=1)
            self.mass2, self.mass1 = ((weights[:, k] << TOTAL_BITS).astype(np.int32) for k in range(2))
            self.mass0 = weights[:, 2].astype(np.int32)

    def slot(self, spot: np.ndarray) -> np.ndarray:
        """The ids whose order-0 intervals hold the given places."""
        if self.slots is None:
            self.slots = np.repeat(np.arange(self.alphabet, dtype=np.int32), self.freq)
        return self.slots.take(spot)

    def predict(self, last: np.ndarray, before: np.ndarray) -> None:
        self.c1 = last.astype(np.int64)
        mixed = (last.view(np.uint32) * _SPREAD[0] ^ before.view(np.uint32)) * _SPREAD[1]
        self.c2 = (mixed >> np.uint32(32 - CONTEXT_BITS)).astype(np.int64)
        one, two = self.one.take(self.c1), self.two.take(self.c2)
        self.g1, self.g2, self.l1, self.l2 = one & 0xFFFF, two & 0xFFFF, one >> 16, two >> 16
        self.state = self.l2 * LEVELS + self.l1
        at = self.state.astype(np.int64)
        self.m2, self.m1, self.w = self.mass2.take(at), self.mass1.take(at), self.mass0.take(at)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) of each lane's id."""
        at = ids.astype(np.int64)
        start = self.w * self.start.take(at) + self.m2 * (self.g2 < ids) + self.m1 * (self.g1 < ids)
        return start, self.w * self.freq.take(at) + self.m2 * (self.g2 == ids) + self.m1 * (self.g1 == ids)

    def find(self, spot: np.ndarray) -> np.ndarray:
        """The id whose interval holds each lane's spot."""
        g2, g1 = self.g2, self.g1
        same, i2, i1 = g2 == g1, g2.astype(np.int64), g1.astype(np.int64)
        m2, m1 = np.where(same, self.m2 + self.m1, self.m2), np.where(same, 0, self.m1)
        start2, start1 = self.w * self.start.take(i2) + m1 * (g1 < g2), self.w * self.start.take(i1) + m2 * (g2 < g1)
        end2, end1 = start2 + self.w * self.freq.take(i2) + m2, start1 + self.w * self.freq.take(i1) + m1
        past2, past1 = spot >= end2, spot >= end1
        place = (spot - m2 * past2 - m1 * past1) // self.w
        found = self.slot(np.minimum(place, (1 << TOTAL_BITS) - 1).astype(np.int64))
        found = np.where((spot >= start1) & ~past1, g1, found)
        return np.where((spot >= start2) & ~past2, g2, found)

    def learn(self, ids: np.ndarray) -> None:
        was2, was1 = self.g2 == ids, self.g1 == ids
        self.right += np.bincount(self.state * 4 + was2 * np.int32(2) + was1, minlength=STATES * 4)
        self.fresh.append(ids)
        self.one[self.c1] = ids | np.where(was1, np.minimum(self.l1 + 1, LEVELS - 1), 1) << 16
        # a new id takes the place of one that has not been right lately; else that one loses confidence
        stays = was2 | (self.l2 > 2)
        level = np.where(was2, np.minimum(self.l2 + 1, LEVELS - 1), np.where(stays, self.l2 >> 1, 1))
        self.two[self.c2] = np.where(stays, self.g2, ids) | level << 16
        self.steps += 1


def _shifts(low: np.ndarray, span: np.ndarray) -> Iterator[np.ndarray]:
    """The lanes that give out (or take in) a word, again and again until none does; low and span are moved on."""
    at = np.flatnonzero(((low ^ (low + span)) < _TOP) | (span < _BOTTOM))
    while len(at):
        x, s = low[at], span[at]
        tight = (x ^ (x + s)) >= _TOP
        s[tight] = (~x[tight] + U(1)) & _LOW
        yield at
        x, s = x << _S16, s << _S16
        low[at], span[at] = x, s
        at = at[((x ^ (x + s)) < _TOP) | (s < _BOTTOM)]


def _lanes(n: int) -> int:
    return max(1, min(MOST_LANES, n // LANE_IDS))


def encode_block(ids: np.ndarray, lengths: list[int]) -> bytes:
    """One block of the ids (u16) of len(lengths) documents."""
    n, lanes, alphabet = len(ids), _lanes(len(ids)), int(ids.max()) + 1 if len(ids) else 1
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.uint16)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model, out, lane_of = _Model(alphabet), [], []
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    last = before = np.zeros(lanes, np.int32)
    with np.errstate(over="ignore"):
        for row in grid:
            row = row.astype(np.int32)
            model.tables()
            model.predict(last, before)
            start, width = model.interval(row)
            unit = span >> _ALL
            low = low + unit * start.astype(np.uint64)
            span = unit * width.astype(np.uint64)
            for at in _shifts(low, span):
                out.append((low[at] >> _S48).astype("<u2"))
                lane_of.append(at.astype(np.uint16))
            model.learn(row)
            before, last = last, row
        # the least multiple of 2^32 that is not below low lies in its span, so two words settle each lane
        settled = (low + U((1 << 32) - 1)) >> U(32)
        for words in (settled >> _S16, settled & U(0xFFFF), np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)):
            out.append(words.astype("<u2"))
            lane_of.append(np.arange(lanes, dtype=np.uint16))
    code = np.empty(0, "<u2")
    if n:
        # a lane's k-th shift takes in the word that it gives out four shifts later
        lane = np.concatenate(lane_of)
        order = np.argsort(lane, kind="stable").astype(np.int32)
        words, lane = np.concatenate(out)[order], lane[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        first = np.flatnonzero(np.diff(lane, prepend=np.uint16(lanes & 0xFFFF)))
        code = np.concatenate([words[first + k] for k in range(4)] + [words[rank[: len(rank) - 4 * lanes] + 4]])
        used = np.flatnonzero(code)
        code = code[: used[-1] + 1 if len(used) else 0]
    packed = zlib.compress(np.array(lengths, "<u4").tobytes(), 6)
    return HEADER.pack(MAGIC, len(lengths), n, lanes, len(code), zlib.crc32(np.asarray(ids, "<u2").tobytes()), alphabet, len(packed)) + packed + code.tobytes()


class _Reader:
    def __init__(self, code: np.ndarray, lanes: int):
        self.code, self.at = np.concatenate([code, np.zeros(4 * lanes, code.dtype)]), 4 * lanes
        self.value = np.zeros(lanes, np.uint64)
        for k in range(4):
            self.value = self.value << _S16 | self.code[k * lanes : (k + 1) * lanes]

    def take(self, lanes: np.ndarray) -> None:
        if self.at + len(lanes) > len(self.code):  # words of 0 at the end were left out
            self.code = np.concatenate([self.code, np.zeros(len(lanes) + (1 << 16), self.code.dtype)])
        self.value[lanes] = self.value[lanes] << _S16 | self.code[self.at : self.at + len(lanes)]
        self.at += len(lanes)


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of a block; raises ValueError where magic or checksum doesn't fit."""
    magic, docs, n, lanes, words, crc, alphabet, packed = HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    lengths = np.frombuffer(zlib.decompress(block[HEADER.size : HEADER.size + packed]), "<u4")
    ids = np.empty(0, "<u2")
    if n:
        steps = -(-n // lanes)
        grid = np.empty((steps, lanes), np.uint16)
        model = _Model(alphabet)
        low, span = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
        queue = _Reader(np.frombuffer(block, "<u2", words, HEADER.size + packed).astype(np.uint64), lanes)
        last = before = np.zeros(lanes, np.int32)
        top = U((1 << int(_ALL)) - 1)
        with np.errstate(over="ignore"):
            for k in range(steps):
                model.tables()
                model.predict(last, before)
                unit = span >> _ALL
                row = model.find(np.minimum((queue.value - low) // unit, top).astype(np.int32))
                start, width = model.interval(row)
                low = low + unit * start.astype(np.uint64)
                span = unit * width.astype(np.uint64)
                for at in _shifts(low, span):
                    queue.take(at)
                model.learn(row)
                before, last = last, row
                grid[k] = row
        ids = grid.T.reshape(-1)[:n].astype("<u2")
    if len(lengths) != docs or int(lengths.sum()) != n or zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a token block's checksum doesn't fit")
    return ids, lengths


def write_blocks(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Writes the block table of docs (doc_id, text) in ascending doc_id order and returns it as read back.

    Null text counts as empty: its only id is end_id. Rows of one doc_id stand in the order of their texts; a null
    doc_id comes first. path is a tokenizers file of fewer than 65,536 ids that drops white space between words.
    """
    n = shuffle_partitions(docs.sparkSession)
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def make():
        encode, end = encoder(__name__, path, keeps_space=False).encode, struct.pack("<H", end_id)
        part, state = TaskContext.get().partitionId(), {"seq": 0, "before": 0}

        def blocks(batches: Iterator[pa.RecordBatch]):
            held, docs_held, size = [], [], 0

            def block():
                raw = b"".join(held)
                ids = np.frombuffer(raw, "<u2")
                row = (part, state["seq"], list(docs_held), len(ids), state["before"], encode_block(ids, [len(x) // 2 for x in held]))
                state["seq"] += 1
                state["before"] += len(ids)
                return row

            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    held.append(encode(text.as_py()) + end)
                    docs_held.append(doc_id)
                    size += len(held[-1]) // 2
                    if size >= BLOCK_IDS:
                        yield block()
                        held, docs_held, size = [], [], 0
            if held:
                yield block()

        return blocks

    schema = "part int, seq int, doc_ids array<long>, ids long, before long, block binary"
    return table(map_stream(dealt, schema, make), "tokens")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a block table, from the decoded blocks."""
    totals = blocks.groupBy("part").agg(F.sum("ids").alias("ids"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("start"))

    def make():
        def rows(batch: pa.RecordBatch):
            for doc_ids, start, block in zip(*(batch.column(k) for k in range(3))):
                ids, lengths = decode_block(block.as_py())
                wide, at = ids.astype("<u4"), 0
                for doc_id, n in zip(doc_ids.as_py(), lengths.tolist()):
                    yield doc_id, start.as_py() + at, n, zlib.crc32(wide[at : at + n])
                    at += n

        return rows

    # one row for each part, so no more than the shuffle has partitions
    placed = blocks.join(F.broadcast(starts), "part").select("doc_ids", (F.col("start") + F.col("before")).alias("start"), "block")
    return map_rows(placed, "doc_id long, start long, n_tokens long, ids_crc32 long", make)
