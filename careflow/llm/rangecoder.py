"""Adaptive context-mixing coder for token ids, with numbers in place of a range (rANS).

A chunk's header names the ids that occur in it and about how often; within the chunk an id is
its place among them. The chunk falls into blocks that are coded side by side, one array lane
each, a step of all lanes at a time. All lanes share one model, which learns from a step before
the next: the last id seen after the two ids before (order 2) and after the one before (order 1)
are predictions. Their standings, taken together, choose how much of the whole each gets, by
how often such predictions came true. The rest goes to order 0: the header's frequencies, to
which the counts of the ids that no order predicted are added every `REBUILD` steps. The shares are
added up: an id that an order predicts has that order's share and, at its own place, its part
of order 0's, of which the coder takes the former.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES = 2048, 4096
# Bits of the whole of a step and, at least, of order 0, which always gets that many.
TOTAL_BITS, ZERO_BITS = 28, 20
# The frequencies of the header count as PRIOR ids together.
PRIOR, REBUILD = 1 << 16, 256
TABLE2 = 18
STAND, ID_MASK = 20, (1 << 20) - 1
# What a prediction's standing (0: none, to 7) loses when it failed and, in every second place, gains
# when it came true. Of standing 0 or 1 it is replaced when it failed.
CHANGE = np.array([0, 1, 0, 1, -1, 1, -1, 1, -2, 1, -2, 1, -3, 1, -3, 0], np.int32) << STAND
REPLACED = np.arange(16) < 4
REPLACED[1::2] = False
# A part of order 0 in one number: where it begins, above the bits of its width.
PART_BITS, PART_MASK = 24, (1 << 24) - 1
TOTAL_MASK = (1 << TOTAL_BITS) - 1
# A lane's number before its last id is coded, and the least one between steps; bits of a word.
FIRST, WORD = np.uint64(1 << 31), np.uint64(32)
# States of both predictions: their standings and whether they agree. Three outcomes each.
STATES = 128
# Steps after which the shares follow the counts of outcomes, and counts at which all are halved.
FOLLOW, OUTCOMES = 4, 1 << 16


class Model:
    """What all lanes share; the first `k` lanes are active."""

    def __init__(self, lanes: int, weights: np.ndarray):
        self.runs = len(weights)
        self.zero_bits = max(ZERO_BITS, self.runs.bit_length() + 2)
        self.weights = weights * (PRIOR / max(1, int(weights.sum())))
        self.counts = np.zeros(self.runs, np.int64)
        self.seen: list[np.ndarray] = []
        self.t1, self.t2 = np.zeros(self.runs + 1, np.int32), np.zeros(1 << TABLE2, np.int32)
        self.last1, self.last2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.outcomes = np.ones((STATES, 3), np.int64)
        self.step = 0
        self._rebuild()
        self._follow()

    def _rebuild(self) -> None:
        """Order 0 from the prior and the counts, scaled to its bits; every id keeps a part."""
        sums = np.cumsum((self.weights * (1 << 20)).astype(np.int64) + 1 + (self.counts << 20))
        least = np.arange(1, self.runs + 1)
        free = (1 << self.zero_bits) - self.runs
        self.first = np.zeros(self.runs + 1, np.int64)
        if self.runs:
            self.first[1:] = (sums / sums[-1] * free).astype(np.int64) + least
            self.first[-1] = 1 << self.zero_bits
        widths = np.diff(self.first)
        self.parts = (self.first[:-1] << PART_BITS) + widths
        self.place = np.repeat(np.arange(self.runs, dtype=np.int32), widths)

    def _follow(self) -> None:
        """The shares by state: of order 2 and of order 1; order 0 has the rest."""
        free = (1 << TOTAL_BITS) - (1 << self.zero_bits)
        state = np.arange(STATES)
        stand2, stand1, agree = state >> 3 & 7, state & 7, state >> 6
        all_of = self.outcomes.sum(axis=1)
        share2 = self.outcomes[:, 2] * free // all_of * (stand2 > 0)
        share1 = self.outcomes[:, 1] * free // all_of * ((stand1 > 0) & (agree == 0))
        self.shares = (share2 << TOTAL_BITS) + share1

    def predict(self, k: int):
        """Shares of order 2 and 1. p2 and p1 are the predicted ids plus 1 (0: none)."""
        a, b = self.last1[:k], self.last2[:k]
        self.at1, self.at2 = a, (a * 2654435761 + b * 40503 >> 7) & ((1 << TABLE2) - 1)
        self.e1, self.e2 = self.t1.take(a), self.t2.take(self.at2)
        self.p1, self.p2 = self.e1 & ID_MASK, self.e2 & ID_MASK
        self.s1, self.s2 = self.e1 >> STAND, self.e2 >> STAND
        self.state = ((self.p1 == self.p2).astype(np.int64) << 6) + ((self.s2 << 3) + self.s1)
        shares = self.shares.take(self.state)
        return shares >> TOTAL_BITS, shares & TOTAL_MASK

    def part(self, ids: np.ndarray, share2: np.ndarray, share1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of what the ids take of the whole; which orders predicted them."""
        before = share2 + share1
        share0, part = (1 << TOTAL_BITS) - before, self.parts.take(ids)
        first = part >> PART_BITS
        zero = first * share0 >> self.zero_bits
        width = (((part & PART_MASK) + first) * share0 >> self.zero_bits) - zero
        self.coded = (ids + 1).astype(np.int32)
        self.hit2, self.hit1 = self.p2 == self.coded, self.p1 == self.coded
        self.by2 = self.hit2 & (share2 > 0)
        self.by1 = self.hit1 & (share1 > 0) & ~self.by2
        start = zero + before
        np.copyto(start, share2, where=self.by1)
        np.copyto(start, 0, where=self.by2)
        np.copyto(width, share1, where=self.by1)
        np.copyto(width, share2, where=self.by2)
        return start, width

    def find(self, value: np.ndarray, share2: np.ndarray, share1: np.ndarray) -> np.ndarray:
        """The ids that hold the values."""
        before = share2 + share1
        share0 = (1 << TOTAL_BITS) - before
        # The last place of order 0 that begins at or below the value. Both numbers are far below
        # 2^53 and the quotient's distance to the next whole number is above its rounding.
        rest = np.maximum(value - before, 0)
        ids = self.place.take((((rest + 1 << self.zero_bits) - 1) / share0).astype(np.int64))
        ids = ids.astype(np.int64)
        np.copyto(ids, self.p1 - 1, where=value < before)
        np.copyto(ids, self.p2 - 1, where=value < share2)
        return ids

    def update(self, k: int, ids: np.ndarray) -> None:
        new = self.coded | np.int32(1 << STAND)
        # Of lanes with the same context the last one counts.
        for table, at, entry, stand, hit in (
            (self.t1, self.at1, self.e1, self.s1, self.hit1), (self.t2, self.at2, self.e2, self.s2, self.hit2),
        ):
            case = (stand << 1) + hit
            entry = entry + CHANGE.take(case)
            np.copyto(entry, new, where=REPLACED.take(case))
            table[at] = entry
        every = np.bincount(self.state, minlength=STATES)
        true2 = np.bincount(self.state[self.by2], minlength=STATES)
        true1 = np.bincount(self.state[self.by1], minlength=STATES)
        self.outcomes += np.stack([every - true2 - true1, true1, true2], axis=1)
        self.last2[:k] = self.last1[:k]
        self.last1[:k] = self.coded
        self.seen.append(ids[~(self.by1 | self.by2)])
        self.step += 1
        if self.step % FOLLOW == 0:
            self.outcomes[self.outcomes.sum(axis=1) > OUTCOMES] >>= 1
            np.maximum(self.outcomes, 1, out=self.outcomes)
            self._follow()
        if self.step % REBUILD == 0:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.runs)
            self.seen = []
            self._rebuild()


def encode_lanes(lanes: np.ndarray, last: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row per step, a column per lane, of which the last one ends after `last` steps: the lanes'
    numbers and the words that follow, in the order in which they are read."""
    steps, n = lanes.shape
    model = Model(n, weights)
    starts, widths = np.zeros((steps, n), np.uint32), np.zeros((steps, n), np.uint32)
    for i in range(steps):
        k = n if i < last else n - 1
        now = lanes[i, :k].astype(np.int64)
        starts[i, :k], widths[i, :k] = model.part(now, *model.predict(k))
        model.update(k, now)
    # The numbers grow from the last step to the first; a reader takes them apart again.
    state, words = np.full(n, FIRST), []
    for i in range(steps - 1, -1, -1):
        k = n if i < last else n - 1
        x, width = state[:k], widths[i, :k].astype(np.uint64)
        full = np.flatnonzero(x >> np.uint64(63 - TOTAL_BITS) >= width)
        words.append(x[full].astype(np.uint32))
        x[full] >>= WORD
        ratio = x // width
        x[:] = (ratio << np.uint64(TOTAL_BITS)) + (x - ratio * width) + starts[i, :k]
    return state, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decode_lanes(state: np.ndarray, words: np.ndarray, steps: int, last: int, weights: np.ndarray) -> np.ndarray:
    """The ids, a row per step."""
    n, at = len(state), 0
    model, state = Model(n, weights), state.copy()
    lanes = np.zeros((steps, n), np.int32)
    whole = np.uint64(TOTAL_MASK)
    for i in range(steps):
        k = n if i < last else n - 1
        x = state[:k]
        value = (x & whole).astype(np.int64)
        share2, share1 = model.predict(k)
        now = model.find(value, share2, share1)
        start, width = model.part(now, share2, share1)
        x[:] = width.astype(np.uint64) * (x >> np.uint64(TOTAL_BITS)) + (value - start).astype(np.uint64)
        low = np.flatnonzero(x < FIRST)
        if at + len(low) > len(words):
            raise ValueError("a chunk of ids ends early")
        x[low] = (x[low] << WORD) | words[at : at + len(low)]
        at += len(low)
        lanes[i, :k] = now
        model.update(k, now)
    if at < len(words) or (state != FIRST).any():
        raise ValueError("a chunk of ids does not end where it should")
    return lanes


MAGIC = b"CFT3"


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte each: eight steps to a doubling."""
    top = np.floor(np.log2(counts)).astype(np.int64)
    return ((top << 3) + ((counts << 3 >> top) & 7)).astype(np.uint8)


def _weights(levels: np.ndarray) -> np.ndarray:
    levels = levels.astype(np.int64)
    return np.maximum(1, (8 + (levels & 7)) << (levels >> 3) >> 3)


def write_chunk(ids: np.ndarray, vocabulary: int) -> bytes:
    """A stream of ids as one chunk: header, the ids that occur and their levels, a line per block (ids
    and their crc32), the blocks' numbers and words."""
    counts = np.bincount(ids.astype(np.int64))
    there = np.flatnonzero(counts)
    levels = _levels(counts[there])
    n, size = -(-len(ids) // BLOCK), min(BLOCK, len(ids))
    last = len(ids) - (n - 1) * size
    places = np.zeros(n * size, np.int32)
    places[: len(ids)] = np.cumsum(counts > 0).astype(np.int32).take(ids.astype(np.int64)) - 1
    state, words = encode_lanes(np.ascontiguousarray(places.reshape(n, size).T) if n else places.reshape(0, 0), last, _weights(levels))
    steps = np.diff(there, prepend=0).astype("<u4")
    table = zlib.compress(steps.tobytes() + levels.tobytes())
    blocks = [ids[i : i + BLOCK].astype("<u4").tobytes() for i in range(0, len(ids), BLOCK)]
    lines = [struct.pack("<II", len(b) // 4, zlib.crc32(b)) for b in blocks]
    head = b"".join([MAGIC, struct.pack("<IIIII", vocabulary, size, n, len(there), len(table)), table, *lines])
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), state.astype("<u8").tobytes(), words.astype("<u4").tobytes()])


def read_chunk(data: bytes) -> np.ndarray:
    """The ids of a chunk. Raises if it is not one or a checksum differs."""
    if data[:4] != MAGIC:
        raise ValueError("not a chunk of coded ids")
    _, steps, n, alphabet, size = struct.unpack_from("<IIIII", data, 4)
    at = 24 + size + 8 * n
    if len(data) < at + 4 + 8 * n or zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("the checksum of a chunk's header differs")
    if not n:
        return np.zeros(0, "<u4")
    table = zlib.decompress(data[24 : 24 + size])
    there = np.cumsum(np.frombuffer(table, "<u4", alphabet).astype(np.int64)).astype("<u4")
    weights = _weights(np.frombuffer(table, np.uint8, alphabet, 4 * alphabet))
    lines = np.frombuffer(data, "<u4", 2 * n, 24 + size).reshape(n, 2)
    state = np.frombuffer(data, "<u8", n, at + 4).astype(np.uint64)
    rest = at + 4 + 8 * n
    words = np.frombuffer(data, "<u4", (len(data) - rest) // 4, rest)
    lanes = decode_lanes(state, words, steps, int(lines[-1, 0]), weights)
    ids = there.take(np.ascontiguousarray(lanes.T).ravel()[: (n - 1) * steps + int(lines[-1, 0])])
    for i, check in enumerate(lines[:, 1].tolist()):
        if zlib.crc32(ids[i * steps : (i + 1) * steps]) != check:
            raise ValueError("the checksum of a block of ids differs")
    return ids
