"""Elias-Fano sequences and the n-gram trie on them, as views of one buffer.

A level is written once as bytes and then only viewed (numpy views of a mapped
buffer); no query copies or unpacks a level.
"""

from __future__ import annotations

import struct

import numpy as np

#: Codes of quantised weights: 1/128 octave from 2^-32 to 1; 0 is none.
CODE_BITS, OCTAVE, LOWEST = 12, 128, 32


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Bytes of `values` in `width` bits each, with 8 spare bytes for reads that go past the end."""
    bits = np.empty((len(values), width), np.uint8)
    for k in range(width):
        bits[:, k] = values >> np.uint64(k) & np.uint64(1)
    return np.concatenate([np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8)])


def unpack(packed: np.ndarray, width: int, places: np.ndarray) -> np.ndarray:
    """The values at `places`; widths are at most 56."""
    start = places * width
    byte, found = start >> 3, np.zeros(len(places), np.uint64)
    for k in range(-(-(width + 7) // 8)):
        found |= packed[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return found >> (start & 7).astype(np.uint64) & np.uint64((1 << width) - 1)


class Monotone:
    """A non-decreasing sequence: low bits packed, high bits in unary, and the zeros before each 64 of those."""

    def __init__(self, buffer: memoryview | bytes, at: int = 0):
        self.size, self.width, lows, highs, blocks = struct.unpack_from("<QIQQQ", buffer, at)
        at += struct.calcsize("<QIQQQ")
        self.lows = np.frombuffer(buffer, np.uint8, lows, at)
        self.highs = np.frombuffer(buffer, np.uint8, highs, at + lows)
        self.zeros = np.frombuffer(buffer, "<u4", blocks, at + lows + highs)
        self.end = at + lows + highs + 4 * blocks

    @staticmethod
    def write(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        size, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (max(top, 1) // max(size, 1)).bit_length() - 1)
        high = values >> np.uint64(width)
        length = size + (top >> width) + 2
        bits = np.zeros(-(-length // 64) * 64, np.uint8)
        bits[high.astype(np.int64) + np.arange(size)] = 1
        ones = bits.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        zeros = np.concatenate([[0], np.cumsum(64 - ones)]).astype("<u4")
        lows = pack(values & np.uint64((1 << width) - 1), width) if width else np.zeros(8, np.uint8)
        # Whole buffers start at multiples of 4, for the directory.
        lows = np.concatenate([lows, np.zeros(-len(lows) % 4, np.uint8)])
        highs = np.packbits(bits, bitorder="little")
        return struct.pack("<QIQQQ", size, width, len(lows), len(highs), len(zeros)) + lows.tobytes() + highs.tobytes() + zeros.tobytes()

    def _select_zero(self, number: np.ndarray) -> np.ndarray:
        """The place in the high bits of each zero, counted from 0."""
        block = np.searchsorted(self.zeros, number, "right") - 1
        left = (number - self.zeros[block]).astype(np.int64)
        out = np.empty(len(number), np.int64)
        words = self.highs.reshape(-1, 8)
        for start in range(0, len(number), 1 << 15):
            part = slice(start, start + (1 << 15))
            empty = np.unpackbits(words[block[part]], axis=1, bitorder="little") == 0
            out[part] = (np.cumsum(empty, axis=1, dtype=np.uint8) > left[part, None]).argmax(axis=1)
        return block * 64 + out

    def at_places(self, places: np.ndarray) -> np.ndarray:
        """The values at `places`."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        block = np.searchsorted(ones, places, "right") - 1
        left = places - ones[block]
        out = np.empty(len(places), np.int64)
        words = self.highs.reshape(-1, 8)
        for start in range(0, len(places), 1 << 15):
            part = slice(start, start + (1 << 15))
            full = np.unpackbits(words[block[part]], axis=1, bitorder="little")
            out[part] = (np.cumsum(full, axis=1, dtype=np.uint8) > left[part, None]).argmax(axis=1)
        high = (block * 64 + out - places).astype(np.uint64)
        return high << np.uint64(self.width) | (unpack(self.lows, self.width, places) if self.width else np.uint64(0))

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, whether it is equal) of the first element that is not less than each value."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        most = int(self.zeros[-1]) - 1
        inside = high <= most
        index, equal = np.full(len(values), self.size, np.int64), np.zeros(len(values), bool)
        rows = np.flatnonzero(inside)
        # Elements with this high part lie between two zeros; their low parts are searched by halves.
        high, low = high[rows], values[rows] & np.uint64((1 << self.width) - 1)
        first = np.where(high > 0, self._select_zero(np.maximum(high - 1, 0)) + 1, 0) - high
        end = self._select_zero(high) - high
        bottom, top = first.copy(), end.copy()
        open_ = np.flatnonzero(bottom < top) if self.width else np.empty(0, np.int64)
        while len(open_):
            middle = (bottom[open_] + top[open_]) >> 1
            less = unpack(self.lows, self.width, middle) < low[open_]
            bottom[open_[less]] = middle[less] + 1
            top[open_[~less]] = middle[~less]
            open_ = open_[bottom[open_] < top[open_]]
        index[rows] = bottom
        there = np.flatnonzero(bottom < end)
        equal[rows[there]] = unpack(self.lows, self.width, bottom[there]) == low[there] if self.width else True
        return index, equal


def quantise(weights: np.ndarray) -> np.ndarray:
    return np.clip(np.round((np.log2(weights) + LOWEST) * OCTAVE), 1, (1 << CODE_BITS) - 1).astype(np.uint64)


def weight(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2(codes / OCTAVE - LOWEST), 0.0)


class Trie:
    """Two levels: contexts with pointers, and their successors with quantised weights.

    The successors of all contexts are one sequence: each is raised by
    `span` times the number of its context, so the sequence never falls and a
    successor is searched relative to its context.
    """

    def __init__(self, buffer: bytes):
        (self.span,) = struct.unpack_from("<Q", buffer, 0)
        self.contexts = Monotone(buffer, 8)
        self.pointers = Monotone(buffer, self.contexts.end)
        self.successors = Monotone(buffer, self.pointers.end)
        self.codes = np.frombuffer(buffer, np.uint8, -1, self.successors.end)

    @staticmethod
    def write(contexts: np.ndarray, successors: np.ndarray, weights: np.ndarray) -> bytes:
        """From (context, successor) sorted and distinct, and the weight of each."""
        span = int(successors.max()) + 1 if len(successors) else 1
        own, first = np.unique(contexts, return_index=True)
        number = np.searchsorted(own, contexts).astype(np.uint64)
        raised = number * np.uint64(span) + successors.astype(np.uint64)
        return struct.pack("<Q", span) + Monotone.write(own) + Monotone.write(np.append(first, len(contexts))) + Monotone.write(raised) + pack(quantise(weights), CODE_BITS).tobytes()

    def find(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """The code of each n-gram, 0 for those that aren't there."""
        number, known = self.contexts.successor(contexts)
        known &= successors < self.span
        codes, rows = np.zeros(len(contexts), np.uint64), np.flatnonzero(known)
        if len(rows):
            index, equal = self.successors.successor(number[rows].astype(np.uint64) * np.uint64(self.span) + successors[rows].astype(np.uint64))
            codes[rows[equal]] = unpack(self.codes, CODE_BITS, index[equal])
        return codes

    def count(self, contexts: np.ndarray) -> np.ndarray:
        """The number of successors of each context, from its two pointers."""
        number, known = self.contexts.successor(contexts)
        out, rows = np.zeros(len(contexts), np.int64), np.flatnonzero(known)
        out[rows] = self.pointers.at_places(number[rows] + 1).astype(np.int64) - self.pointers.at_places(number[rows]).astype(np.int64)
        return out
