"""Elias-Fano sequences: sorted integers in about 2 + log2(universe / n) bits each, searched without decoding."""

import mmap

import numpy as np


def packed(arrays: list[np.ndarray]) -> bytes:
    """The arrays one after another, each from a multiple of 8 bytes on, behind a table of their types and sizes."""
    head = np.array([(KINDS.index(a.dtype.str), len(a)) for a in arrays], np.int64)
    return b"".join([np.int64(len(arrays)).tobytes(), head.tobytes(), *(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)])


#: Types that packed() knows.
KINDS = ("|u1", "<i4", "<u2", "<i8", "<u8", "<f4")


def mapped(data: bytes) -> list[np.ndarray]:
    """The arrays of packed() as read-only views of a memory map, so that a level is paged and searched in place. The map is anonymous, since a task has no file of its own on a cluster."""
    view = mmap.mmap(-1, max(8, len(data)))
    view.write(data)
    n = int(np.frombuffer(view, np.int64, 1)[0])
    out, at = [], 8 + 16 * n
    for kind, size in np.frombuffer(view, np.int64, 2 * n, 8).reshape(n, 2).tolist():
        out.append(np.frombuffer(view, KINDS[kind], size, at))
        at += -(-out[-1].nbytes // 8) * 8
    return out


class EliasFano:
    """Non-decreasing uint64 values below universe. Low bits are packed one after another; high bits are in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n = len(values)
        self.low_bits = max(0, (universe // max(1, self.n)).bit_length() - 1)
        bits = np.uint64(self.low_bits)
        offset = np.arange(self.n, dtype=np.uint64) * bits
        self.low = np.zeros(int(self.n * self.low_bits) // 64 + 2, np.uint64)
        self.mask = np.uint64((1 << self.low_bits) - 1)
        if self.low_bits:
            part = values & self.mask
            word, shift = offset >> np.uint64(6), offset & np.uint64(63)
            np.bitwise_or.at(self.low, word, part << shift)
            spills = shift + bits > np.uint64(64)
            np.bitwise_or.at(self.low, word[spills] + np.uint64(1), part[spills] >> (np.uint64(64) - shift[spills]))
        high = values >> bits
        ones = high.astype(np.int64) + np.arange(self.n)
        unary = np.zeros((int(ones[-1]) + 1 if self.n else 0) + 7 & ~7, np.uint8)
        unary[ones] = 1
        self.high = np.packbits(unary)
        self._starts = None

    def starts(self) -> np.ndarray:
        """The index of the first value of each high part and above; made from the unary bits when first wanted."""
        if self._starts is None:
            ones = np.flatnonzero(np.unpackbits(self.high))
            high = ones - np.arange(len(ones))
            count = np.bincount(high, minlength=1)
            self._starts = np.concatenate([[0], np.cumsum(count)]).astype(np.int32 if self.n < 1 << 31 else np.int64)
        return self._starts

    def low_of(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bits = np.uint64(self.low_bits)
        offset = at.astype(np.uint64) * bits
        word, shift = offset >> np.uint64(6), offset & np.uint64(63)
        found = self.low[word] >> shift
        over = shift + bits > np.uint64(64)
        found[over] |= self.low[word[over] + np.uint64(1)] << (np.uint64(64) - shift[over])
        return found & self.mask

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the first value that isn't below each wanted one (n if there is none), and whether the two are equal."""
        starts = self.starts()
        high = np.minimum(wanted >> np.uint64(self.low_bits), np.uint64(len(starts) - 1)).astype(np.int64)
        beyond = high == len(starts) - 1
        low = wanted & self.mask
        start, end = starts[high].astype(np.int64), starts[np.minimum(high + 1, len(starts) - 1)].astype(np.int64)
        stop = end.copy()
        open_ = np.flatnonzero(start < end)
        while len(open_):  # binary search among the values of the same high part
            middle = (start[open_] + end[open_]) >> 1
            less = self.low_of(middle) < low[open_]
            start[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[start[open_] < end[open_]]
        equal = (start < stop) & ~beyond
        equal[equal] = self.low_of(start[equal]) == low[equal]
        return start, equal

    def access(self, at: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.starts(), at, side="right") - 1
        return high.astype(np.uint64) << np.uint64(self.low_bits) | self.low_of(at)

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes
