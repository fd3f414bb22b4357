"""Simple-8b: whole numbers in 64-bit words.

The top four bits of a word select how many numbers it holds and with how many bits each (``SELECTORS``). The packer takes, from left to right,
the selector with most numbers whose next numbers all fit. A number of more than 60 bits is an escape: its word holds the selector alone and
the number stands, as it is, in a list of its own. Words end at block borders, so each block is decoded without those before it.
"""

from __future__ import annotations

import numpy as np

#: Count and bits by selector, fixed by the format. Selector 1 is the escape.
SELECTORS = ((240, 0), (1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 1
_COUNT = np.array([n for n, _ in SELECTORS], np.int64)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_TOP = np.uint64(60)
_WALL = 255
_BITS = np.array([i.bit_length() for i in range(1 << 17)], np.uint8)


def pack(values: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word and the escapes before each block of ``block`` numbers (two columns), and the escapes."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
    values = values.astype(np.uint64)
    blocks = -(-n // block)
    bits = np.full((blocks, block + 1), _WALL, np.uint8)  # a wall after each block, which no word crosses
    wide = np.full(blocks * block, _WALL, np.uint8)
    wide[:n] = _BITS[values.astype(np.int32)] if values.max() < len(_BITS) else np.searchsorted(_POWERS, values, side="right")
    bits[:, :-1] = wide.reshape(blocks, block)
    bits = bits.reshape(-1)
    least = int(wide.min())
    best = np.full(len(bits), ESCAPE, np.uint8)
    most = {1: bits}  # the largest of the next 1, 2, 4, .. numbers
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[s]
        if s == ESCAPE or width < least or count > len(bits):
            continue
        p = 1
        while 2 * p <= count:
            if 2 * p not in most:
                most[2 * p] = np.maximum(most[p][:-p], most[p][p:])
            p *= 2
        end = len(bits) - count + 1
        fits = np.maximum(most[p][:end], most[p][count - p : count - p + end]) <= width
        if fits.any():
            np.copyto(best[:end], np.uint8(s), where=fits)
    end = len(bits) - 1 - (blocks * block - n)
    jump = np.minimum(np.arange(end + 1, dtype=np.int32) + _COUNT.astype(np.uint8)[best[: end + 1]], end, dtype=np.int32)
    jumps = [jump]  # a word begins where the one before it ends; a wall is a word that is left out; by 1, 2, 4, .. words
    while len(jumps) < 6:
        jumps.append(jumps[-1][jumps[-1]])
    far, starts, i = memoryview(jumps.pop()), [], 0
    while i < end:
        starts.append(i)
        i = far[i]
    first = np.array(starts, np.int64)
    for jump in reversed(jumps):
        first = np.stack([first, jump[first]], axis=1).reshape(-1)
    first = first[first < end]
    first = first[first % (block + 1) < block]
    chosen = best[first].astype(np.int64)
    first -= first // (block + 1)
    words = chosen.astype(np.uint64) << _TOP
    for s in np.unique(chosen):
        count, width = SELECTORS[s]
        if s == ESCAPE or not width:
            continue
        rows = np.flatnonzero(chosen == s)
        at, packed = first[rows], words[rows]
        for k in range(count):
            packed |= values[at + k] << np.uint64(k * width)
        words[rows] = packed
    escaped = chosen == ESCAPE
    of_block = np.searchsorted(first, np.arange(0, n, block))
    before = np.concatenate([[0], np.cumsum(escaped)])[of_block]
    return words, np.stack([of_block, before], axis=1), values[first[escaped]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The numbers of a run of whole blocks, one selector at a time."""
    chosen = (words >> _TOP).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(_COUNT[chosen])])
    out = np.zeros(int(starts[-1]), np.uint64)
    for s in np.unique(chosen):
        count, width = SELECTORS[s]
        rows = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[starts[rows]] = escapes
        elif width:
            mask = np.uint64((1 << width) - 1)
            out[starts[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> (np.arange(count) * width).astype(np.uint64)) & mask
    return out
