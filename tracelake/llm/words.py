"""64-bit word hashes of whole Arrow batches, and rolling hashes of word windows.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is what ``bytes.split()`` gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xBF58476D1CE4E5B9)
_KEPT_WORDS = 150_000
#: Bytes of text hashed at a time, unless one text has more; bounds the arrays of a worker.
CHUNK_BYTES = 2_000_000


class WordHashes(dict):
    """Word -> 64-bit hash; forgets all when it holds too many, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows: what a worker holds as Python objects, and sends back at once, stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def chunks(texts: list, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` bytes (or characters) each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def hash_words(texts: list[bytes | None], known: WordHashes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts one after another, and where each text's words begin (one entry more than texts)."""
    get, parts, starts = known.__getitem__, [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words = (text.lower() if lower else text).split() if text else []
        starts[i + 1] = starts[i] + len(words)
        if words:
            parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), starts


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _END
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` words. Runs over the whole array: the caller drops those that cross two texts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.full(n, (width * 0x9E3779B1 + seed * 0x85EBCA77) & 0xFFFFFFFF, np.uint64)
    for j in range(width):
        x = (x ^ (x >> np.uint64(27))) * _MIX + words[j : j + n]
    return finish(x)


def sequence_hash(words: np.ndarray, seed: int = 0) -> int:
    """One hash of a whole sequence, as ``window_hashes`` gives for a window of that width."""
    return int(window_hashes(words, len(words), seed)[0])
