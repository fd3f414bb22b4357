"""Token counts by greedy longest match in linear time, without building the pieces.

The vocabulary is a trie. Each state knows how many pieces are popped, and the state that is left, when the next byte does not follow:
a whole piece pops itself and leaves the root; else what its prefix's failure leaves goes on with the last byte. So a byte costs
constant time on average and a count needs no look back. Words are counted on their own, each with the space before it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.words import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_KEPT_WORDS = 500_000


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a file of ``base64 rank`` lines. Pieces with white space after their first byte cannot match in a word and are left out."""
    with open(path, "rb") as file:
        pieces = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
    return [x for x in pieces if not any(b in b" \t\n\x0b\x0c\r" for b in x[1:])]


class LongestMatch(dict):
    """Word -> number of greedy longest-match pieces; forgets all when it holds too many. Every single byte counts as a piece."""

    def __init__(self, pieces: Iterable[bytes]):
        super().__init__()
        whole = set(pieces) | {bytes([b]) for b in range(256)}
        follow: dict[int, int] = {}
        parent, last, ends = [0], [0], [False]
        level: list[list[int]] = [[0]]
        depth = [0]
        for piece in sorted(whole):
            s = 0
            for b in piece:
                t = follow.get(s << 8 | b)
                if t is None:
                    t = follow[s << 8 | b] = len(parent)
                    parent.append(s)
                    last.append(b)
                    ends.append(False)
                    depth.append(depth[s] + 1)
                    if depth[t] == len(level):
                        level.append([])
                    level[depth[t]].append(t)
                s = t
            ends[s] = True
        left, popped = [0] * len(parent), [0] * len(parent)
        for states in level[1:]:
            for v in states:
                if ends[v]:
                    popped[v] = 1
                    continue
                s, n = left[parent[v]], popped[parent[v]]
                while (t := follow.get(s << 8 | last[v])) is None:
                    n += popped[s]
                    s = left[s]
                left[v], popped[v] = t, n
        self.follow, self.left, self.popped = follow, left, popped

    def __missing__(self, word: bytes) -> int:
        follow, left, popped = self.follow, self.left, self.popped
        s = n = 0
        for b in b" " + word:
            while (t := follow.get(s << 8 | b)) is None:
                n += popped[s]
                s = left[s]
            s = t
        while s:
            n += popped[s]
            s = left[s]
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = n
        return n


def _count(pieces: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = LongestMatch(pieces)
        get = count.__getitem__
        for batch in slices(batches):
            words, tokens = [], []
            for text in batch.column("text").to_pylist():
                own = text.split() if text else []
                words.append(len(own))
                tokens.append(sum(map(get, own)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | list[bytes] = VOCABULARY) -> DataFrame:
    """One row a row of ``docs``: ``id``, ``n_words``, ``n_tokens``. ``vocabulary``: a file the driver reads, or pieces.

    Words are runs of anything but space and 0x09-0x0D. Null, empty and blank texts have none. Repeated rows count each; an empty table gives no
    rows; other columns are ignored.
    """
    pieces = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(_count(pieces), "id long, n_words long, n_tokens long")
