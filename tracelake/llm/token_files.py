"""Token ids as binary files of Simple-8b words, in the order of the documents, and their reader.

A file is a row of frames, all in little-endian 64-bit words, so that frames and blocks stay aligned:

* header: ``MAGIC``, part, ids of the part before this frame, documents, ids, blocks, words, escapes;
* documents: id, 1 if the id is null, number of ids;
* blocks of ``BLOCK`` ids: first word, escapes before;
* the words, the escapes, and ``END``.

A frame holds whole documents, about ``FRAME_IDS`` ids. Frames are rows of Spark's text writer with ``END`` as line separator, so files are
committed like any other output on any file system, and a lost executor costs its tasks only. The binary file reader reads them back.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.scratch import drop, keep, shared_dir, tidy
from tracelake.llm.simple8b import pack, unpack
from tracelake.llm.words import chunks

TOKENIZER = "byte_bpe_50k.json"
MAGIC, END = b"S8TOKENS", "\nS8END.\n"
BLOCK, FRAME_IDS, FRAMES_A_FILE = 1024, 65_536, 32
#: Bytes of text encoded at a time, unless one text has more; bytes of remembered stretches and their ids, and of one beside its letters.
CHUNK_BYTES, _KEPT_BYTES, _ENTRY_BYTES = 8_000_000, 130_000_000, 180
_HEADER = 8
_READ = "doc_id long, part long, part_start long, n_tokens long, ids binary"


def _borders(data: np.ndarray) -> np.ndarray:
    """Whether a stretch may begin at each byte: see ``Encoder``. Visible are first bytes of characters that nobody counts as white space."""
    letter = ((data | np.uint8(32)) - np.uint8(97)) < 26
    visible = ((data - np.uint8(0x21)) < 0x5E) | ((data - np.uint8(0xC3)) < 0x1E)
    line = data == 10
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        point = line | ((data - np.uint8(0x21)) < 0x5E) & ~letter
        cut[1:] = letter[:-1] & point[1:]
        cut[2:] |= ((data[:-2] - np.uint8(0xC3)) < 6) & ((data[1:-1] | np.uint8(32)) != 0xB7) & point[2:]
        cut[2:] |= visible[:-2] & line[1:-1] & visible[2:]
        cut[:-1] |= (data[:-1] == 32) & visible[1:]
    return cut


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library.

    No piece of a byte-level tokenizer with its usual pattern crosses these places: before a space that stands before a visible character, between
    a letter up to U+023F and any other visible character of ASCII or a line end, and between a line end after a visible character and another
    visible one. The stretches between them are found on the bytes of a whole batch, and each different one is encoded by the library and
    remembered, as long as there is room. Texts with a special token in them, and all texts under any other kind of tokenizer, are encoded whole.
    """

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        parts = json.loads(config)
        form = parts.get("pre_tokenizer") or {}
        self.cut = form.get("type") == "ByteLevel" and form.get("use_regex", True) and not any((form.get("add_prefix_space"), *(parts.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))))
        self.special = [x["content"] for x in parts.get("added_tokens", [])]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self._forget()

    def _forget(self) -> None:
        """``known`` numbers the stretches as they are learned. By that number ``size`` and ``first`` have the place of its ids in ``flat``, and ``uses`` the batches that held it."""
        self.known: dict[str, int] = {}
        self.flat, self.first, self.size, self.uses, self.held = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def _trim(self) -> None:
        """Forget what one batch alone held, and of the rest what fewest held, down to half of what may be kept. Counts are halved, so that words of old batches make room."""
        names, order = list(self.known), np.argsort(self.uses, kind="stable")[::-1]
        cost = np.fromiter(map(len, names), np.int64, len(names)) + _ENTRY_BYTES
        own = order[np.cumsum(cost[order]) <= _KEPT_BYTES // 2]
        own = np.sort(own[self.uses[own] > 1])
        sizes, uses, first = self.size[own], self.uses[own], self.first[own]
        ends = np.cumsum(sizes, dtype=np.int64)
        flat = self.flat[np.repeat(first - ends + sizes, sizes) + np.arange(sizes.sum())]
        self._forget()
        self.known = {names[k]: i for i, k in enumerate(own.tolist())}
        self.flat, self.first, self.size, self.uses, self.held = flat, (ends - sizes).astype(np.int32), sizes, uses // 2, int(cost[own].sum())

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        return np.fromiter(chain.from_iterable(own), np.uint32, int(sizes.sum())), sizes

    def _learn(self, stretches: list[str]) -> None:
        """Words that begin with a space are encoded in rows of 200: the ids that begin with a space tell them apart."""
        word = np.fromiter((s[0] == " " and s[1:].isalpha() for s in stretches), bool, len(stretches))
        words, rest = list(compress(stretches, word)), list(compress(stretches, ~word))
        ids, _ = self._library(["".join(words[i : i + 200]) for i in range(0, len(words), 200)])
        cuts = np.flatnonzero(self.spaced[ids])
        if len(cuts) != len(words):
            raise ValueError("a space inside a word")
        others, sizes = self._library(rest)
        first, size = np.empty(len(stretches), np.int32), np.empty(len(stretches), np.int32)
        first[word], size[word] = cuts, np.diff(np.append(cuts, len(ids)))
        first[~word], size[~word] = len(ids) + np.cumsum(sizes) - sizes, sizes
        self.known.update(zip(stretches, range(len(self.known), len(self.known) + len(stretches)), strict=True))
        self.first = np.concatenate([self.first, len(self.flat) + first], dtype=np.int32)
        self.size = np.concatenate([self.size, size])
        self.uses = np.concatenate([self.uses, np.zeros(len(stretches), np.int32)])
        self.flat = np.concatenate([self.flat, ids, others])
        self.held += sum(map(len, stretches)) + _ENTRY_BYTES * len(stretches)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string array without nulls, one after another, and where each text's begin (one entry more)."""
        if not self.cut:
            ids, sizes = self._library(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        texts = pa.concat_arrays([texts.cast(pa.large_string())])
        borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]
        borders = borders - borders[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cut = np.append(_borders(data), True)
        for special in self.special:
            for i in np.flatnonzero(pa.compute.match_substring(texts, special)):
                cut[borders[i] : borders[i + 1]] = False
        cut[borders] = True
        at = np.flatnonzero(cut)
        stretches = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        which, names = np.asarray(stretches.indices), stretches.dictionary.to_numpy(zero_copy_only=False)
        del stretches
        if self.held > _KEPT_BYTES:
            self._trim()
        own = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(own < 0)
        own[new] = len(self.known) + np.arange(len(new))
        self._learn(names[new].tolist())
        self.uses[own] += 1
        n = self.size[own][which]
        ends = np.cumsum(n, dtype=np.int64)
        place = np.repeat(self.first[own][which] - ends.astype(np.int32) + n, n)  # what is held, and a chunk's ids, are far below 2^31
        place += np.arange(ends[-1], dtype=np.int32)
        ids = self.flat[place]
        return ids, np.concatenate([[0], ends])[np.searchsorted(at, borders)]


def _encoder(shared: dict) -> Encoder:
    """A worker makes one encoder of the broadcast configuration, and keeps it there with what it has learned from task to task. The dictionary is plain, so executors need no copy of this package."""
    if "encoder" not in shared:
        shared["encoder"] = Encoder(shared["config"])
    return shared["encoder"]


def frame(docs: list[tuple[int | None, np.ndarray]], part: int, before: int) -> bytes:
    """A frame without its end mark."""
    sizes = [len(ids) for _, ids in docs]
    values = np.concatenate([ids for _, ids in docs])
    words, blocks, escapes = pack(values, BLOCK)
    header = np.array([int.from_bytes(MAGIC, "little"), part, before, len(docs), len(values), len(blocks), len(words), len(escapes)], "<i8")
    table = np.array([(d or 0, d is None, n) for (d, _), n in zip(docs, sizes, strict=True)], "<i8")
    return b"".join((header.tobytes(), table.tobytes(), blocks.astype("<i8").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()))


def frames(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Header, documents, blocks, words and escapes of each frame of a file."""
    at, whole, end = 0, np.frombuffer(content, "<i8"), int.from_bytes(END.encode(), "little")
    while at < len(whole):
        header = whole[at : at + _HEADER]
        if int(header[0]) != int.from_bytes(MAGIC, "little"):
            raise ValueError("not a file of token ids")
        _, _, _, n_docs, _, n_blocks, n_words, n_escapes = map(int, header)
        cuts = np.cumsum([at + _HEADER, 3 * n_docs, 2 * n_blocks, n_words, n_escapes])
        docs, blocks, words, escapes = (whole[a:b] for a, b in zip(cuts, cuts[1:]))
        if int(whole[cuts[-1]]) != end:
            raise ValueError("a frame is cut short")
        yield header, docs.reshape(-1, 3), blocks.reshape(-1, 2), words.view("<u8"), escapes.view("<u8")
        at = int(cuts[-1]) + 1


def decode_block(frame_parts: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """The ids of one block of a frame, read from its own words only."""
    _, _, blocks, words, escapes = frame_parts
    last = (len(words), len(escapes)) if k + 1 == len(blocks) else tuple(blocks[k + 1])
    return unpack(words[blocks[k][0] : last[0]], escapes[blocks[k][1] : last[1]])


def _packer(shared, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before, held, n = _encoder(shared.value), TaskContext.get().partitionId(), 0, [], 0
        tail = np.uint32(end_id)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([frame(held, part, before)], pa.binary())], names=["frame"])

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).tolist()
            for a, b in chunks([range(s) for s in sizes], CHUNK_BYTES):
                coded, starts = encode(pa.compute.fill_null(texts.slice(a, b - a), ""))
                for doc, first, last in zip(ids[a:b], starts, starts[1:]):
                    held.append((doc, np.append(coded[first:last], tail)))
                    n += len(held[-1][1])
                    if n >= FRAME_IDS:
                        yield out()
                        before, held, n = before + n, [], 0
        if held:
            yield out()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each document and write the ids under ``path``, documents in ascending order of ``id_col``.

    ``tokenizer``: a file of the tokenizers library that the driver reads; its special tokens count as such in texts. Files sort by name in the
    order of their documents. Null texts are empty, so such a document is its end id alone. Null ids come first; rows that share an id, repeated
    ones too, are all written, in the order of a hash of their texts. An empty table gives no frames. Other columns are ignored.
    """
    spark = docs.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    with open(tokenizer, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast({"config": file.read()})
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.col("doc_id"), F.col("h"), F.col("row")]  # the last splits rows that are the same in all
    dealt = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    packed = dealt.select("doc_id", "text").mapInArrow(_packer(shared, end_id), "frame binary")
    try:
        packed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FRAMES_A_FILE).text(path)
    finally:
        shared.destroy()  # or workers hold what they have learned as long as they live


def _reader(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for header, docs, _, words, escapes in frames(content.as_buffer()):
                    values = unpack(words, escapes).astype("<u4")
                    ends = np.cumsum(docs[:, 2])
                    starts = ends - docs[:, 2]
                    own = [values[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[:, 0], pa.int64(), mask=docs[:, 1] == 1), pa.array(np.full(len(docs), header[1])), pa.array(starts + header[2]), pa.array(docs[:, 2]),
                            pa.array(own if with_ids else [zlib.crc32(x).to_bytes(4, "big") for x in own], pa.binary()),
                        ],
                        names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                    )

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Each document of the files under ``path``: ``doc_id``, ``part``, ``part_start`` (ids of the part before it), ``n_tokens`` and ``ids``, little-endian 32-bit numbers, or with ``with_ids`` off their crc32 as four bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(_reader(with_ids), _READ)


@tidy
def token_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents as files of ids in the shared folder, read them back, and give what the files hold of each document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    See ``write_token_files`` for nulls, ties and empty tables. Starts are sums of one total a part, so the driver holds as many numbers as there are parts.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tracelake/token-files-{uuid.uuid4().hex}"
    try:
        write_token_files(docs, path, tokenizer, end_id, id_col, text_col)
        found = keep(read_token_files(spark, path, with_ids=False), "token-spans")
    finally:
        drop(spark, path)
    totals = sorted((r["part"], r["n"]) for r in found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    parts = spark.createDataFrame([(p, s) for (p, _), s in zip(totals, starts)], "part long, before long")
    crc = F.conv(F.hex("ids"), 16, 10).cast("long")
    return found.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", crc.alias("ids_crc32"))
