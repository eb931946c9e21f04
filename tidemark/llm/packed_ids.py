"""Token ids in files of fixed-width packed integers.

A shard file holds the ids of a run of documents, in order, each id in the least
number of bits that holds the vocabulary. Ids are packed in blocks of ``BLOCK``;
every block but the last has the same number of bytes, so any id is found by
arithmetic and a block is unpacked by a few numpy operations. Layout, little-endian:

    blocks | block offsets, u64 each | document ids, i64 | document starts, u64 (one more) |
    trailer: n_blocks u64, n_docs u64, n_ids u64, bits u32, block u32, magic 8 bytes

Documents are range-partitioned by id; each task streams one partition into one
shard in the shared folder and returns its manifest row. File names are unique per
attempt, and only manifest rows of successful tasks count, so retried, speculative
or lost tasks leave no trace in the result. A prefix sum over the manifest, one row
per shard, gives the global position of each shard.

Defined results: a null or empty text has the end id only; a null doc_id sorts
first and is stored as the smallest 64-bit integer; rows with equal doc_id are all
written, in the order of a hash of their text; an empty table makes shards without
documents; ids beyond the given vocabulary are refused.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chunks import ChunkTable, SpacedChunks, in_order, text_slices
from tidemark.llm.common import stored, text_of

BLOCK = 1 << 15
TRAILER = struct.Struct("<QQQII8s")
MAGIC = b"PACKIDS1"
NO_ID = -(1 << 63)
READ_IDS = 1 << 20
ROW_CHUNKS = 256
FEW_CHUNKS = 100_000  # leading chunks and those of uneven texts
SLICE_CHARS = 1 << 23

Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids fill ``bits`` whole bytes, so rows of eight are packed column by column."""
    padded = np.zeros(-(-len(ids) // 8) * 8, dtype=np.uint64)
    padded[: len(ids)] = ids
    rows = padded.reshape(-1, 8)
    out = np.zeros((len(rows), bits), dtype=np.uint8)
    for k in range(8):
        bit = k * bits
        for byte in range(bit // 8, (bit + bits + 7) // 8):
            shift = byte * 8 - bit
            part = rows[:, k] >> np.uint64(shift) if shift >= 0 else rows[:, k] << np.uint64(-shift)
            out[:, byte] |= part.astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, bits)
    out = np.zeros((len(rows), 8), dtype=np.uint64)
    for k in range(8):
        bit = k * bits
        for byte in range(bit // 8, (bit + bits + 7) // 8):
            shift = byte * 8 - bit
            part = rows[:, byte].astype(np.uint64)
            out[:, k] |= part << np.uint64(shift) if shift >= 0 else part >> np.uint64(-shift)
    return (out.reshape(-1)[:count] & np.uint64((1 << bits) - 1)).astype(np.uint32)


def file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a folder and the folder's path in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder):
        return pa.fs.FileSystem.from_uri(folder)
    return pa.fs.LocalFileSystem(), folder


class ShardWriter:
    """Streams documents into one shard; holds one block and 16 bytes per document."""

    def __init__(self, sink: pa.NativeFile, vocabulary: int):
        self.sink, self.bits, self.vocabulary = sink, bits_for(vocabulary), vocabulary
        self.rest = np.zeros(0, dtype=np.uint32)
        self.doc_ids: list[int] = []
        self.starts, self.offsets, self.written = [0], [], 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        if len(ids) and (int(ids.max()) >= self.vocabulary or int(ids.min()) < 0):
            raise ValueError(f"an id lies outside the vocabulary of {self.vocabulary}")
        self.doc_ids += [NO_ID if d is None else d for d in doc_ids]
        self.starts += (self.starts[-1] + np.cumsum(counts)).tolist()
        self.rest = np.concatenate([self.rest, ids.astype(np.uint32)])
        full = len(self.rest) // BLOCK * BLOCK
        for at in range(0, full, BLOCK):
            self._block(self.rest[at : at + BLOCK])
        self.rest = self.rest[full:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.written)
        self.sink.write(data)
        self.written += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        for values, kind in ((self.offsets, "<u8"), (self.doc_ids, "<i8"), (self.starts, "<u8")):
            self.sink.write(np.array(values, dtype=kind).tobytes())
        n_ids = self.starts[-1]
        self.sink.write(TRAILER.pack(len(self.offsets), len(self.doc_ids), n_ids, self.bits, BLOCK, MAGIC))


class ShardReader:
    """Random access to the ids of one shard."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        end = source.size() - TRAILER.size
        n_blocks, n_docs, self.n_ids, self.bits, self.block, magic = TRAILER.unpack(self._at(end, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        start = end - 8 * (n_blocks + 2 * n_docs + 1)
        index = self._at(start, end - start)
        self.offsets = np.frombuffer(index, "<u8", n_blocks)
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, 8 * n_blocks)
        self.starts = np.frombuffer(index, "<u8", n_docs + 1, 8 * (n_blocks + n_docs)).astype(np.int64)
        self.end = start

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard; reads only the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        begin = int(self.offsets[first])
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        found = unpack(self._at(begin, end - begin), self.bits, stop - first * self.block)
        return found[start - first * self.block :]


MANIFEST = "part int, path string, n_docs long, n_ids long, n_bytes long"


def write_shards(
    docs: DataFrame, folder: str, encode: Callable[[], Encode], end_id: int, vocabulary: int, shards: int
) -> DataFrame:
    """Write (doc_id, text) in ascending doc_id order; return the manifest (part, path, n_docs, n_ids, n_bytes).

    ``encode()`` is called once per task and gives the function that encodes a batch.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/shard-{part:06d}-{uuid.uuid4().hex}.bin"
        encode_texts = encode()
        with store.open_output_stream(path) as sink:
            writer = ShardWriter(sink, vocabulary)
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for start, stop in text_slices(texts, SLICE_CHARS):
                    ids, counts = encode_texts(texts[start:stop])
                    writer.add(doc_ids[start:stop], *_with_end(ids, counts, end_id))
            writer.close()
        size = store.get_file_info(path).size
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part], pa.int32()),
                "path": pa.array([path], pa.string()),
                "n_docs": pa.array([len(writer.doc_ids)], pa.int64()),
                "n_ids": pa.array([writer.starts[-1]], pa.int64()),
                "n_bytes": pa.array([size], pa.int64()),
            }
        )

    return stored(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), folder, "manifest")


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard.
    placed = manifest.select("part", "path", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("start"))
    shards = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as source:
                    yield from _documents(ShardReader(source), row["start"])

    return placed.repartition(shards).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _documents(shard: ShardReader, base: int) -> Iterator[pa.RecordBatch]:
    n_docs, first = len(shard.doc_ids), 0
    while first < n_docs:
        stop = int(np.searchsorted(shard.starts, shard.starts[first] + READ_IDS, side="right")) - 1
        stop = min(max(stop, first + 1), n_docs)
        starts = shard.starts[first : stop + 1]
        data = shard.ids(int(starts[0]), int(starts[-1])).astype("<u4").tobytes()
        cuts = ((starts - starts[0]) * 4).tolist()
        ids = shard.doc_ids[first:stop]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
                "start": pa.array(base + starts[:-1], pa.int64()),
                "n_tokens": pa.array(np.diff(starts), pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64()),
            }
        )
        first = stop


def byte_bpe_encoder(path: str) -> Callable[[], Encode]:
    """Encoder by the tokenizers library for byte-level BPE files, as the library encodes the whole text.

    The library cuts a text at white space before any merge: a cut before each
    ``" ?\\S+"`` never falls inside one of its words. Each distinct chunk of a worker
    is therefore encoded once, many of them in one row. Of a text in which no space stands
    before white space or the end, each space begins a chunk. Texts that hold a special
    token's string are encoded whole. Texts with the separators U+001C to U+001F,
    which Python alone counts as white space, are encoded as one chunk.
    """
    return lambda: _encoder(path)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encode:
    """One encoder per worker and file; what it knows stays from task to task, within its bound."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    find = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
    odd = re.compile("[\x1c-\x1f]").search
    loose = re.compile(r" (?!\S)").search

    # Each character of a byte-level token stands for one byte.
    token_bytes = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
    for token, token_id in tokenizer.get_vocab().items():
        token_bytes[token_id] = len(token)

    def encode_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(counts.sum())), counts

    def encode_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words with a space before each are encoded in rows, and cut again by their bytes."""
        at = np.append(np.arange(0, len(words), ROW_CHUNKS), len(words))
        rows = pc.binary_join(pa.ListArray.from_arrays(at.astype(np.int32), words), pa.scalar(" ", words.type))
        ids, _ = encode_all([" " + row for row in rows.to_pylist()])
        ends = np.cumsum(pc.binary_length(words).to_numpy() + 1)
        stops = np.searchsorted(np.cumsum(token_bytes[ids]), ends) + 1
        return ids, np.diff(np.concatenate([[0], stops]))

    chunks, words = ChunkTable(encode_all, FEW_CHUNKS), SpacedChunks(encode_words)

    def by_chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return chunks.ids([[t] if t and odd(t) else find(t) for t in texts])

    def by_spaces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return words.ids(texts, chunks)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ways: dict[Encode, list[int]] = {encode_all: [], by_chunks: [], by_spaces: []}
        for k, t in enumerate(texts):
            if any(s in t for s in specials):
                ways[encode_all].append(k)
            else:
                ways[by_chunks if odd(t) or loose(t) else by_spaces].append(k)
        return in_order(
            [
                (np.array(places, dtype=np.int64), *way([texts[k] for k in places]))
                for way, places in ways.items()
                if places
            ]
            or [(np.zeros(0, dtype=np.int64),) * 3]
        )

    return encode
