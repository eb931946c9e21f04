"""Encode texts chunk by chunk, each distinct chunk once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_CHUNKS = 400_000
CHUNK_CHARS = 16  # on average, beyond which the table forgets sooner
SLICE_CHARS = 1 << 21


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def text_slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size in all; one text at least."""
    return size_slices([len(text or "") for text in texts], limit)


def size_slices(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most ``limit``; one row at least."""
    start = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def in_order(parts: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of all texts in order, from parts of (places of the texts, their ids, their counts)."""
    places = np.concatenate([p for p, _, _ in parts])
    counts = np.concatenate([c for _, _, c in parts])
    order = np.argsort(places)
    starts = np.cumsum(counts) - counts
    ids = np.concatenate([i for _, i, _ in parts])
    return ids[gather(starts[order], counts[order])], counts[order]


class ChunkTable:
    """Ids of chunks seen so far; beyond ``limit`` chunks only the more used ones stay, to bound memory.

    Chunks of more than ``CHUNK_CHARS`` characters on average count for more.
    """

    def __init__(
        self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = CACHED_CHUNKS
    ):
        self._encode, self._limit = encode, limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.table = np.zeros(0, dtype=np.int32)  # ids of the known chunks, one after the other
        self.sizes = np.zeros(0, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int64)  # calls that needed the chunk, halved at each clearing

    def ids(self, chunked: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as lists of chunks, one after the other, and their number per text."""
        self._make_room()
        which = self._numbers(list(chain.from_iterable(chunked)))
        return self._gathered(which, np.fromiter(map(len, chunked), dtype=np.int64, count=len(chunked)))

    def _make_room(self) -> None:
        if max(len(self.known), self.chars // CHUNK_CHARS) <= self._limit:
            return
        chunks, uses, table, sizes = list(self.known), self.uses, self.table, self.sizes
        starts = np.cumsum(sizes) - sizes
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        self._forget()
        # The most used of those used more than once, up to half of the limit in number and characters.
        often = np.flatnonzero(uses > 1)
        often = often[np.argsort(-uses[often], kind="stable")][: self._limit // 2]
        often = np.sort(often[np.cumsum(lengths[often]) <= self._limit * CHUNK_CHARS // 2])
        self.known = {chunks[k]: place for place, k in enumerate(often.tolist())}
        self.chars = int(lengths[often].sum())
        self.table = table[gather(starts[often], sizes[often])]
        self.sizes, self.uses = sizes[often], uses[often] // 2

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """Number of every chunk in the table; new ones are encoded."""
        fresh = list(set(chunks).difference(self.known))
        if fresh:
            ids, counts = self._encode(fresh)
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.chars += sum(map(len, fresh))
            self.table = np.concatenate([self.table, ids.astype(np.int32)])
            self.sizes = np.concatenate([self.sizes, counts])
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), dtype=np.int64)])
        numbers = np.fromiter(map(self.known.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        self.uses[numbers] += 1
        return numbers

    def _gathered(self, which: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.sizes[which]
        found = self.table[gather((np.cumsum(self.sizes) - self.sizes)[which], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return found, np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])


class SpacedChunks:
    """Ids of chunks that begin with a space, kept as an Arrow array of words: no chunk becomes a Python string.

    ``encode`` gives the ids of an array of words, each with a space before it. Beyond
    ``limit`` words, or ``CHUNK_CHARS`` times as many bytes, only the more used ones stay.
    """

    def __init__(
        self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], limit: int = CACHED_CHUNKS
    ):
        self._encode, self._limit = encode, limit
        self.known = pa.array([], pa.large_string())
        self.table = np.zeros(0, dtype=np.int32)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int64)

    def ids(self, texts: list[str], first: ChunkTable) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of which each space begins a chunk; ``first`` has those of what stands before it."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets, coded = parts.offsets.to_numpy(), parts.flatten().dictionary_encode()
        del parts
        place = coded.indices.to_numpy()
        leads = offsets[:-1]
        counts = np.bincount(place, minlength=len(coded.dictionary))
        np.subtract.at(counts, place[leads], 1)
        used = counts > 0
        numbers = np.zeros(len(used), dtype=np.int64)
        numbers[used] = self._numbers(coded.dictionary.filter(pa.array(used)), counts[used])
        lead_ids, lead_counts = first.ids([[t.split(" ", 1)[0]] for t in texts])
        # The runs of the leading chunks follow those of the table.
        sizes = np.concatenate([self.sizes, lead_counts])
        starts = np.cumsum(sizes) - sizes
        which = numbers[place]
        which[leads] = len(self.sizes) + np.arange(len(texts))
        lengths = sizes[which]
        found = np.concatenate([self.table, lead_ids])[gather(starts[which], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        self._make_room()
        return found, np.diff(ends[offsets])

    def _numbers(self, words: pa.Array, counts: np.ndarray) -> np.ndarray:
        """Number of every distinct word in the table; new ones are encoded and put behind."""
        where = pc.index_in(words, value_set=self.known)
        fresh = where.is_null()
        mask = fresh.to_numpy(zero_copy_only=False)
        numbers = where.fill_null(0).to_numpy().astype(np.int64)
        numbers[mask] = len(self.known) + np.arange(int(mask.sum()))
        unknown = words.filter(fresh)
        ids, sizes = self._encode(unknown)
        self.known = pa.concat_arrays([self.known, unknown])
        self.table = np.concatenate([self.table, ids.astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(unknown), dtype=np.int64)])
        self.uses[numbers] += counts
        return numbers

    def _make_room(self) -> None:
        if len(self.known) <= self._limit and self.known.nbytes <= self._limit * CHUNK_CHARS:
            return
        lengths = pc.binary_length(self.known).to_numpy()
        often = np.flatnonzero(self.uses > 1)
        often = often[np.argsort(-self.uses[often], kind="stable")][: self._limit // 2]
        often = np.sort(often[np.cumsum(lengths[often]) <= self._limit * CHUNK_CHARS // 2])
        starts = np.cumsum(self.sizes) - self.sizes
        self.known = self.known.take(pa.array(often))
        self.table = self.table[gather(starts[often], self.sizes[often])]
        self.sizes, self.uses = self.sizes[often], self.uses[often] // 2
