"""Ranked lexical search over bit-sliced Bloom signatures.

``build_index`` reads every text once. Texts of like size share a block. A block keeps one bitmap
over its documents per bit of a signature (a slice), and the exact term counts of its documents.
A term sets, for every count level that it reaches (``LEVELS``), ``HASHES`` bits of its document;
the width of the signatures follows from the block's largest document.

A search takes the slices of the query's terms. The intersection of a term's slices shows all
documents that hold the term so often, and by chance some others. Weighted sums of these bitmaps
over levels and terms are therefore upper bounds of all scores. Each task then goes through its
blocks and rescores from the exact counts: first the documents with the highest bounds, then every
one whose bound reaches the tenth-best exact score so far. What stays out is proven to score less.
The best of each task are ranked per item at the end.

Statistics (documents, terms, document frequencies) come from the index and cover all documents.
Items are searched in groups of bounded size in expectation, dealt by hash, each group in one pass
over the index.

Defined results: null and empty texts hold no term and score nothing. Rows are documents, also
those that repeat an id or a text; equal scores go by ascending doc_id, null last. Items that repeat
id and text are one item; rows with one id and different texts are ranked each by itself. An item
without a match has no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chunks import size_slices
from tidemark.llm.common import text_of

TOP = 10
# Constants of the score.
B_SHARE = 75  # percent of a document's length that counts
LENGTH_WEIGHT = 8
UNIT = 1_000_000_000
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 1024)
HASHES = 4
BITS_PER_KEY = 8  # at least, for the largest document of a block
BLOCK_DOCS = 1024
BLOCK_BYTES = 2 << 20
ROW_GROUP_BYTES = 16 << 20  # of the stored index, so that its writer and readers hold little at a time
BOUND_CELLS = 1 << 24  # terms times documents whose bounds are held at a time
EXACT_CELLS = 1 << 18
TERM_STEP = 256
FIRST = 16  # documents with the highest bounds, rescored before there is a threshold
GROUP_CHARS = 1 << 20  # of items searched in one pass over the index
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

# ASCII letters and digits and everything beyond ASCII make terms; of these only A-Z change.
FOLD = np.full(256, ord(" "), dtype=np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
for _code in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)):
    FOLD[_code] = ord(chr(_code).lower())

# ``words`` and ``postings`` are packed arrays: (terms, frequencies) and (doc_ids, sizes, starts, codes, counts).
INDEX = "n_docs int, n_terms long, width long, slices binary, words binary, postings binary"
PACKING = pa.ipc.IpcWriteOptions(compression="zstd")


def packed(**arrays: pa.Array | np.ndarray) -> bytes:
    """Arrays of any lengths in one compressed value: Spark moves it as it is."""
    lists = {}
    for name, values in arrays.items():
        values = values if isinstance(values, pa.Array) else pa.array(values)
        offsets = pa.array([0, len(values)], pa.int32())
        lists[name] = pa.ListArray.from_arrays(offsets, values)
    row = pa.RecordBatch.from_pydict(lists)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=PACKING) as stream:
        stream.write_batch(row)
    return sink.getvalue().to_pybytes()


def unpacked(value: pa.Scalar) -> dict[str, pa.Array]:
    with pa.ipc.open_stream(value.as_buffer()) as stream:
        row = stream.read_next_batch()
    return {name: row.column(name)[0].values for name in row.schema.names}


def folded(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and a space for every byte that is in no term."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    data = data if data is not None else pa.py_buffer(b"")
    shown = FOLD[np.frombuffer(data, dtype=np.uint8)]
    return pa.Array.from_buffers(
        pa.large_string(), len(texts), [None, offsets, pa.py_buffer(shown)], offset=texts.offset
    )


def term_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Owner and term of every term of all texts, in order."""
    parts = pc.ascii_split_whitespace(folded(texts))
    terms, owner = parts.flatten(), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(terms), 0)
    return owner.filter(real).to_numpy().astype(np.int64), terms.filter(real)


def hashes_of(terms: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), dtype=np.uint64, count=len(terms))


def bit_rows(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """The ``HASHES`` slices of each hash at a level, one row per hash."""
    seeds = np.uint64(MIX[0]) * (np.arange(HASHES, dtype=np.uint64) + np.uint64(level * HASHES + 1))
    mixed = hashes[:, None] ^ seeds[None, :]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(MIX[1])
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(MIX[2])
    return ((mixed ^ (mixed >> np.uint64(31))) & np.uint64(width - 1)).astype(np.int64)


def build_index(docs: DataFrame, folder: str) -> DataFrame:
    """Blocks of (doc_id, text) rows, stored in ``folder``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    path = f"{folder}/signatures"
    blocks = rows.mapInArrow(_index_batches, INDEX)
    blocks.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return docs.sparkSession.read.parquet(path)


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.binary_length(batch.column("text")).to_numpy()
        order = np.argsort(np.frexp(size.astype(np.float64))[1], kind="stable")
        kind = np.frexp(size[order].astype(np.float64))[1]
        ends = np.flatnonzero(np.append(kind[1:] != kind[:-1], True)) + 1 if len(kind) else []
        first = 0
        for end in ends:  # texts whose sizes share a power of two
            for start, stop in size_slices(size[order[first:end]].tolist(), BLOCK_BYTES):
                for at in range(start, stop, BLOCK_DOCS):
                    places = order[first + at : first + min(at + BLOCK_DOCS, stop)]
                    block = _block(batch.take(pa.array(places)))
                    if block is not None:
                        yield block
            first = end


def _block(rows: pa.RecordBatch) -> pa.RecordBatch | None:
    """One row of the index; none if no document holds a term."""
    owner, terms = term_lists(rows.column("text"))
    if not len(owner):
        return None
    sizes = np.bincount(owner, minlength=rows.num_rows)
    held = sizes > 0
    owner = (np.cumsum(held) - 1)[owner]
    sizes, n_docs = sizes[held], int(held.sum())
    coded = terms.dictionary_encode()
    vocabulary = coded.dictionary
    keys, counts = np.unique(owner * len(vocabulary) + coded.indices.to_numpy(), return_counts=True)
    docs, codes = np.divmod(keys, len(vocabulary))
    hashes = hashes_of(vocabulary.to_pylist())

    reached = [counts >= level for level in LEVELS]
    per_doc = sum(np.bincount(docs[r], minlength=n_docs) for r in reached)
    width = 1 << max(6, int(BITS_PER_KEY * int(per_doc.max()) - 1).bit_length())
    bits = np.zeros((width, n_docs), dtype=bool)
    for level, here in enumerate(reached):
        if not here.any():
            break
        rows_of = bit_rows(hashes, level, width)[codes[here]]
        bits[rows_of, docs[here][:, None]] = True

    ids = rows.column("doc_id").filter(pa.array(held))

    frequencies = np.bincount(codes, minlength=len(vocabulary)).astype(np.int32)
    starts = np.searchsorted(docs, np.arange(n_docs + 1)).astype(np.int32)
    return pa.RecordBatch.from_pydict(
        {
            "n_docs": pa.array([n_docs], pa.int32()),
            "n_terms": pa.array([len(owner)], pa.int64()),
            "width": pa.array([width], pa.int64()),
            "slices": pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary()),
            "words": pa.array([packed(terms=vocabulary.cast(pa.string()), frequencies=frequencies)], pa.binary()),
            "postings": pa.array(
                [
                    packed(
                        doc_ids=ids.cast(pa.int64()),
                        sizes=sizes.astype(np.int64),
                        starts=starts,
                        codes=codes.astype(np.int32),
                        counts=counts.astype(np.int32),
                    )
                ],
                pa.binary(),
            ),
        }
    )


@dataclass
class Queries:
    """Items of one group: distinct terms with their weights, and each item's terms."""

    terms: list[str]
    items: list[tuple[int, np.ndarray, np.ndarray]]  # number, places of its terms, times each occurs
    n_docs: int
    n_terms: int
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Per (item_id, text) row the ``top`` documents: item_id, rank, doc_id, score."""
    spark = index.sparkSession
    totals = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    asked = items.select("item_id", text_of("text").alias("text")).distinct()
    chars = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = chars // GROUP_CHARS + 1
    kind = items.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not totals.docs:
        return found
    for group in range(groups):
        here = asked.where(F.expr(f"pmod(xxhash64(item_id, text), {groups}L)") == group).collect()
        queries = _queries(sorted(here, key=repr), totals)
        if not queries.terms:
            continue
        queries.weights = _weights(index, queries)
        best = index.mapInArrow(lambda batches: _search_batches(batches, queries, top), "item int, doc_id long, score long")
        # A group's items, bounded above.
        names = F.broadcast(spark.createDataFrame([(k, r.item_id) for k, r in enumerate(sorted(here, key=repr))], f"item int, item_id {kind}"))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        found = found.unionByName(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return found


def _queries(rows: list, totals) -> Queries:
    owner, terms = term_lists(pa.array([r.text for r in rows], pa.large_string()))
    coded = terms.dictionary_encode()
    per_item: dict[int, Counter] = {}
    for item, code in zip(owner.tolist(), coded.indices.to_pylist()):
        per_item.setdefault(item, Counter())[code] += 1
    items = [
        (k, np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c)))
        for k, c in per_item.items()
    ]
    return Queries(coded.dictionary.to_pylist(), items, totals.docs, totals.terms)


def _weights(index: DataFrame, queries: Queries) -> np.ndarray:
    """Weight of every term of the group, from its document frequency."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, sums = pa.array(queries.terms, pa.string()), np.zeros(len(queries.terms), dtype=np.int64)
        for batch in batches:
            for value in batch.column("words"):
                words = unpacked(value)
                where = pc.index_in(terms, value_set=words["terms"])
                known = where.is_valid().to_numpy(zero_copy_only=False)
                sums[known] += words["frequencies"].to_numpy()[where.drop_null().to_numpy()]
        places = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"term": pa.array(places, pa.int32()), "n": pa.array(sums[places], pa.int64())})

    counted = index.select("words").mapInArrow(count, "term int, n long")
    frequency = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = queries.n_docs
    return np.array(
        [math.floor(1000 * math.log((2 * n + 2) / (2 * frequency.get(k, 0) + 1))) for k in range(len(queries.terms))],
        dtype=np.int64,
    )


def _search_batches(batches: Iterator[pa.RecordBatch], queries: Queries, top: int) -> Iterator[pa.RecordBatch]:
    """The best documents of this task's blocks per item."""
    hashes, terms = hashes_of(queries.terms), pa.array(queries.terms, pa.string())
    best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64))
    for batch in batches:
        for k in range(batch.num_rows):
            block = Block(batch.slice(k, 1), queries, hashes, terms)
            for docs in block.windows():
                bounds = block.bounds(docs)
                for number, places, times in queries.items:
                    kept = best.get(number, none)
                    weights = queries.weights[places] * times
                    fresh = block.search(docs, bounds, weights, places, top, kept[2])
                    if len(fresh[0]):
                        best[number] = _best(kept, fresh, top)
    numbers = [n for n, b in best.items() for _ in b[0]]
    ids, nulls, scores = (np.concatenate([none[k], *(b[k] for b in best.values())]) for k in range(3))
    yield pa.RecordBatch.from_pydict(
        {
            "item": pa.array(numbers, pa.int32()),
            "doc_id": pa.array(ids, pa.int64(), mask=nulls.astype(bool)),
            "score": pa.array(scores, pa.int64()),
        }
    )


def _best(kept: tuple, fresh: tuple, top: int) -> tuple:
    """The first ``top`` of both by (score falling, doc_id, null last)."""
    ids, nulls, scores = (np.concatenate([a, b]) for a, b in zip(kept, fresh))
    order = np.lexsort((ids, nulls, -scores))[:top]
    return ids[order], nulls[order], scores[order]


class Block:
    """Bounds and exact scores of a block's documents for the terms of a group."""

    def __init__(self, row: pa.RecordBatch, queries: Queries, hashes: np.ndarray, terms: pa.Array):
        postings = unpacked(row.column("postings")[0])

        def values(name: str) -> np.ndarray:
            return postings[name].to_numpy(zero_copy_only=False)

        ids = postings["doc_ids"]
        self.nulls = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        share = 100 - B_SHARE
        self.lengths = np.array(
            [share + B_SHARE * n * queries.n_docs // queries.n_terms for n in values("sizes").tolist()], dtype=np.int64
        )
        codes, self.counts, starts = values("codes"), values("counts"), values("starts")
        vocabulary = unpacked(row.column("words")[0])["terms"]
        self.stride = len(vocabulary)
        self.keys = np.repeat(np.arange(len(self.ids)), np.diff(starts)) * self.stride + codes
        self.codes = pc.index_in(terms, value_set=vocabulary).fill_null(-1).to_numpy()
        self.hashes, self.width = hashes, row.column("width")[0].as_py()
        self.slices = np.frombuffer(row.column("slices")[0].as_buffer(), dtype=np.uint8).reshape(self.width, -1)

    def windows(self) -> Iterator[slice]:
        """Runs of documents, whole bytes of the bitmaps, whose bounds fit in memory together."""
        size = max(8, BOUND_CELLS // max(1, len(self.hashes)) // 8 * 8)
        for at in range(0, len(self.ids), size):
            yield slice(at, min(at + size, len(self.ids)))

    def _gain(self, docs: slice, tf: int) -> np.ndarray:
        """What a term that occurs ``tf`` times adds per unit of weight, by document."""
        return UNIT * tf // (1000 * tf + LENGTH_WEIGHT * self.lengths[docs])

    def bounds(self, docs: slice) -> np.ndarray:
        """Term by document: no less than what the term adds per unit of weight. Below UNIT / 1000, so 32 bits do."""
        n_docs, most = docs.stop - docs.start, int(self.counts.max())
        bitmaps = self.slices[:, docs.start // 8 : -(-docs.stop // 8)]
        bounds = np.zeros((len(self.hashes), n_docs), dtype=np.int32)
        alive, shown = np.arange(len(self.hashes)), None
        below = np.zeros(n_docs, dtype=np.int64)
        for level, least in enumerate(LEVELS):
            if least > most or not len(alive):
                break
            # Counts from this level up to the next one, or to the block's largest, gain at most this.
            reach = self._gain(docs, min(LEVELS[level + 1] - 1, most) if level + 1 < len(LEVELS) else most)
            there = np.bitwise_and.reduce(bitmaps[bit_rows(self.hashes[alive], level, self.width)], axis=1)
            there = there if shown is None else there & shown
            some = there.any(axis=1)
            alive, shown = alive[some], there[some]
            step = (reach - below).astype(np.int32)
            for at in range(0, len(alive), TERM_STEP):
                here = slice(at, at + TERM_STEP)
                bounds[alive[here]] += np.unpackbits(shown[here], axis=1, count=n_docs) * step
            below = reach
        return bounds

    def search(
        self, docs: slice, bounds: np.ndarray, weights: np.ndarray, places: np.ndarray, top: int, known: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of a window that may belong to the ``top``, with exact scores; ``known`` are the best so far."""
        bound = np.zeros(docs.stop - docs.start, dtype=np.int64)
        for at in range(0, len(places), TERM_STEP):
            here = slice(at, at + TERM_STEP)
            bound += weights[here] @ bounds[places[here]].astype(np.int64)
        threshold = max(1, int(known[-1])) if len(known) >= top else 1
        open_ = np.flatnonzero(bound >= threshold)
        first, rest = open_, open_[:0]
        if len(open_) > FIRST:
            order = np.argpartition(-bound[open_], FIRST - 1)
            first, rest = open_[order[:FIRST]], open_[order[FIRST:]]
        scores = self.exact(docs.start + first, weights, places)
        if len(rest):
            seen = np.sort(np.concatenate([known, scores]))[::-1]
            if len(seen) >= top:
                threshold = max(threshold, int(seen[top - 1]))
            rest = rest[bound[rest] >= threshold]
            first = np.concatenate([first, rest])
            scores = np.concatenate([scores, self.exact(docs.start + rest, weights, places)])
        good = scores >= threshold
        found = docs.start + first[good]
        return self.ids[found], self.nulls[found], scores[good]

    def exact(self, docs: np.ndarray, weights: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Scores of documents from their term counts."""
        codes = self.codes[places]
        weights, codes = weights[codes >= 0], codes[codes >= 0]
        scores = np.zeros(len(docs), dtype=np.int64)
        step = max(1, EXACT_CELLS // max(1, len(codes)))
        for at in range(0, len(docs), step):
            here = docs[at : at + step]
            wanted = here[:, None] * self.stride + codes[None, :]
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            tf = np.where(self.keys[place] == wanted, self.counts[place], 0).astype(np.int64)
            gains = UNIT * tf // (1000 * tf + LENGTH_WEIGHT * self.lengths[here][:, None])
            scores[at : at + step] = gains @ weights
        return scores
