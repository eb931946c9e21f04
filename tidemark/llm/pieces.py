"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The symbols of all distinct words of a batch lie in one flat array. Each round
looks up the rank of every neighbouring pair, takes the smallest rank per word by
a segmented minimum, merges all its leftmost non-overlapping places at once and
compacts the array. Words without a pair left leave the rounds.

Merging all places of a rank at once equals the library's one-by-one order unless
a merge can create a pair of the same or a smaller rank. Such pieces are known
from the vocabulary; of one of them only the leftmost place of a word is merged in a
round. A word of over ``LONG_WORD`` symbols, whose rounds would be many, is merged from
a heap instead. Words that occurred before in the task are looked up.

Defined results: null and empty texts have no ids and decode to the empty text;
white space is kept as the model's normaliser has it; characters outside the
vocabulary become bytes, or one unknown id per run if the model has no bytes;
rows that repeat are encoded alike. Decoding accepts any ids of the model.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.llm.chunks import ChunkTable, gather, size_slices, text_slices

SPACE = "▁"
LONG_WORD = 512
NO_RANK = np.int64(1) << 40
GONE = -(1 << 40)
SLICE_IDS = 1 << 19
CACHED_WORDS = 150_000  # kept between the tasks of a worker
HASH = np.uint64(0x9E3779B97F4A7C15)

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


@dataclass(frozen=True)
class PieceModel:
    """A BPE vocabulary as arrays. Symbols are pieces, or characters that only occur in pieces."""

    n_symbols: int
    char_symbol: np.ndarray  # code point -> symbol, n_symbols where there is none
    pair_keys: np.ndarray  # hash table of left * (n_symbols + 1) + right, -1 where empty
    pair_ranks: np.ndarray
    pair_merged: np.ndarray
    unsafe: np.ndarray  # by rank: merging it may create a pair of the same or a smaller rank
    is_piece: np.ndarray  # by symbol
    byte_ids: np.ndarray | None
    unknown_id: int
    letters: dict[int, str]  # characters of symbols that are no pieces
    separable: bool  # no piece has a space mark after another character
    breaks: str  # white space that no piece holds
    prefix: bool
    surfaces: np.ndarray  # bytes of all ids, one after the other
    surface_starts: np.ndarray
    mark_first: np.ndarray  # by id: the surface starts with a space mark
    control: np.ndarray  # by id: no surface

    @property
    def stride(self) -> int:
        return self.n_symbols + 1


@lru_cache(maxsize=4)
def load_pieces(path: str) -> PieceModel:
    """Read a BPE model file; the normaliser must be the identity, as it is not applied here."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(size)]
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
    probe = "  a Å２ 　 é "
    if sp.decode(sp.encode(probe)) != probe:
        raise ValueError(f"{path} changes text before it encodes; only identity normalisers are supported")

    symbols = {p: i for i, p in enumerate(pieces) if not special[i]}
    scores = {p: sp.get_score(i) for p, i in symbols.items()}
    is_piece = [not s for s in special]
    for piece in list(symbols):
        for char in piece:
            if char not in symbols:
                symbols[char] = len(is_piece)
                is_piece.append(False)
    n = len(is_piece)
    rank_of = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
    pairs = []
    unsafe = np.zeros(len(rank_of) + 1, dtype=bool)
    for piece, score in scores.items():
        rank = rank_of[score]
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in symbols and right in symbols:
                pairs.append((symbols[left] * (n + 1) + symbols[right], rank, symbols[piece]))
                for part in (left, right):
                    if len(part) > 1 and rank <= rank_of[scores[part]]:
                        unsafe[rank_of[scores[part]]] = True
    columns = _hash_table(np.array(pairs, dtype=np.int64).reshape(-1, 3))
    char_symbol = np.full(0x110000, n, dtype=np.int32)
    for text, symbol in symbols.items():
        if len(text) == 1:
            char_symbol[ord(text)] = symbol

    byte_ids = {int(pieces[i][3:-1], 16): i for i in range(size) if sp.is_byte(i)}
    surfaces = []
    for i, piece in enumerate(pieces):
        if sp.is_byte(i):
            surfaces.append(bytes([int(piece[3:-1], 16)]))
        elif sp.is_control(i):
            surfaces.append(b"")
        elif sp.is_unknown(i):
            surfaces.append(sp.decode([i]).encode())
        else:
            surfaces.append(piece.replace(SPACE, " ").encode())
    return PieceModel(
        n_symbols=n,
        char_symbol=char_symbol,
        pair_keys=columns[:, 0].copy(),
        pair_ranks=columns[:, 1].copy(),
        pair_merged=columns[:, 2].copy(),
        unsafe=unsafe,
        is_piece=np.array(is_piece + [False]),
        byte_ids=np.array([byte_ids[b] for b in range(256)], dtype=np.int32) if len(byte_ids) == 256 else None,
        unknown_id=sp.unk_id(),
        letters={symbols[p]: p for p in symbols if not is_piece[symbols[p]]},
        breaks="".join(c for c in "\n\t\r" if c not in symbols),
        separable=not any(SPACE in p.lstrip(SPACE) for p in symbols),
        prefix=sp.id_to_piece(sp.encode("a")[0]).startswith(SPACE),
        surfaces=np.frombuffer(b"".join(surfaces), dtype=np.uint8),
        surface_starts=np.concatenate([[0], np.cumsum([len(s) for s in surfaces])]),
        mark_first=np.array([s.startswith(b" ") and not x for s, x in zip(surfaces, special)]),
        control=np.array([sp.is_control(i) for i in range(size)]),
    )


def _hash_table(rows: np.ndarray) -> np.ndarray:
    """Rows of (key, rank, merged) by open addressing, at most an eighth of the places filled."""
    bits = max(4, (8 * len(rows)).bit_length())
    table = np.full((1 << bits, 3), -1, dtype=np.int64)
    for row in rows:
        at = int(_home(row[:1], bits)[0])
        while table[at, 0] >= 0:
            at = (at + 1) % len(table)
        table[at] = row
    return table


def _home(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * HASH) >> np.uint64(64 - bits)).astype(np.int64)


def _pair_rows(model: PieceModel, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each pair in the pair table, and whether it is there."""
    keys = left.astype(np.int64) * model.stride + right
    size = len(model.pair_keys)
    rows = _home(keys, size.bit_length() - 1)
    there = (left >= 0) & (right >= 0)
    open_ = np.flatnonzero(there)
    while len(open_):  # goes on where another pair fills the place
        held = model.pair_keys[rows[open_]]
        there[open_[held < 0]] = False
        open_ = open_[(held >= 0) & (held != keys[open_])]
        rows[open_] = (rows[open_] + 1) % size
    return rows, there


def _merge_rounds(
    model: PieceModel, symbols: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of all words, one after the other as given, and their number per word."""
    words = np.arange(len(lengths))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, symbols, lengths

    def leave(which: np.ndarray) -> None:
        nonlocal symbols, lengths, words
        own = np.repeat(which, lengths)
        done.append((words[which], symbols[own], lengths[which]))
        symbols, lengths, words = symbols[~own], lengths[~which], words[~which]

    long = lengths > LONG_WORD
    if long.any():
        starts = np.cumsum(lengths) - lengths
        for k in np.flatnonzero(long).tolist():
            word = _merge_heap(model, symbols[starts[k] : starts[k] + lengths[k]])
            done.append((words[k : k + 1], word, np.array([len(word)])))
        symbols, lengths, words = symbols[~np.repeat(long, lengths)], lengths[~long], words[~long]
    while len(words):
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(words)), lengths)
        ranks = np.full(len(symbols), NO_RANK)
        merged = np.zeros(len(symbols), dtype=symbols.dtype)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rows, there = _pair_rows(model, symbols[inside], symbols[inside + 1])
        inside, rows = inside[there], rows[there]
        ranks[inside] = model.pair_ranks[rows]
        merged[inside] = model.pair_merged[rows]
        least = np.minimum.reduceat(ranks, starts)
        places = np.flatnonzero((ranks == least[owner]) & (ranks < NO_RANK))
        # Of touching places only every other one can merge, from the left; of a rank
        # that may create a pair of its own rank or less only the first of the word.
        of = owner[places]
        first = np.ones(len(places), dtype=bool)
        first[1:] = of[1:] != of[:-1]
        fresh = first.copy()
        fresh[1:] |= places[1:] != places[:-1] + 1
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
        chosen = places[((np.arange(len(places)) - run) % 2 == 0) & (first | ~model.unsafe[ranks[places]])]
        symbols[chosen] = merged[chosen]
        stays = np.ones(len(symbols), dtype=bool)
        stays[chosen + 1] = False
        symbols, lengths = symbols[stays], lengths - np.bincount(owner[chosen], minlength=len(words))
        over = least == NO_RANK
        if over.any():
            leave(over)
    if not done:
        return symbols, lengths
    word, flat, sizes = (np.concatenate(parts) for parts in zip(*done))
    order = np.argsort(word, kind="stable")
    return flat[gather((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]


def _merge_heap(model: PieceModel, word: np.ndarray) -> np.ndarray:
    """One word, one merge at a time: smallest rank first, then leftmost."""
    symbols = word.tolist()
    after = list(range(1, len(symbols))) + [-1]
    before = list(range(-1, len(symbols) - 1))
    rows, there = _pair_rows(model, word[:-1], word[1:])
    heap = [
        (int(model.pair_ranks[r]), i, symbols[i], symbols[i + 1], int(model.pair_merged[r]))
        for i, (r, ok) in enumerate(zip(rows.tolist(), there.tolist()))
        if ok
    ]
    heapq.heapify(heap)
    known: dict[tuple[int, int], tuple[int, int] | None] = {}

    def look_up(left: int, right: int) -> tuple[int, int] | None:
        if (left, right) not in known:
            row, ok = _pair_rows(model, np.array([left]), np.array([right]))
            known[left, right] = (int(model.pair_ranks[row[0]]), int(model.pair_merged[row[0]])) if ok[0] else None
        return known[left, right]

    while heap:
        _, i, left, right, merged = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i], symbols[j] = merged, GONE
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (pair := look_up(symbols[a], symbols[b])):
                heapq.heappush(heap, (pair[0], a, symbols[a], symbols[b], pair[1]))
    return np.array([s for s in symbols if s != GONE], dtype=word.dtype)


def _word_ids(model: PieceModel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and their number per word."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # Characters without a symbol keep apart as negative values: no pair holds one.
    symbols = model.char_symbol[points].astype(np.int64)
    strange = symbols == model.n_symbols
    symbols[strange] = -1 - points[strange].astype(np.int64)
    flat, counts = _merge_rounds(model, symbols, lengths)
    outside = (flat < 0) | ~model.is_piece[np.maximum(flat, 0)]
    if not outside.any():
        return flat.astype(np.int32), counts
    owner = np.repeat(np.arange(len(counts)), counts)
    places = np.flatnonzero(outside)
    kinds, kind = np.unique(flat[places], return_inverse=True)
    chars = [chr(-1 - k) if k < 0 else model.letters[k] for k in kinds.tolist()]
    if model.byte_ids is not None:
        stand_ins = [model.byte_ids[list(c.encode("utf-8", "surrogatepass"))] for c in chars]
    else:
        stand_ins = [np.array([model.unknown_id]) for _ in chars]
    stand_in_sizes = np.array([len(f) for f in stand_ins], dtype=np.int64)
    sizes = np.ones(len(flat), dtype=np.int64)
    sizes[places] = stand_in_sizes[kind]
    if model.byte_ids is None:  # a run of unknown characters is one unknown id
        follows = (places[1:] == places[:-1] + 1) & (owner[places[1:]] == owner[places[:-1]])
        sizes[places[1:][follows]] = 0
    # All ids in question, after them those of the stand-ins; each symbol is a run of this table.
    table = np.concatenate([flat, *stand_ins])
    starts = np.arange(len(flat))
    starts[places] = len(flat) + (np.cumsum(stand_in_sizes) - stand_in_sizes)[kind]
    return (
        table[gather(starts, sizes)].astype(np.int32),
        np.bincount(owner, weights=sizes, minlength=len(counts)).astype(np.int64),
    )


@lru_cache(maxsize=4)
def _words_of(path: str) -> ChunkTable:
    model = load_pieces(path)
    return ChunkTable(lambda words: _word_ids(model, words), CACHED_WORDS)


def encode_batch(path: str, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and their number per text."""
    model, table = load_pieces(path), _words_of(path)
    apart = SPACE + model.breaks
    find = re.compile(f"{SPACE}+[^{apart}]*|[^{apart}]+" + f"|[{model.breaks}]" * bool(model.breaks)).findall
    prefix = SPACE if model.prefix else ""
    parts = []
    for start, stop in text_slices(texts, SLICE_IDS):
        shown = [prefix + t.replace(" ", SPACE) if t else "" for t in texts[start:stop]]
        if model.separable:
            parts.append(table.ids([find(t) for t in shown]))
        else:
            parts.append(table.ids([[t] if t else [] for t in shown]))
    none = (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
    ids, counts = (np.concatenate(x) for x in zip(none, *parts))
    return ids, counts


def decode_batch(model: PieceModel, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """Text of every run of ids; a byte that is no part of a character becomes U+FFFD."""
    stops = np.cumsum(counts)
    texts: list[str] = []
    first = 0
    while first < len(counts):  # a bounded number of ids at a time, one text at least
        begin = int(stops[first] - counts[first])
        last = max(first + 1, int(np.searchsorted(stops, begin + SLICE_IDS, side="right")))
        texts += _decode_slice(model, ids[begin : int(stops[last - 1])], counts[first:last])
        first = last
    return texts


def _decode_slice(model: PieceModel, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    ids = ids.astype(np.int64)
    lengths = np.diff(model.surface_starts)[ids]
    data = model.surfaces[gather(model.surface_starts[ids], lengths)].tobytes()
    ends = np.concatenate([[0], np.cumsum(lengths)])
    stops = np.cumsum(counts)
    texts = []
    for start, stop in zip((stops - counts).tolist(), stops.tolist()):
        text = data[ends[start] : ends[stop]]
        first = start
        while model.prefix and first < stop and model.control[ids[first]]:
            first += 1
        if model.prefix and first < stop and model.mark_first[ids[first]]:
            text = text[1:]
        texts.append(text.decode("utf-8", "each_byte"))
    return texts


def encode_ids(text: Column, path: str) -> Column:
    """Ids of a text column as array<int>; the model file must lie at ``path`` on every node."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        ids, counts = encode_batch(path, texts.to_pylist())
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))

    return encode(text)


def encode_checked(text: Column, path: str) -> Column:
    """Struct of the ids of a text and ``round_trip``, whether they decode to it (null: the empty text).

    The texts go to Python once and do not come back; of a batch, only a slice at a time becomes
    Python strings.
    """

    @F.arrow_udf("ids array<int>, round_trip boolean")
    def encode(texts: pa.Array) -> pa.Array:
        model, same = load_pieces(path), []
        id_parts, count_parts = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        for start, stop in size_slices(sizes, SLICE_IDS):
            shown = texts.slice(start, stop - start).to_pylist()
            ids, counts = encode_batch(path, shown)
            same += [(t or "") == d for t, d in zip(shown, decode_batch(model, ids, counts))]
            id_parts.append(ids)
            count_parts.append(counts)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(count_parts))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(id_parts), type=pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(same, type=pa.bool_())], ["ids", "round_trip"])

    return encode(text)


def encode_digests(text: Column, path: str) -> Column:
    """Struct of the number of ids, the SHA-256 of the ids as text and that of their decoded text.

    Both digests are lower-case hex; ids are decimal and joined by commas. A text goes to Python
    once and is encoded once, and only the digests come back.
    """

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pa.Array) -> pa.Array:
        model, shown_ids = load_pieces(path), _decimals(path)
        columns: tuple[list, list, list] = ([], [], [])
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        for start, stop in size_slices(sizes, SLICE_IDS):
            ids, counts = encode_batch(path, texts.slice(start, stop - start).to_pylist())
            columns[0].extend(counts.tolist())
            columns[1].extend(_joined_sha256(shown_ids, ids, counts))
            columns[2].extend(hashlib.sha256(t.encode()).hexdigest() for t in decode_batch(model, ids, counts))
        kinds = (pa.int64(), pa.string(), pa.string())
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.StructArray.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names)

    return digest(text)


@lru_cache(maxsize=4)
def _decimals(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The decimal form of every id with a comma behind it: bytes of all, and where each starts."""
    shown = [b"%d," % k for k in range(len(load_pieces(path).surface_starts) - 1)]
    return np.frombuffer(b"".join(shown), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in shown])])


def _joined_sha256(shown: tuple[np.ndarray, np.ndarray], ids: np.ndarray, counts: np.ndarray) -> list[str]:
    letters, starts = shown
    lengths = np.diff(starts)[ids]
    data = letters[gather(starts[ids], lengths)].tobytes()
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:])]


def decode_ids(ids: Column, path: str) -> Column:
    """Text of a column of id arrays; null counts as no ids."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        lists = lists.fill_null([]) if lists.null_count else lists
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        counts = np.diff(lists.offsets.to_numpy())
        return pa.array(decode_batch(load_pieces(path), flat, counts), type=pa.string())

    return decode(ids)
