"""Near-duplicate documents by SetSketch registers, verified on full shingle sets.

A document is the set of its word shingles. Its SetSketch has one register per
slot: every element throws points from successive exponential intervals at the
slots in a random order without repetition, a slot keeps its least point, and the
register is that minimum truncated to a whole power of the base. Registers of a
union are the maxima of the registers, and equal registers are about as likely as
the sets are similar.

1. One pass makes per document the set's size, a 128-bit digest and the sketch.
   Documents of one digest have equal sets; each digest goes on as one node, named
   by its least doc_id. A group of copies, however large, ends here.
2. Runs of registers make band keys. Each bucket elects its least node as leader, so
   a bucket of n nodes gives n - 1 rows, never all pairs. Two nodes of one bucket share
   its leader: all candidate pairs lie within the leaders' groups.
3. Each set is compared with its leader's, in blocks. The links so found, of all leaders,
   give classes; what they connect needs no further look, nor do nodes that meet in the group
   of a smaller leader already. The largest part of a group that is settled in one of these
   ways stays apart; the nodes outside it, the free ones, must still meet all others: their
   blocks meet each other and the blocks of that part, two at a time in a task of
   bounded size. A pair is verified on its full sets unless it is already connected, its
   sizes or its distances to the leader (Jaccard distance is a metric) exclude a link, or
   the joint likelihood of the registers puts the similarity ``MARGIN`` below the
   threshold. A task returns links only, at most one less than its rows.
4. Connected components of the classes by these links.

No candidate is capped. A link at the threshold itself is missed by all bands with a
chance of at most ``MAX_MISS``; more similar ones with less.

Defined results: null, empty and blank texts have the empty set and are linked with
nothing; shorter texts than a shingle are one shingle of all their words; rows with an
equal doc_id count as one document, linked to whatever any of them is linked to; a null
doc_id is linked with nothing and has a null component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, stored, text_of, work_folder
from tidemark.llm.components import component_labels

SHINGLE_WORDS = 5
SLOTS = 256
BASE = 1.1
RATE = 20.0
LIMIT = 254  # registers are one byte
MAX_MISS = 2e-6
MARGIN = 0.12
SLICE_BYTES = 1 << 22
BLOCK_NODES = 64
MEETING_NODES = 512  # of one block
MEETING_SHINGLES = 1 << 19  # of one block, 8 bytes each
PAIRS_AT_ONCE = 1 << 14
BROADCAST_IDS = 1 << 21

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least ``over / under``, in whole numbers."""

    over: int = 80
    under: int = 100

    @property
    def value(self) -> float:
        return self.over / self.under

    def links(self, common: int, size_a: int, size_b: int) -> bool:
        return self.under * common >= self.over * (size_a + size_b - common) and common > 0

    @property
    def rows(self) -> int:
        """Registers per band: as many as keep the chance to miss a link under ``MAX_MISS``."""
        equal = log(1 + self.value * (BASE - 1)) / log(BASE)
        fits = [r for r in range(1, 33) if (1 - equal**r) ** (SLOTS // r) <= MAX_MISS]
        return max(fits, default=1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each whole text.

    Only A-Z are lower-cased, and only ASCII white space parts words.
    """
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sets = []
    for tokens in split:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
        width = min(words, len(tokens))
        if not width:
            sets.append(hashes)
            continue
        count = len(tokens) - width + 1
        rolled = np.full(count, width, dtype=np.uint64)
        for k in range(width):
            rolled = _mix(rolled * MULTIPLIER + hashes[k : k + count])
        sets.append(np.unique(rolled))
    return sets


_STEPS = np.array([s for s in range(1, SLOTS) if gcd(s, SLOTS) == 1], dtype=np.int64)
_BORDERS = np.array([np.log1p(j / (SLOTS - j)) / RATE if j < SLOTS else np.inf for j in range(SLOTS + 1)])


def _register(points: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(1.0 - np.log(points) / log(BASE)), 0, LIMIT).astype(np.uint8)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of every set, one row each; the empty set has zeros.

    Round j throws the j-th point of every element, all from the j-th interval. A set
    is done when no point of the next interval can raise its least register.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    registers = np.zeros((len(sets), SLOTS), dtype=np.uint8)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return registers
    elements = _mix(np.concatenate([sets[r] for r in rows]) ^ MULTIPLIER)
    owner = np.repeat(np.arange(len(rows)), sizes[rows])
    slot = (elements & np.uint64(SLOTS - 1)).astype(np.int64)
    step = _STEPS[((elements >> np.uint64(8)) % np.uint64(len(_STEPS))).astype(np.int64)]
    found = np.zeros(len(rows) * SLOTS, dtype=np.uint8)
    for j in range(SLOTS):
        salt = np.uint64((j + 1) * int(MULTIPLIER) % 2**64)
        uniform = (_mix(elements + salt) >> np.uint64(11)) * 2.0**-53
        reach = -np.expm1(-RATE * (_BORDERS[j + 1] - _BORDERS[j]))
        points = _BORDERS[j] - np.log1p(-uniform * reach) / RATE
        np.maximum.at(found, owner * SLOTS + slot, _register(np.maximum(points, 1e-300)))
        if j + 1 == SLOTS:
            break
        least = found.reshape(-1, SLOTS).min(axis=1)
        active = least < _register(_BORDERS[j + 1 : j + 2])[0]
        stays = active[owner]
        if not stays.any():
            break
        if not stays.all():
            elements, owner, slot, step = elements[stays], owner[stays], slot[stays], step[stays]
        slot = (slot + step) % SLOTS
    registers[rows] = found.reshape(-1, SLOTS)
    return registers


def likely_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of paired register rows, the set sizes being known.

    With u and v the shares of the sizes, a register of the first set exceeds one of the
    second with chance p(u - vJ), and the other way round with p(v - uJ), where
    p(x) = -log_b(1 - x (b - 1) / b). The likelihood is concave in J: bisect its slope.
    """
    above, below = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    equal = a.shape[-1] - above - below
    u = size_a / (size_a + size_b)
    v = 1 - u
    factor, unit = (BASE - 1) / BASE, log(BASE)

    def chance(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = 1 - np.clip(x, 1e-12, 1) * factor
        return -np.log(inner) / unit, factor / inner / unit

    low, high = np.zeros(u.shape), np.minimum(u / v, v / u)
    for _ in range(20):
        mid = (low + high) / 2
        p, dp = chance(u - v * mid)
        q, dq = chance(v - u * mid)
        slope = -above * v * dp / p - below * u * dq / q + equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12)
        low, high = np.where(slope > 0, mid, low), np.where(slope > 0, high, mid)
    return (low + high) / 2


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in runs of bounded bytes, one text at least."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_BYTES or k + 1 == len(texts):
            yield ids[start : k + 1], texts[start : k + 1]
            start, size = k + 1, 0


def document_sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch) of every row of (doc_id, text)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _slices(batch):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(ids, pa.int64()),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array([_digest(s) for s in sets], pa.binary()),
                        "sketch": pa.array([r.tobytes() for r in sketches(sets)], pa.binary()),
                    }
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, sketch binary")


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _bands(rows: int) -> F.Column:
    """Key of every band of the sketch; the band's number is part of its key."""
    return F.array(
        *[
            F.xxhash64(F.lit(band), F.substring("sketch", band * rows + 1, rows))
            for band in range(SLOTS // rows)
        ]
    )


def leader_groups(nodes: DataFrame, rows: int) -> DataFrame:
    """Distinct (leader, node): nodes that share a bucket with a smaller node, its leader."""
    keyed = nodes.select("node", F.explode(_bands(rows)).alias("bucket"))
    leaders = (
        keyed.groupBy("bucket")
        .agg(F.min("node").alias("leader"), F.max("node").alias("_last"))
        .where("_last > leader")
        .select("bucket", "leader")
    )
    return keyed.join(leaders, "bucket").where("node <> leader").select("leader", "node").distinct()


def _shingles_of(docs: DataFrame) -> DataFrame:
    """(node, part, shingles, sketch) of (node, text); ``part`` tells the sets of one node apart."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _slices(batch):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array(ids, pa.int64()),
                        "part": pa.array([int.from_bytes(_digest(s)[:8], "big", signed=True) for s in sets], pa.int64()),
                        "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                        "sketch": pa.array([r.tobytes() for r in sketches(sets)], pa.binary()),
                    }
                )

    return docs.select("node", "text").mapInArrow(
        shingle, "node long, part long, shingles binary, sketch binary"
    )


def _fetched(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Shingle sets of all nodes of the groups.

    Ids up to ``BROADCAST_IDS`` (16 bytes each) are broadcast; more are joined by a shuffle.
    """
    wanted = groups.select("node").union(groups.select("leader")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), text_of("text").alias("text"))
    small = wanted.count() <= BROADCAST_IDS
    return _shingles_of(texts.join(F.broadcast(wanted) if small else wanted, "node")).dropDuplicates(["node", "part"])


def _blocks(count: F.Column) -> F.Column:
    return F.ceil(count / BLOCK_NODES).cast("int")


def _meeting_blocks(count: F.Column, shingles: F.Column) -> F.Column:
    return F.ceil(F.greatest(count / MEETING_NODES, shingles / MEETING_SHINGLES)).cast("int")


def _block(blocks: F.Column) -> F.Column:
    return F.pmod(F.xxhash64("node", "part"), blocks).cast("int")


def _sets_in(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(s, dtype=np.uint64) for s in column.to_pylist()]


def leader_distances(groups: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """(leader, node, part, distance, linked, n_shingles): each set against its leader's, in blocks.

    A leader with several sets has no distance of its own: it is null, and the link the best.
    """
    parts = groups.join(sets.select("node", "part"), "node")
    sizes = parts.groupBy("leader").agg(_blocks(F.count("*")).alias("_blocks"))
    members = parts.join(sizes, "leader").select("leader", _block(F.col("_blocks")).alias("block"), "node", "part")
    own = sets.select(F.col("node").alias("leader"), "part")
    chairs = members.select("leader", "block").distinct().join(own, "leader")
    chairs = chairs.select("leader", "block", F.col("leader").alias("node"), "part")
    rows = members.unionByName(chairs).join(sets.select("node", "part", "shingles"), ["node", "part"])

    def compare(table: pa.Table) -> pa.Table:
        nodes, keys = table.column("node").to_pylist(), table.column("part").to_pylist()
        leader, found = table.column("leader")[0].as_py(), _sets_in(table.column("shingles"))
        heads = [found[k] for k, node in enumerate(nodes) if node == leader]
        rows = []
        for k, node in enumerate(nodes):
            if node != leader:
                commons = [(_common(h, found[k]), len(h), len(found[k])) for h in heads]
                common, x, y = commons[0]
                distance = 1 - common / (x + y - common) if len(heads) == 1 else None
                rows.append((leader, node, keys[k], distance, any(threshold.links(*c) for c in commons), y))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64())
        columns = zip(*rows) if rows else ([],) * 6
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=["leader", "node", "part", "distance", "linked", "n_shingles"],
        )

    return rows.groupBy("leader", "block").applyInArrow(
        compare, "leader long, node long, part long, distance double, linked boolean, n_shingles long"
    )


def _classed(nodes: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """``nodes`` with the class of ``node``: its label, or itself where no link holds it."""
    known = labels.select(F.col("node").alias(node), F.col("label").alias(name))
    return nodes.join(known, node, "left").withColumn(name, F.coalesce(name, node))


def _meetings(stars: DataFrame, labels: DataFrame, size: str = "0") -> DataFrame:
    """(leader, kind, i, j, side, node, part, distance, class): blocks of which each two meet once.

    A node's home is its least leader. Nodes of one class are connected, and nodes of one home
    below the leader meet there, if anywhere. Free nodes are those outside the largest class or home of the group.
    Kind 0: two blocks of free nodes; kind 1: one of them (side 0) and one of the others (side 1). A
    group of one class or home has nothing to meet. ``size`` is the number of a node's shingles.
    """
    homes = stars.groupBy("node").agg(F.min("leader").alias("_home"))
    classed = _classed(stars.drop("linked"), labels, "node", "class").withColumn("_size", F.expr(size))
    classed = classed.join(homes, "node").withColumn("_home", F.expr("IF(_home < leader, _home, NULL)"))
    settled = [
        classed.where(f"{of} IS NOT NULL")
        .groupBy("leader", F.lit(by).alias("_by"), F.col(of).alias("_of"))
        .agg(F.count("*").alias("_n"), F.sum("_size").alias("_held"))
        for by, of in (("class", "class"), ("home", "_home"))
    ]
    largest = settled[0].unionByName(settled[1]).groupBy("leader").agg(
        F.max(F.struct("_n", "_by", "_of", "_held")).alias("_top"),
        F.sum(F.expr("IF(_by = 'class', _n, 0)")).alias("_all"),
        F.sum(F.expr("IF(_by = 'class', _held, 0)")).alias("_whole"),
    )
    blocks = largest.where("_top._n < _all").select(
        "leader",
        F.col("_top._by").alias("_by"),
        F.col("_top._of").alias("_of"),
        _meeting_blocks(F.col("_all") - F.col("_top._n"), F.col("_whole") - F.col("_top._held")).alias("_f"),
        _meeting_blocks(F.col("_top._n"), F.col("_top._held")).alias("_l"),
    )
    sized = classed.join(blocks, "leader").withColumn(
        "_tied", F.expr("coalesce(IF(_by = 'class', class, _home) = _of, false)")
    )
    free = sized.where("NOT _tied").withColumn("own", _block(F.col("_f")))
    tied = sized.where("_tied").withColumn("own", _block(F.col("_l")))

    def meet(rows: DataFrame, kind: int, others: str, i: F.Column, j: F.Column, side: F.Column) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        meeting = [F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side")]
        return rows.withColumn("_o", every).select("leader", *meeting, "node", "part", "distance", "class")

    own, other = F.col("own"), F.col("_o")
    among = meet(free, 0, "_f", F.least(own, other), F.greatest(own, other), own)
    across = meet(free, 1, "_l", own, other, F.lit(0))
    return among.unionByName(across).unionByName(meet(tied, 1, "_f", other, own, F.lit(1)))


class _Forest:
    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _common(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def meeting_links(
    classes: list[int],
    sides: np.ndarray,
    sets: list[np.ndarray],
    registers: np.ndarray,
    distances: np.ndarray,
    threshold: Threshold,
) -> list[tuple[int, int]]:
    """Places of linked rows that connect all that is linked in one meeting of two blocks."""
    sizes = np.array([len(s) for s in sets], dtype=float)
    blocks = np.unique(sides)
    forest, links = _Forest(len(sets)), []
    first_of: dict[int, int] = {}
    for k, own in enumerate(classes):  # nodes of one class are connected already
        forest.union(first_of.setdefault(own, k), k)
    first, second = np.flatnonzero(sides == blocks[0]), np.flatnonzero(sides == blocks[-1])
    x, y = (part.ravel() for part in np.meshgrid(first, second, indexing="ij"))
    close = np.minimum(sizes[x], sizes[y]) >= (threshold.value - 1e-9) * np.maximum(sizes[x], sizes[y])
    close &= (x < y) | (len(blocks) > 1)
    close &= ~(np.abs(distances[x] - distances[y]) > 1 - threshold.value + 1e-9)
    x, y = x[close], y[close]
    if not len(x):
        return links
    runs = [slice(k, k + PAIRS_AT_ONCE) for k in range(0, len(x), PAIRS_AT_ONCE)]
    likely = np.concatenate(
        [likely_similarity(registers[x[r]], registers[y[r]], sizes[x[r]], sizes[y[r]]) for r in runs]
    )
    near = likely >= threshold.value - MARGIN
    x, y, likely = x[near], y[near], likely[near]
    for k in np.argsort(-likely, kind="stable").tolist():
        a, b = int(x[k]), int(y[k])
        if forest.find(a) != forest.find(b):
            common = _common(sets[a], sets[b])
            if threshold.links(common, len(sets[a]), len(sets[b])):
                forest.union(a, b)
                links.append((a, b))
    return links


def _met(stars: DataFrame, labels: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """(a, b): classes that the links found in meetings connect."""

    def verify(table: pa.Table) -> pa.Table:
        classes = table.column("class").to_pylist()
        registers = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8)
        links = meeting_links(
            classes,
            table.column("side").to_numpy(),
            _sets_in(table.column("shingles")),
            registers.reshape(-1, SLOTS),
            np.array([np.nan if d is None else d for d in table.column("distance").to_pylist()]),
            threshold,
        )
        ends = ([classes[x] for x, _ in links], [classes[y] for _, y in links])
        return pa.table([pa.array(e, pa.int64()) for e in ends], names=["a", "b"])

    met = _meetings(stars, labels, "n_shingles").join(sets, ["node", "part"])
    return met.groupBy("leader", "kind", "i", "j").applyInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: Threshold = Threshold()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text)."""
    folder = work_folder(docs.sparkSession)
    sketched = stored(document_sketches(docs), folder, "sketches")
    filled = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    named = stored(filled.groupBy("digest").agg(F.min("doc_id").alias("node")), folder, "names")
    nodes = (
        filled.join(named, "digest").where("doc_id = node").select("node", "sketch").distinct()
    )
    groups = stored(leader_groups(nodes, threshold.rows), folder, "groups")
    sets = stored(_fetched(docs, groups), folder, "sets")
    stars = stored(leader_distances(groups, sets, threshold), folder, "stars")
    edges = stars.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    # Equal ids are one document: the nodes of all its texts are linked.
    held = filled.select("doc_id", "digest").join(named, "digest").select("doc_id", "node").distinct()
    several = held.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_last")).where("a < _last")
    same = held.join(several, "doc_id").select("a", F.col("node").alias("b"))
    labels = component_labels(edges.union(same), f"{folder}/by-leader")
    joined = component_labels(_met(stars, labels, sets, threshold), f"{folder}/by-meeting")
    classes = _classed(_classed(named, labels, "node", "class"), joined, "class", "component_id")
    classes = classes.select("digest", "component_id")
    result = sketched.withColumn("_digest", F.expr("IF(n_shingles > 0 AND doc_id IS NOT NULL, digest, NULL)"))
    return (
        result.select("doc_id", "n_shingles", "_digest")
        .join(classes.withColumnRenamed("digest", "_digest"), "_digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.expr("doc_id IS NULL OR doc_id = coalesce(component_id, doc_id)").alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, threshold: Threshold = Threshold()) -> DataFrame:
    """``docs`` with one row of each class of linked texts: the one with the least id.

    Classes are of texts, whatever ids the rows carry: no text is lost because another one
    has its id, and copies without an id leave one row, an identified one where there is
    one. Rows that tie are told apart by the md5 of the whole row, so reruns agree. Texts without words are
    linked with nothing: they stay, but rows that repeat both such a text and an id leave one.
    """
    folder = work_folder(docs.sparkSession)
    # Row numbers are only fixed once they are stored.
    numbered = stored(docs.select(packed(docs), F.monotonically_increasing_id().alias("_no")), folder, "numbered")
    classes = near_duplicates(
        numbered.select(F.col("_no").alias("doc_id"), F.col("_row.text").alias("text")), threshold
    ).select(F.col("doc_id").alias("_no"), "n_shingles", "component_id")
    ids = numbered.select("_no", F.col("_row.doc_id").alias("_id"), F.md5(F.to_json("_row")).alias("_tie"))
    least = (
        classes.join(ids, "_no")
        .groupBy(
            F.expr("CASE WHEN n_shingles > 0 THEN 'class' WHEN _id IS NULL THEN 'row' ELSE 'id' END").alias("_kind"),
            F.expr("CASE WHEN n_shingles > 0 THEN component_id WHEN _id IS NULL THEN _no END").alias("_class"),
            F.expr("IF(n_shingles > 0, NULL, _id)").alias("_wordless"),
        )
        .agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_tie", "_no")).alias("_least"))
        .select("_least._no")
    )
    return numbered.join(least, "_no", "left_semi").select("_row.*")
