"""Embedding whitening over distinct vectors: count copies, fit once, whiten once, join back.

Entries become whole numbers, so equal vectors are found exactly. They fold to one row with
the number of its copies; the fit weighs every distinct vector by one or by that number:

1. exact sums per dimension (decimals in Spark) give the weight ``n`` and the centre ``S/n``;
2. each task centres its distinct vectors as ``(n*x - S)/n``, the numerator being a whole number,
   and adds up one weighted product matrix; the matrices of all tasks are summed row by row;
3. the driver, which sees one d x d matrix however many rows there are, takes its eigenvectors;
4. every distinct vector is projected once, and rows fetch their result by their vector.

A vector that very many rows share would be one key of both the fold and the join back. Rows
therefore also carry a salt, a hash of their id: the fold goes by (vector, salt) first and the
join fetches by (vector, salt), for the salts that occur.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are left out.
Vectors of different length form spaces of their own, each with its own fit. A space has as many
components as its covariance has rank, at most ``components``; one whose vectors are all equal, or
empty, has none and gives no rows. Entries beyond a 64-bit integer stop at its ends. Rows that repeat
are all returned, also those with a null id. ``deviation`` is null where it exceeds a 64-bit integer.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SCALE = 256
COMPONENTS = 4
RANK_TOLERANCE = 1e-12  # of the covariance's trace, under which an eigenvalue counts as zero
MAX_SPACE_ROWS = 100_000  # dimensions of all spaces together: what the driver holds rows of
LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Space:
    """The fit of all vectors of one length."""

    n: int
    sums: list[int]
    vectors: np.ndarray | None = None  # component x dimension
    values: np.ndarray | None = None  # eigenvalues
    explained: np.ndarray | None = None


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, x) with a usable vector, its entries c as floor(scale * c)."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    finite = "v IS NOT NULL AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    return rows.where(finite).select(
        "vec_id", F.expr(f"transform(v, c -> bigint(floor({scale}D * double(c)))) AS x")
    )


def whiten(rows: DataFrame, folder: str, components: int = COMPONENTS, by_count: bool = False) -> DataFrame:
    """Per row (vec_id, x) and component: n, deviation, whitened, explained, identity_error.

    ``by_count`` weighs a distinct vector by the number of its rows, otherwise by one. ``folder``
    takes the tables of distinct vectors.
    """
    spark = rows.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("salt", F.expr(f"int(pmod(xxhash64(vec_id), {salts}L))"))
    distinct = stored(_distinct(salted, by_count), folder, "distinct")
    spaces = _fit(distinct, components)
    whitened = stored(
        distinct.mapInArrow(
            lambda batches: _project(batches, spaces), "x array<bigint>, salts array<int>, weight bigint, y array<double>, deviation bigint"
        ),
        folder,
        "whitened",
    )
    errors = _identity_errors(whitened, spaces)
    facts = [
        (dim, k, space.n, float(space.explained[k]), errors[dim])
        for dim, space in spaces.items()
        for k in range(len(space.values))
    ]
    # A few rows per length of vectors.
    known = F.broadcast(
        spark.createDataFrame(facts, "dim int, k int, n long, explained double, identity_error double")
    )
    found = whitened.select("x", F.explode("salts").alias("salt"), "y", "deviation")
    joined = salted.join(found, ["x", "salt"]).select(
        "vec_id", F.size("x").alias("dim"), "deviation", F.posexplode("y").alias("k", "whitened")
    )
    return joined.join(known, ["dim", "k"]).select(
        "vec_id",
        F.expr("int(k + 1) AS component"),
        "n",
        "deviation",
        "whitened",
        "explained",
        "identity_error",
    )


def _distinct(salted: DataFrame, by_count: bool) -> DataFrame:
    """One row per distinct vector: its weight and the salts of its rows."""
    weight = F.sum("copies") if by_count else F.lit(1).cast("long")
    return (
        salted.groupBy("x", "salt")
        .agg(F.count("*").alias("copies"))
        .groupBy("x")
        .agg(F.collect_list("salt").alias("salts"), weight.alias("weight"))
    )


def _fit(distinct: DataFrame, components: int) -> dict[int, Space]:
    """The spaces by length of their vectors."""
    cells = distinct.select("weight", F.size("x").alias("dim"), F.posexplode("x").alias("i", "entry"))
    sums = (
        cells.groupBy("dim", "i")
        .agg(
            F.sum("weight").alias("n"),
            F.expr("sum(CAST(entry AS DECIMAL(20, 0)) * CAST(weight AS DECIMAL(18, 0))) AS total"),
        )
        .limit(MAX_SPACE_ROWS + 1)
        .collect()
    )
    if len(sums) > MAX_SPACE_ROWS:
        raise ValueError(f"the lengths of the vectors add up to over {MAX_SPACE_ROWS}")
    spaces = {
        dim: Space(n, [int(r.total) for r in sorted((r for r in sums if r.dim == dim), key=lambda r: r.i)])
        for dim, n in {r.dim: r.n for r in sums}.items()
    }
    products = distinct.mapInArrow(lambda batches: _products(batches, spaces), "dim int, i int, part int, row array<double>")
    summed = products.groupBy("dim", "i").applyInArrow(_sum_rows, "dim int, i int, row array<double>").collect()
    for dim, space in spaces.items():
        rows = sorted((r.i, r.row) for r in summed if r.dim == dim)
        spaces[dim] = _eigen(space, np.array([row for _, row in rows]) / space.n, components)
    return spaces


def _eigen(space: Space, covariance: np.ndarray, components: int) -> Space:
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors.T[::-1][:components]
    trace = float(np.trace(covariance))
    kept = values > RANK_TOLERANCE * trace
    values, vectors = values[kept], vectors[kept]
    # Of the two signs the one whose largest entry is positive.
    largest = np.argmax(np.abs(vectors), axis=1)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]
    return Space(space.n, space.sums, vectors, values, values / trace if trace else values)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length of the batch's vectors: the length, their places, and their entries as a matrix."""
    lists = batch.column("x")
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(sizes, sizes)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        yield dim, np.flatnonzero(sizes == dim), flat[owner == dim].reshape(-1, dim)


def _deviations(space: Space, x: np.ndarray) -> np.ndarray:
    """n*x - S: 64-bit integers where they fit, else Python's."""
    reach = max(int(x.max()), -int(x.min())) * space.n + max(map(abs, space.sums))
    kind = np.int64 if reach < 1 << 62 else object
    return x.astype(kind) * space.n - np.array(space.sums, dtype=kind)


def _centred(space: Space, x: np.ndarray) -> np.ndarray:
    return (_deviations(space, x) / space.n).astype(np.float64)


def _products(batches: Iterator[pa.RecordBatch], spaces: dict[int, Space]) -> Iterator[pa.RecordBatch]:
    """Rows of this task's sum of weighted outer products, per length."""
    from pyspark import TaskContext

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        weights = batch.column("weight").to_numpy()
        for dim, places, x in _by_length(batch):
            z = _centred(spaces[dim], x) * np.sqrt(weights[places].astype(np.float64))[:, None]
            total = sums.setdefault(dim, np.zeros((dim, dim)))
            total += z.T @ z
    part = TaskContext.get().partitionId()
    for dim, total in sums.items():
        offsets = pa.array(np.arange(dim + 1) * dim, pa.int32())
        yield pa.RecordBatch.from_pydict(
            {
                "dim": pa.array([dim] * dim, pa.int32()),
                "i": pa.array(range(dim), pa.int32()),
                "part": pa.array([part] * dim, pa.int32()),
                "row": pa.ListArray.from_arrays(offsets, pa.array(total.reshape(-1))),
            }
        )


def _sum_rows(rows: pa.Table) -> pa.Table:
    """Sum of the same matrix row of all tasks, in the order of the tasks."""
    ordered = rows.sort_by("part")
    total = np.sum([np.array(r) for r in ordered.column("row").to_pylist()], axis=0)
    return pa.table(
        {
            "dim": ordered.column("dim").slice(0, 1),
            "i": ordered.column("i").slice(0, 1),
            "row": pa.array([total.tolist()], pa.list_(pa.float64())),
        }
    )


def _project(batches: Iterator[pa.RecordBatch], spaces: dict[int, Space]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y: list = [[] for _ in range(batch.num_rows)]
        deviation: list = [0] * batch.num_rows
        for dim, places, x in _by_length(batch):
            space = spaces[dim]
            whole = _deviations(space, x)
            projected = (whole / space.n).astype(np.float64) @ space.vectors.T / np.sqrt(space.values)
            reach = max(int(whole.max()), -int(whole.min()))
            squares = (whole if reach * reach * dim <= LARGEST else whole.astype(object)) ** 2
            for place, row, square in zip(places.tolist(), projected.tolist(), squares.sum(axis=1).tolist()):
                y[place], deviation[place] = row, square if square <= LARGEST else None
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("x"),
                batch.column("salts"),
                batch.column("weight"),
                pa.array(y, pa.list_(pa.float64())),
                pa.array(deviation, pa.int64()),
            ],
            names=["x", "salts", "weight", "y", "deviation"],
        )


def _identity_errors(whitened: DataFrame, spaces: dict[int, Space]) -> dict[int, float]:
    """Per length the largest entry of the whitened vectors' covariance minus the identity."""
    most = max((len(s.values) for s in spaces.values()), default=0)

    def mean(value: str) -> Column:
        return F.expr(f"sum(weight * {value}) / sum(weight)")

    firsts = [mean(f"get(y, {i})").alias(f"m{i}") for i in range(most)]
    pairs = [
        mean(f"get(y, {i}) * get(y, {j})").alias(f"p{i}_{j}") for i in range(most) for j in range(i, most)
    ]
    errors = {dim: 0.0 for dim in spaces}
    if not most:
        return errors
    for r in whitened.groupBy(F.size("x").alias("dim")).agg(*firsts, *pairs).collect():
        size = len(spaces[r.dim].values) if r.dim in spaces else 0
        gaps = [
            abs(r[f"p{i}_{j}"] - r[f"m{i}"] * r[f"m{j}"] - (i == j)) for i in range(size) for j in range(i, size)
        ]
        errors[r.dim] = max(gaps, default=0.0)
    return errors
