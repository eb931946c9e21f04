"""Score text quality by compression with dictionaries of good and bad text.

Two zstandard dictionaries are made of labelled good and bad text. A text is
compressed in whole, block by block, with each; the normalised difference of the
two sizes, with the compression ratio itself, becomes a probability by logistic
calibration on other labelled rows.

Only the fit is bounded: about ``fit_rows`` labelled rows per class, drawn by a hash
of their id among texts of 1 to ``fit_chars`` characters, go to the driver. Of these,
every second row fills the dictionaries and the rest calibrate. Scoring is a column
expression over any number of rows, each text whole.

Defined results: a null or empty text has compressed sizes of 0, a difference of 0
and a ratio of 1, and gets the score of those figures; labels that are null are
ignored; an id labelled twice counts by its greatest label; with labels of one
class only, or none, every score is that class's share (0.5 without labels).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

BLOCK = 2048
FIT_ROWS = 4000
FIT_CHARS = 20_000
DICTIONARY_BYTES = 1 << 19
LEVEL = 3
RIDGE = 1e-3
THRESHOLD = 0.3
DRAWS = 1_000_000


@dataclass(frozen=True)
class QualityModel:
    """Two raw dictionaries and the calibration; at most two times ``DICTIONARY_BYTES``."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the last one is the intercept

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        good, bad = _compressor(self.good), _compressor(self.bad)
        sizes = np.array([_sizes(good, bad, t) for t in texts], dtype=float).reshape(-1, 3)
        z = _design((_features(sizes) - self.mean) / self.scale)
        return 1.0 / (1.0 + np.exp(-np.clip(z @ np.array(self.weights), -30, 30)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, **options)
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=content, **options)


def _sizes(good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, text: str | None) -> tuple:
    """Compressed size by either dictionary, and the size itself, of the whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
    return sum(len(good.compress(b)) for b in blocks), sum(len(bad.compress(b)) for b in blocks), len(data)


def _features(sizes: np.ndarray) -> np.ndarray:
    by_good, by_bad, plain = sizes.T
    both = np.maximum(by_good + by_bad, 1)
    difference = (by_bad - by_good) / both
    ratio = np.where(plain > 0, both / 2 / np.maximum(plain, 1), 1.0)
    return np.column_stack([difference, ratio, np.log1p(plain)])


def _design(z: np.ndarray) -> np.ndarray:
    """Features, their squares and products, and a constant; far outliers are drawn in."""
    z = np.clip(z, -6, 6)
    pairs = [z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i, z.shape[1])]
    return np.column_stack([z, *pairs, np.ones(len(z))])


def _dictionary(texts: Sequence[str]) -> bytes:
    """One block of every text in turn, until the dictionary is full; the first texts stand last."""
    parts, size = [], 0
    blocks = [t.encode("utf-8", "surrogatepass") for t in texts]
    for start in range(0, FIT_CHARS * 4, BLOCK):
        for data in blocks:
            if size < DICTIONARY_BYTES and data[start : start + BLOCK]:
                parts.append(data[start : start + BLOCK])
                size += len(parts[-1])
    return b"\n".join(reversed(parts))[-DICTIONARY_BYTES:]


def _calibrate(x: np.ndarray, y: np.ndarray, importance: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (importance * (p - y)) + RIDGE * beta
        curvature = (x * (importance * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(beta))
        step = np.linalg.solve(curvature, gradient)
        step /= max(1.0, np.abs(step).max())
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_quality(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS
) -> QualityModel:
    """Fit on documents (doc_id, text) and labels (doc_id, quality).

    Class shares are counted over all labelled rows, so scores are calibrated to the
    whole table and not to the sample. Only narrow rows are joined; the sample's ids,
    about ``fit_rows`` per class by a hash threshold, are broadcast to fetch its texts.
    """
    marks = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("label"))
    )
    size = F.length(text_of("text")).between(1, fit_chars).alias("usable")
    known = docs.where("doc_id IS NOT NULL").select("doc_id", size).join(marks, "doc_id")
    counts = {
        int(r["label"]): (int(r["n"]), int(r["usable"]))
        for r in known.groupBy("label").agg(F.count("*").alias("n"), F.count_if("usable").alias("usable")).collect()
    }
    shares = {label: n for label, (n, _) in counts.items()}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(DRAWS))
    keep = {label: DRAWS * fit_rows // max(usable, fit_rows) for label, (_, usable) in counts.items()}
    bound = F.when(F.col("label") == 1, keep.get(1, 0)).otherwise(keep.get(0, 0))
    ids = known.where(F.col("usable") & (draw < bound)).select("doc_id", "label").distinct()
    # About 2 * fit_rows ids at most, whatever the size of the tables.
    picked = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = sorted(picked.collect(), key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["text"]))
    texts = {label: [r["text"] for r in rows if r["label"] == label and r["text"]] for label in (0, 1)}
    texts = {label: found[:fit_rows] for label, found in texts.items()}
    good, bad = _dictionary(texts[1][::2]), _dictionary(texts[0][::2])
    held = {label: texts[label][1::2] for label in (0, 1)}
    total = sum(shares.values())
    if not held[0] or not held[1]:
        share = shares.get(1, 0) / total if total else 0.5
        flat = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        empty = _design(np.zeros((1, 3))).shape[1]
        return QualityModel(good, bad, (0.0,) * 3, (1.0,) * 3, (0.0,) * (empty - 1) + (flat,))
    by_good, by_bad = _compressor(good), _compressor(bad)
    sizes = np.array([_sizes(by_good, by_bad, t) for label in (0, 1) for t in held[label]], dtype=float)
    y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    importance = np.where(y == 1, shares[1] / len(held[1]), shares[0] / len(held[0]))
    importance *= len(y) / importance.sum()
    features = _features(sizes)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    weights = _calibrate(_design((features - mean) / scale), y, importance)
    return QualityModel(good, bad, tuple(mean.tolist()), tuple(scale.tolist()), tuple(weights.tolist()))


def quality_score(df: DataFrame, model: QualityModel, text: str = "text") -> Column:
    """Probability that a text is good; the model is broadcast (two bounded dictionaries)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return score(text_of(text))


def held_out(doc_id: Column) -> Column:
    """One fold in five, by crc32 of the id's text."""
    return F.crc32(doc_id.cast("string")) % 5 == 0
