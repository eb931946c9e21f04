import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lexical_search as ls
from tidemark.llm.common import work_folder

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top=10):
    held = [(d, t) for d, text in docs if (t := terms(text))]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    counts = [(d, len(t), Counter(t)) for d, t in held]
    df = Counter(term for _, _, c in counts for term in c)
    found = []
    for item, text in set(items):
        asked = Counter(terms(text))
        scored = []
        for d, n, c in counts:
            m = 25 + 75 * n * n_docs // n_terms
            score = 0
            for term, times in asked.items():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                score += times * w * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        scored.sort()
        found += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(scored[:top], 1)]
    return found


def run(spark, docs, items, parts=3):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score long, terms string")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    index = ls.build_index(df.repartition(parts), work_folder(spark))
    return [tuple(r) for r in ls.search(index, asked).collect()]


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(200)] + ["Ñandú", "ärger", "日本", "İx", "the", "a"]
    texts = [" ,.-_\n".join(rng.choices(words, k=rng.choice([1, 3, 20, 80, 400]))) for _ in range(n)]
    texts += ["the W1 w2 copy W3"] * 80 + [None, "", " .,! ", "w5 " * 5000, "Ñandú-ñandú"]
    return list(enumerate(texts))


ITEMS = [(1, "W1, w2 copy w3 the"), (2, "ÑANDÚ Ñandú ärger"), (3, "nothing-known here"), (4, None), (5, "w5 W5 w7"), (6, "w9 " * 40), (5, "the other text w8"), (1, "W1, w2 copy w3 the")]


def odd_rows():
    return [(3, "w1 repeated id"), (None, "w1 without id w2"), (None, "w1 without id w2")]


def test_equals_brute_force(spark):
    docs = corpus(0) + odd_rows()
    assert sorted(run(spark, docs, ITEMS), key=repr) == sorted(brute(docs, ITEMS), key=repr)


@pytest.mark.parametrize(
    "limits",
    [
        {"BLOCK_DOCS": 13, "BOUND_CELLS": 200, "FIRST": 2},
        {"BITS_PER_KEY": 1, "HASHES": 1, "BOUND_CELLS": 1, "TOP": 3},
        {"EXACT_CELLS": 20, "TERM_STEP": 2, "BLOCK_BYTES": 300},
    ],
)
def test_results_do_not_depend_on_limits(monkeypatch, limits):
    """The tasks' functions called here, where limits can be changed."""
    for name, value in limits.items():
        monkeypatch.setattr(ls, name, value)
    docs, items = corpus(len(limits)) + odd_rows(), sorted(set(ITEMS), key=repr)
    batches = [
        pa.RecordBatch.from_pydict(
            {"doc_id": pa.array([d for d, _ in part], pa.int64()), "text": pa.array([t or "" for _, t in part])}
        )
        for part in (docs[:200], docs[200:])
    ]
    blocks = list(ls._index_batches(iter(batches)))
    assert len(blocks) > 5
    held = [terms(t) for _, t in docs if terms(t)]
    asked = pa.RecordBatch.from_pydict({"item_id": [i for i, _ in items], "text": pa.array([t or "" for _, t in items])})
    queries = ls._queries(
        [type("Row", (), r) for r in asked.to_pylist()],
        type("Totals", (), {"docs": len(held), "terms": sum(map(len, held))}),
    )
    df = Counter(term for t in held for term in set(t))
    queries.weights = np.array(
        [math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) for t in queries.terms], dtype=np.int64
    )
    best = list(ls._search_batches(iter(blocks), queries, ls.TOP))[0].to_pylist()
    got = sorted((items[r["item"]][0], r["doc_id"], r["score"]) for r in best if r["doc_id"] is not None)
    expected = sorted((i, d, s) for i, _, d, s in brute(docs, items, ls.TOP) if d is not None)
    assert got == expected and len(best) == len(brute(docs, items, ls.TOP))


def test_nothing_to_search(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, [(1, None), (2, ".,")], ITEMS) == []
    assert run(spark, [(1, "a b")], []) == []


def test_terms_equal_the_pattern():
    rng = random.Random(5)
    letters = [chr(k) for k in range(0, 0x180)] + ["日", "😀", "A", "z", " "]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(500)]
    owner, found = ls.term_lists(pa.array([None, *texts]).slice(1))
    expected = [(k, t) for k, text in enumerate(texts) for t in terms(text)]
    assert list(zip(owner.tolist(), found.to_pylist())) == expected


def test_bounds_are_never_too_low():
    docs = [t or "" for _, t in corpus(7, 200)]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(docs)), pa.int64()), "text": pa.array(docs)})
    asked = sorted({t for _, text in ITEMS for t in terms(text)})
    blocks = list(ls._index_batches(iter([rows])))
    assert sum(b.column("n_docs")[0].as_py() for b in blocks) == sum(1 for t in docs if terms(t))
    kept = 0
    for row in blocks:
        queries = ls.Queries(asked, [], 285, 30_000)
        block = ls.Block(row, queries, ls.hashes_of(asked), pa.array(asked, pa.string()))
        for docs_here in block.windows():
            bounds = block.bounds(docs_here)
            for k in range(len(asked)):
                exact = block.exact(np.arange(docs_here.start, docs_here.stop), np.array([1]), np.array([k]))
                assert (bounds[k] >= exact).all()
                kept += int((bounds[k] == exact).sum())
    assert kept > 2000
