import random

import numpy as np
import pytest

from tidemark.llm import near_dedup
from tidemark.llm.near_dedup import Threshold, drop_near_duplicates, likely_similarity, near_duplicates, shingle_sets, sketches

SCHEMA = "doc_id long, text string, component_id long, _digest string"


def shingles(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(rows, over, under=100):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            common = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] and sets[i] and sets[j] or common and under * common >= over * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((str(r[0]), len(sets[i]), str(least.get(find(i)))) for i, r in enumerate(rows))


def found(spark, rows, over):
    got = near_duplicates(spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA), Threshold(over, 100)).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)


def corpus(seed):
    """Clean texts, exact copies, copies with growing numbers of edits, chains and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [text(rng.randint(1, 150)) for _ in range(60)]
    base = text(150).split()
    for edits in range(0, 14):
        for _ in range(8):
            copy = list(base)
            for place in rng.sample(range(150), edits):
                copy[place] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    chain = text(120).split()
    for _ in range(15):
        chain = chain[2:] + rng.choices(vocabulary, k=2)
        rows.append(" ".join(chain))
    rows += [rows[0].upper()] * 30 + ["a b c d e f", "a b c d e f g", "A  b\tc d e f", "a b", "A b", "b a", "", " \n", None]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize(("seed", "over"), [(1, 85), (2, 80)])
def test_classes_equal_brute_force(spark, seed, over):
    rows = corpus(seed)
    assert found(spark, rows, over) == brute(rows, over)


def test_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(5, a), (5, a), (5, b), (7, b), (9, c), (None, c), (None, None), (3, a)]
    assert found(spark, rows, 85) == brute(rows, 85)
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], SCHEMA)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in kept.collect()}
    assert kept.count() == 4 and texts == {(3, a), (5, b), (9, c), (None, None)}


def test_no_text_is_lost_with_its_id(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (1, b), (None, c), (None, c), (2, ""), (2, ""), (3, None), (None, " "), (None, " ")]
    left = [(1, a), (1, b), (2, ""), (3, None), (None, " "), (None, " "), (None, c)]
    for parts in (1, 3):
        docs = spark.createDataFrame([(*r, 1, "y") for r in rows], SCHEMA).repartition(parts)
        found_rows = [(r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()]
        assert sorted(map(str, found_rows)) == sorted(map(str, left))


def test_rows_that_tie_leave_the_same_one(spark):
    a = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a, k, "y") for k in range(20)], SCHEMA)
    runs = [drop_near_duplicates(docs.repartition(n)).collect() for n in (1, 4)]
    assert len(runs[0]) == 1 and runs[0] == runs[1]


def test_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "unlike the others in every word")]
    assert found(spark, rows, 85) == brute(rows, 85)


def test_registers_merge_and_estimate_similarity():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    a, b = shingle_sets([" ".join(rng.choices(words, k=900)), " ".join(rng.choices(words, k=300))])
    ra, rb, rab = sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == rab).all()
    pool = np.unique(np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64))
    errors = []
    for k in range(60):
        similar = 0.5 + 0.008 * k
        common = int(2000 * 2 * similar / (1 + similar))
        x, y = pool[:2000], np.concatenate([pool[2000 - common : 2000], pool[2000 : 4000 - common]])
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        salt = np.uint64(k * 7919 + 1)
        r = sketches([np.sort(x ^ salt), np.sort(y ^ salt)])
        errors.append(likely_similarity(r[:1], r[1:], np.array([len(x)]), np.array([len(y)]))[0] - true)
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.12


def test_what_other_leaders_connect_meets_no_more(spark):
    """A group whose nodes are connected by links to several leaders is not paired again."""
    linked = [(0, k, k, 0.1, True) for k in range(2, 302)] + [(1, k, k, 0.1, True) for k in range(301, 602)]
    apart = [(0, k, k, 0.4, False) for k in range(302, 602)]
    lone = [(0, 700, 700, 0.5, False)]
    types = "leader long, node long, part long, distance double, linked boolean"
    for rows, most in ((linked + apart, 0), (linked + apart + lone, 700)):
        stars = spark.createDataFrame(rows, types)
        labels = spark.createDataFrame([(k, 0) for k in range(602)], "node long, label long")
        met = near_dedup._meetings(stars, labels)
        assert met.count() <= most
        assert {r.node for r in met.collect()} == (set(range(2, 602)) | {700} if most else set())


def near_copies(seed, n):
    """Copies of one text with up to 30 of 150 words changed, so that many are linked only by others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for doc_id in rng.sample(range(10_000), n):
        start, edits = rng.randrange(150), rng.randrange(31)
        copy = [f"v{rng.randrange(3000)}" if (k - start) % 150 < edits else w for k, w in enumerate(base)]
        rows.append((doc_id, " ".join(copy)))
    return rows


@pytest.mark.parametrize(("seed", "over"), [(3, 85), (4, 80)])
def test_large_group_of_near_copies_equals_brute_force(spark, seed, over):
    rows = near_copies(seed, 300)
    assert found(spark, rows, over) == brute(rows, over)


def test_what_meets_under_a_smaller_leader_meets_once(spark):
    """Unlinked nodes that several leaders share meet in the group of the least one only."""
    rows = [(leader, k, k, 0.4, False) for leader in (0, 1, 2) for k in range(3, 303)] + [(2, 400, 400, 0.4, False)]
    stars = spark.createDataFrame(rows, "leader long, node long, part long, distance double, linked boolean")
    met = near_dedup._meetings(stars, spark.createDataFrame([], "node long, label long")).collect()
    assert {r.node for r in met if r.leader == 0} == set(range(3, 303))
    assert not [r for r in met if r.leader == 1]
    across = [r for r in met if r.leader == 2 and r.kind == 1]
    assert {r.node for r in across if r.side == 0} == {400} and {r.node for r in across if r.side == 1} == set(range(3, 303))
    assert len(met) <= 3 * 303


def test_blocks_of_a_meeting_hold_few_shingles(spark):
    rows = [(0, k, k, 0.4, False, near_dedup.MEETING_SHINGLES // 8) for k in range(1, 41)]
    types = "leader long, node long, part long, distance double, linked boolean, n_shingles long"
    none = spark.createDataFrame([], "node long, label long")
    met = near_dedup._meetings(spark.createDataFrame(rows, types), none, "n_shingles").collect()
    held = {}
    for r in met:
        held.setdefault((r.kind, r.i, r.j, r.side), set()).add(r.node)
    assert len({r.side for r in met if r.kind == 0}) >= 4 and max(map(len, held.values())) <= 20
    together = {frozenset((a, b)) for r in held for t in held if r[:3] == t[:3] for a in held[r] for b in held[t] if a != b}
    assert len(together) == 40 * 39 // 2


@pytest.mark.parametrize("nodes", [7, 512])
def test_blocks_of_any_size_give_the_same_classes(spark, monkeypatch, nodes):
    monkeypatch.setattr(near_dedup, "MEETING_NODES", nodes)
    monkeypatch.setattr(near_dedup, "PAIRS_AT_ONCE", 50)
    rows = near_copies(5, 250)
    assert found(spark, rows, 80) == brute(rows, 80)
