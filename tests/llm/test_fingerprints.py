import hashlib
import math
import random
import re

import xxhash

from tidemark.llm import fingerprints as fp
from tidemark.llm.common import work_folder

SCHEMA = "doc_id long, text string, fingerprint string, k string"


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def hashed(term):
    return signed(xxhash.xxh64_intdigest(term.encode(), seed=42))


def hash_list(values):
    seed = 42
    for value in values:
        seed = xxhash.xxh64_intdigest((value & (2**64 - 1)).to_bytes(8, "little"), seed=seed)
    return seed


def terms(text):
    return {hashed(t) for t in re.findall(r"[^\W_]+", (text or "").lower())}


def lexicon(texts):
    df = {}
    for t in texts:
        for slot in {h & (2**fp.SLOT_BITS - 1) for h in terms(t)}:
            df[slot] = df.get(slot, 0) + 1
    return {s for s, n in df.items() if fp.MIN_IDF <= math.log(len(texts) / n) <= fp.MAX_IDF}


def fingerprint(text, kept):
    own = sorted(h for h in terms(text) if h & (2**fp.SLOT_BITS - 1) in kept)
    scale = int(math.floor(math.log2(max(len(own) / fp.SUBSETS, 1))))
    out = [str(scale)]
    for step in (0, 1):
        period = fp.SUBSETS << (scale + step)
        groups = ([h for h in own if (h >> fp.SLOT_BITS) % period == j] for j in range(fp.SUBSETS))
        out.append("".join(f"{hash_list(g) & 0xFFFF:04x}" if g else "----" for g in groups))
    return ":".join(out)


def likeness(a, b):
    if a == b:
        return 1.0
    (s, *x), (t, *y) = a.split(":"), b.split(":")
    shared = [(x[int(t) + i - int(s)], y[i]) for i in (0, 1) if 0 <= int(t) + i - int(s) <= 1]
    pairs = [(u[i : i + 4], v[i : i + 4]) for u, v in shared for i in range(0, len(u), 4)]
    filled = [(u, v) for u, v in pairs if (u, v) != ("----", "----")]
    return sum(u == v for u, v in filled) / len(filled) if filled else 0.0


def texts_of(n, seed):
    rng = random.Random(seed)
    words = [f"term{i}" for i in range(400)] + ["É", "der", "x_y"]
    return [" ".join(rng.choices(words, k=rng.choice((0, 1, 5, 40, 200)))) for _ in range(n)]


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "f", "k") for i, t in rows], SCHEMA)
    return fp.edited_fingerprints(docs, work_folder(spark)).collect()


def test_equals_brute_force(spark):
    rows = list(zip(random.Random(1).sample(range(1000), 90), texts_of(90, 2)))
    rows += [(5000, None), (5001, "one " * 30_000), (5002, rows[0][1])]
    ordered = sorted(rows)
    kept = lexicon([t for _, t in rows])
    got = {r.doc_id: r for r in run(spark, rows)}
    assert len(got) == len(rows)
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        text, following = text or "", following or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = got[i]
        own, other = fingerprint(text, kept), fingerprint(edited, kept)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own, other)
        assert math.isclose(r.near_edited, likeness(own, other)) and math.isclose(r.near_next, likeness(own, fingerprint(following, kept)))


def test_repeated_rows_null_ids_and_small_tables(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "x y z"), (None, "n o"), (2, "other words")]
    got = run(spark, rows)
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "2", "None"]
    assert len({(r.edited_sha256, r.fingerprint) for r in got if r.doc_id == 1}) == 1
    (alone,) = run(spark, [(4, "abcdefgh")])
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1.0
    assert run(spark, []) == []


def test_edits_stay_nearer_than_other_documents(spark):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(20_000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice((60, 300, 1500))))) for i in range(150)]
    got = run(spark, rows)
    assert sum(r.near_edited for r in got) / 150 > 0.3 and max(r.near_next for r in got) < 0.15
    assert sum(r.near_edited > r.near_next for r in got) >= 148


def run_as_the_query(spark, rows):
    docs = spark.createDataFrame([(i, t, "f", "k") for i, t in rows], SCHEMA)
    return {r.doc_id: r for r in fp.edited_fingerprints(docs, work_folder(spark), fp.FEW_TERMS).collect()}


def test_copy_groups_of_over_a_twentieth_of_the_rows_stay_apart(spark):
    one = " ".join(f"first{i}" for i in range(60))
    two = " ".join(f"second{i}" for i in range(60))
    rows = [(i, one) for i in range(10)] + [(10 + i, two) for i in range(10)]
    rows += [(100 + i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(80)]
    got = run_as_the_query(spark, rows)
    assert got[0].near_next == got[10].near_next == 1.0 and got[0].fingerprint == got[9].fingerprint
    assert got[9].near_next == got[19].near_next == 0.0
    # Three quarters stay; what comes in are the terms of the lexicon that follow.
    assert 0.2 < got[19].near_edited < 1 and 0.2 < got[9].near_edited < 1
    assert got[19].fingerprint.count(":") == 3 and got[19].edited_fingerprint.count(":") == 2


def test_small_tables_and_texts_without_terms_have_likeness_one_only_for_equal_terms(spark):
    got = run_as_the_query(spark, [(1, "a b c"), (2, "d e f"), (3, "f  E d"), (4, "!!!"), (5, "???"), (6, None), (7, "")])
    assert [got[i].near_next for i in (1, 2, 3, 4, 5, 6, 7)] == [0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    long = " ".join(f"t{i}" for i in range(4000))
    got = run_as_the_query(spark, [(1, long), (2, long + " more")])
    assert 0.9 < got[1].near_next < 1


def test_texts_with_enough_lexicon_terms_are_printed_alike_by_the_query(spark):
    rows = list(enumerate(texts_of(90, 2)))
    kept = lexicon([t for _, t in rows])
    many = [i for i, t in rows if sum(h & (2**fp.SLOT_BITS - 1) in kept for h in terms(t)) >= fp.FEW_TERMS]
    got = run_as_the_query(spark, rows)
    assert len(many) > 3 and all(got[i].fingerprint == fingerprint(rows[i][1], kept) for i in many)
