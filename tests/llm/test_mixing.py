import hashlib
import random
import re

from tidemark.llm.mixing import MAX_REPEAT, WEIGHTS, mix, mix_plan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def targets(sizes):
    """Shares by weight; a source at its limit leaves the rest to the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: WEIGHTS[k % len(WEIGHTS)] for k, s in enumerate(order)}
    total, out = sum(sizes.values()), {}
    open_ = set(order)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > MAX_REPEAT * sizes[s]}
        if not above:
            return out | share
        out |= {s: MAX_REPEAT * sizes[s] for s in above}
        open_ -= above
    return out


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sources = {r[3] for r in rows}
    sums = {s: sum(n for r, n in zip(rows, size) if r[3] == s) for s in sources}
    budget = targets(sums)
    key = lambda k: (hashlib.md5(f"{rows[k][0] if rows[k][0] is not None else ''}:1".encode()).hexdigest(), rows[k][0] or 0, size[k])
    taken = [0] * len(rows)
    for s in sources:
        epochs = int(budget[s] // sums[s]) if sums[s] else 0
        rest = int(budget[s]) - epochs * sums[s]
        for k in sorted((k for k in range(len(rows)) if rows[k][3] == s), key=key):
            extra = max(0, min(size[k], rest))
            rest -= extra
            taken[k] = epochs * size[k] + extra
    return sorted((str(r[0]), n, sums[r[3]], round(budget[r[3]], 6), t) for r, n, t in zip(rows, size, taken))


def rows_of(n, seed):
    random.seed(seed)
    found = [(i, words(random.randint(0, 40)), "en", random.choice("aaaabcde"), 0) for i in range(n)]
    return [*found, (n, None, None, None, None), (n + 1, "\x0b x y ", None, None, 0), (None, "a b", "en", "a", 0), found[0], found[0]]


def test_plan_equals_brute_force_with_nulls_and_repeated_rows(spark):
    for seed in (1, 2):
        rows = rows_of(120, seed)
        got = mix_plan(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == brute(rows)


def test_a_source_with_most_rows_and_one_long_text(spark):
    rows = [(i, words(3), "en", "hot" if i % 3 else "cold", 0) for i in range(300)] + [(999, words(5000), "en", "cold", 0)]
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in mix_plan(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_whole_documents_are_repeated_up_to_the_budget(spark):
    rows = rows_of(60, 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = {}
    for r in mix_plan(docs).collect():
        plan.setdefault(r.doc_id, []).append(1 if r.size == 0 else r.copies)
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {k: sum(v) for k, v in plan.items() if sum(v)}
    assert all(n <= MAX_REPEAT for v in plan.values() for n in v)


def test_clashing_columns_pass_through_and_reruns_agree(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, 8, "x"), (2, "c", "s", 9, 10, "y")], "doc_id long, text string, source string, taken int, _cell int, _row string")
    once, again = mix(docs), mix(docs)
    assert once.columns == docs.columns and sorted(once.collect()) == sorted(again.collect())
    assert once.count() == 2


def test_empty_tables_and_sources_without_words(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mix_plan(none).count() == 0 and mix(none).count() == 0
    blank = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", "b", 0)], SCHEMA)
    assert {(r.target, r.taken) for r in mix_plan(blank).collect()} == {(0.0, 0)}
    assert mix(blank).count() == 2
