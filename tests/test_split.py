from hashlib import md5

import pytest

from tidemark.config import SnapshotConfig
from tidemark.operators.split import class_quotas, stratified_split

CFG = SnapshotConfig()


@pytest.mark.parametrize(
    "sizes, quotas",
    [
        # The published cohort and its hold-out.
        ({0: 653, 1: 54872}, {0: 131, 1: 10974}),
        ({0: 64, 1: 207}, {0: 13, 1: 42}),
        ({0: 1, 1: 4}, {0: 0, 1: 1}),
        ({1: 7}, {1: 2}),
    ],
)
def test_quotas(spark, sizes, quotas):
    df = None
    for label, n in sizes.items():
        part = spark.range(n).selectExpr(f"{label} AS churn")
        df = part if df is None else df.union(part)
    got = {r.churn: (r.n, r.n_test) for r in class_quotas(df, CFG).collect()}
    assert got == {c: (sizes[c], quotas[c]) for c in sizes}


def test_split_takes_the_smallest_hashes_of_each_class(spark):
    rows = [(f"id{i}", int(i % 7 != 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "customer_unique_id string, churn int").cache()
    got = stratified_split(df, df, CFG).collect()
    assert len(got) == len(rows)
    for label in (0, 1):
        members = [r for r in got if r.churn == label]
        ranked = sorted(members, key=lambda r: md5(f"{r.customer_unique_id}42".encode()).hexdigest())
        n_test = sum(r.is_test for r in members)
        assert [r.is_test for r in ranked] == [True] * n_test + [False] * (len(members) - n_test)
    assert sum(r.is_test for r in got) == 180
    again = stratified_split(df.repartition(9), df.repartition(3), CFG).collect()
    assert sorted(again) == sorted(got)
    df.unpersist()
