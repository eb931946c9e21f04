import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.prefix import (
    exact_median,
    in_cells,
    ordered_prefix,
    previous_fields,
)

RNG = np.random.default_rng(7)
CASES = {
    "even": RNG.random(3000),
    "crowded": 0.9882 + RNG.normal(0, 1e-4, 3000),
    "ties": np.round(RNG.random(3000), 2),
    "out_of_range": RNG.normal(0, 3, 500),
    "neighbours": np.nextafter(0.5, 1.0) + np.arange(200) * 1e-16,
    "edges": np.array([0.0, 1.0, 0.5]),
    "infinite": np.array([np.inf, -np.inf, 0.0, 1e308, -1e308, 3.0, 3.0]),
    "one_value": np.array([2.5, 2.5]),
}


@pytest.mark.parametrize("name", CASES)
def test_prefix_and_previous_match_a_sort(spark, name):
    values = pd.Series(CASES[name]).value_counts().rename_axis("v").reset_index(name="n")
    expected = values.sort_values("v")
    before = expected["n"].cumsum() - expected["n"]
    previous = expected["n"].shift()
    groups = spark.createDataFrame(values, "v double, n long")
    got = ordered_prefix(groups, "v", ["n"]).orderBy("v").toPandas()
    assert got["n_before"].tolist() == before.tolist()
    assert set(got["n_total"]) == {len(CASES[name])}
    back = previous_fields(in_cells(groups, "v"), "v", ["n"]).orderBy("v").toPandas()
    assert back["previous_n"].fillna(-1).tolist() == previous.fillna(-1).tolist()


def test_orders_side_by_side(spark):
    rows = [("a", 0.1, 1), ("a", 0.7, 2), ("b", 0.1, 5), ("b", 0.05, 7)]
    groups = spark.createDataFrame(rows, "k string, v double, n long")
    got = {(r.k, r.v): (r.n_before, r.n_total) for r in ordered_prefix(groups, "v", ["n"], ["k"]).collect()}
    assert got == {("a", 0.1): (0, 3), ("a", 0.7): (1, 3), ("b", 0.05): (0, 12), ("b", 0.1): (7, 12)}


WIDE = {
    "narrow": 0.5 + np.unique(RNG.integers(-900_000, 900_000, 100_000)) * 1.2e-16,
    "thousands": np.unique(RNG.random(100_000) * 1000),
    "two_far_heaps": np.concatenate([RNG.random(50_000) * 1e-6, 1e9 + RNG.random(50_000)]),
}


@pytest.mark.parametrize("name", WIDE)
def test_any_range_fills_all_partitions(spark, conf, name):
    conf({"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"})
    values = np.unique(WIDE[name])
    groups = spark.createDataFrame(pd.DataFrame({"v": values, "n": 1}))
    placed = in_cells(groups, "v")
    sizes = placed.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) == 16 and sizes.max() < 2 * len(values) / 16
    assert placed.groupBy("_cell").count().agg(F.max("count")).first()[0] < len(values) / 50
    wrong = ordered_prefix(groups, "v", ["n"]).select(F.row_number().over(Window.orderBy("v")).alias("k"), "n_before")
    assert wrong.where("k <> n_before + 1").count() == 0


def test_every_order_has_its_own_cells(spark):
    rows = [("low", float(v) * 1e-9) for v in range(2000)] + [("high", float(v) * 1e6) for v in range(2000)] + [(None, 1.0)]
    placed = in_cells(spark.createDataFrame(rows, "k string, v double"), "v", ["k"])
    cells = {r.k: r.n for r in placed.groupBy("k").agg(F.count_distinct("_cell").alias("n")).collect()}
    assert cells["low"] > 1000 and cells["high"] > 1000 and cells[None] == 1


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, 1.0], [2.0, None, 4.0, 4.0, 1.0]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_median(df, "v").first()[0] == pd.Series(values).median()


def test_median_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_median(df, "v").first()[0] is None
    assert exact_median(df.where(F.lit(False)), "v").first()[0] is None
