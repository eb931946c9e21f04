from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from shop import CFG, by_key, days_ago, item, order, shop
from test_files import FILES

from tidemark.operators.deciles import decile_counts
from tidemark.operators.features import rfm_features, snapshot_features
from tidemark.plans.reports import customer_profile
from tidemark.sinks.writers import write_lookup_table
from tidemark.sources.positions import POSITION, with_position
from tidemark.sources.readers import load_tables
from tidemark.sources.rejects import RECORD, by_table, load_sound, require_sound


def written(folder, **changed):
    folder.mkdir()
    for name, text in (FILES | changed).items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_sound_files_give_the_tables_of_the_strict_reader(spark, tmp_path):
    root = written(tmp_path / "csv")
    intake, strict = load_sound(spark, root, str(tmp_path / "work")), load_tables(spark, root)
    for name in ("orders", "customers", "order_items", "payments", "reviews", "products", "sellers"):
        mine, theirs = getattr(intake.tables, name), getattr(strict, name)
        assert mine.schema == theirs.schema and mine.collect() == theirs.collect()
    assert intake.tables.category_translation is None and intake.rejected.count() == 0
    require_sound(intake.counts, 0.0)
    assert snapshot_features(intake.tables, CFG).collect() == snapshot_features(strict, CFG).collect()


def test_unsound_records_are_kept_as_they_stand(spark, tmp_path):
    payments = FILES["payments"] + "o1,2,boleto,1,seventy\no1,3\no1,4,boleto,1,2.5,more,still more\n"
    reviews = FILES["reviews"] + 'r2,o1,five,"two\nlines",2018-02-28 00:00:00,\n'
    root = written(tmp_path / "csv", payments=payments, reviews=reviews)
    intake = load_sound(spark, root, str(tmp_path / "work"))
    assert [r.payment_value for r in intake.tables.payments.collect()] == [72.19]
    assert intake.tables.reviews.count() == 1
    found = {(r.table_name, r.file.rsplit("/", 1)[1], r.record.strip()) for r in intake.rejected.collect()}
    assert found == {
        ("payments", "payments.csv", "o1,2,boleto,1,seventy"),
        ("payments", "payments.csv", "o1,3"),
        ("payments", "payments.csv", "o1,4,boleto,1,2.5,more,still more"),
        ("reviews", "reviews.csv", 'r2,o1,five,"two\nlines",2018-02-28 00:00:00,'),
    }
    counts = {r.table_name: r[1:] for r in by_table(intake.counts).collect()}
    assert counts["payments"] == (4, 1, 3) and counts["reviews"] == (2, 1, 1) and counts["orders"] == (2, 2, 0)
    require_sound(intake.counts, 0.75)
    with pytest.raises(ValueError, match="payments: 3 of 4$"):
        require_sound(intake.counts, 0.5)


def test_empty_files_and_clashing_names(spark, tmp_path):
    head = FILES["payments"].split("\n")[0] + "\n"
    intake = load_sound(spark, written(tmp_path / "a", payments=head), str(tmp_path / "wa"))
    assert intake.tables.payments.count() == 0 and "payments" not in by_key(by_table(intake.counts), "table_name")
    clash = written(tmp_path / "b", sellers=f"seller_id,{RECORD}\ns,x\n")
    with pytest.raises(ValueError, match=RECORD):
        load_sound(spark, clash, str(tmp_path / "wb"))


def test_positions_follow_files_and_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 7).selectExpr("id", "1000 - id AS other").write.parquet(path)
    placed = with_position(spark.read.parquet(path))
    assert placed.where(f"{POSITION} = id").count() == 1000
    some = with_position(spark.read.parquet(path)).where("other % 10 = 0")
    assert some.where(f"{POSITION} = id").count() == 100
    with pytest.raises(ValueError, match="already"):
        with_position(spark.read.parquet(path), "other")


def test_first_state_follows_the_input(spark):
    t = shop(
        spark,
        orders=[order("o1", "a", days_ago(3)), order("o2", "b", days_ago(9)), order("o3", "c", days_ago(9)), order("o4", "a", days_ago(-3))],
        customers=[("a", "u", "SP", "x"), ("b", "u", "RJ", None), ("c", "u", "MG", "z")],
        items=[item(f"o{k}") for k in (1, 2, 3, 4)],
    )
    place = {"o1": 5, "o2": 7, "o3": 6, "o4": 0}
    at = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    placed = replace(t, orders=t.orders.withColumn("nr", at[F.col("order_id")]))
    by_time = rfm_features(t, CFG).first()
    by_place = rfm_features(placed, replace(CFG, order_position="nr")).first()
    assert (by_time.customer_state, by_time.customer_city) == ("RJ", "z")
    assert (by_place.customer_state, by_place.customer_city) == ("SP", "x")
    full = snapshot_features(placed, replace(CFG, order_position="nr"), with_label=True).first()
    assert (full.customer_state, full.customer_city) == ("SP", "x")


def test_tied_deciles_follow_an_order(spark):
    rows = [(f"c{k}", 0.5 if k % 3 else 0.25, int(k % 7 > 0), 10_000 - 3 * k) for k in range(997)]
    df = spark.createDataFrame(rows, "customer_unique_id string, operational_score double, churn int, nr long")
    ranked = sorted(rows, key=lambda r: (-(1 - r[1]), r[3]))
    expected = {}
    for rank, (_, _, churn, _) in enumerate(ranked):
        decile = max(1, -(-rank * 10 // (len(rows) - 1)))
        customers, active = expected.get(decile, (0, 0))
        expected[decile] = (customers + 1, active + 1 - churn)
    found = decile_counts(df, tie_order="nr").collect()
    assert {r.decile_no: (r.customers, r.active_count) for r in found} == expected


def test_a_lookup_reads_about_one_row_group(spark, tmp_path):
    rows = spark.range(0, 400_000, 1, 4).selectExpr(
        "md5(string(id)) AS customer_unique_id", "'Low Risk' AS business_risk_tier", "0.1 + id AS operational_risk_score",
        "0.2 AS calibrated_churn_prob", "50.0 AS risk_percentile",
    )
    path = str(tmp_path / "scored")
    write_lookup_table(rows, path, "customer_unique_id", row_group_bytes=256 * 1024)
    wanted = rows.where("operational_risk_score = 4711.1").first().customer_unique_id
    profile = customer_profile(spark.read.parquet(path), wanted)
    assert len(profile.collect()) == 1

    def rows_scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    profile = customer_profile(spark.read.parquet(path), wanted)
    assert 1 <= rows_scanned(profile) <= 20_000
    absent = customer_profile(spark.read.parquet(path), "7" * 32)
    assert rows_scanned(absent) <= 20_000
