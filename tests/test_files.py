from datetime import datetime

import pytest

from tidemark import SnapshotConfig
from tidemark.operators.features import snapshot_features
from tidemark.sinks.writers import (
    write_high_risk_csv,
    write_metrics_document,
    write_metrics_table,
    write_table,
)
from tidemark.sources.readers import (
    load_tables,
    path_exists,
    read_high_risk_csv,
    read_metrics,
    read_optional,
    read_scored,
    read_table,
)

CFG = SnapshotConfig()

FILES = {
    # Columns in another order than declared, and one the package does not know.
    "orders": "customer_id,order_id,extra,order_status,order_purchase_timestamp,order_approved_at,"
    "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
    "c1,o1,x,delivered,2018-02-27 23:59:59,,,2018-02-28 12:00:00,2018-02-28 00:00:00\n"
    "c2,o2,y,,2018-02-28 23:59:59,,,,\n",
    "customers": "customer_id,customer_unique_id,customer_zip,customer_city,customer_state\n"
    'c1,u1,01234,"sao paulo, sp",SP\nc2,u2,1,,\n',
    "order_items": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
    "o1,1,p1,s,2018-03-01 00:00:00,58.90,13.29\n",
    "payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
    "o1,1,credit_card,8,72.19\n",
    "reviews": "review_id,order_id,review_score,review_comment,review_creation_date,review_answer_timestamp\n"
    'r1,o1,4,"first line\nsaid ""ok"", fine",2018-02-28 00:00:00,2018-03-02 00:00:00\n',
    "products": "product_id,category\np1,toys\n",
    "sellers": "seller_id,city\ns,x\n",
}


@pytest.fixture
def csv_root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def test_csv_tables_to_features(spark, csv_root):
    t = load_tables(spark, csv_root)
    assert t.category_translation is None
    assert dict(t.orders.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert dict(t.orders.dtypes)["extra"] == "string"
    assert t.orders.where("order_status IS NULL").count() == 1
    assert t.reviews.count() == 1
    assert t.reviews.first().review_comment == 'first line\nsaid "ok", fine'
    assert t.products.columns == ["product_id", "category"] and t.sellers.count() == 1
    (r,) = snapshot_features(t, CFG).collect()
    assert (r.customer_unique_id, r.customer_state, r.customer_city) == ("u1", "SP", "sao paulo, sp")
    assert (r.recency_days, r.total_spend, r.total_freight) == (1.0, 58.9, 13.29)
    assert (r.avg_review_score, r.avg_delivery_delay_days) == (4.0, 0.5)


def test_optional_table_and_other_names(spark, csv_root, tmp_path):
    (tmp_path / "translation_v2.csv").write_text("name,english\nbrinquedos,toys\n")
    t = load_tables(spark, csv_root, files={"category_translation": "translation_v2.csv"})
    assert t.category_translation.first().english == "toys"
    assert read_optional(spark, "products", f"{csv_root}/absent.csv") is None
    assert path_exists(spark, f"{csv_root}/orders.csv")


def test_missing_column_is_named(spark, tmp_path):
    (tmp_path / "payments.csv").write_text("order_id,payment_type\no1,boleto\n")
    with pytest.raises(ValueError, match="payment_installments"):
        read_table(spark, "payments", str(tmp_path / "payments.csv"))


def test_bad_value_fails_instead_of_vanishing(spark, tmp_path):
    text = FILES["payments"].replace("72.19", "seventy")
    (tmp_path / "payments.csv").write_text(text)
    frame = read_table(spark, "payments", str(tmp_path / "payments.csv"))
    with pytest.raises(Exception, match="seventy|MALFORMED"):
        frame.select("payment_value").collect()


def test_parquet_tables_lose_their_time_zone(spark, tmp_path):
    rows = [("o1", 5, datetime(2018, 2, 1), None)]
    schema = (
        "order_id string, review_score int, review_creation_date timestamp,"
        " review_answer_timestamp timestamp"
    )
    path = str(tmp_path / "reviews.parquet")
    spark.createDataFrame(rows, schema).write.parquet(path)
    frame = read_table(spark, "reviews", path, "parquet")
    assert dict(frame.dtypes)["review_creation_date"] == "timestamp_ntz"
    assert frame.first().review_creation_date == datetime(2018, 2, 1)


def test_result_files_round_trip(spark, tmp_path):
    rows = [("b", 0.9, "High Risk"), ("a", 0.95, "High Risk"), ("c", 0.9, "High Risk")]
    df = spark.createDataFrame(rows, "customer_unique_id string, operational_risk_score double, business_risk_tier string")
    write_table(df, str(tmp_path / "scored"))
    assert sorted(read_scored(spark, str(tmp_path / "scored")).collect()) == sorted(df.collect())
    ordered = df.orderBy(df.operational_risk_score.desc(), "customer_unique_id")
    write_high_risk_csv(ordered, str(tmp_path / "high"), single_file=True)
    back = read_high_risk_csv(spark, str(tmp_path / "high"), df)
    assert back.collect() == ordered.collect()
    write_metrics_document(spark, {"a": {"b": [1.5, 2]}}, str(tmp_path / "doc"))
    assert read_metrics(spark, str(tmp_path / "doc")) == {"a": {"b": [1.5, 2]}}
    tidy = spark.createDataFrame([("s", "m", 0.25)], "section string, metric string, value double")
    write_metrics_table(tidy, str(tmp_path / "tidy"))
    assert spark.read.json(str(tmp_path / "tidy")).first().value == 0.25
