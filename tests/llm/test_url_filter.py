from datetime import datetime as D

from tidemark.llm.url_filter import judge_captures, url_keys, validity_intervals
from pyspark.sql import functions as F

ENTRY = "key string, action string, effective timestamp_ntz"
CAPTURE = "capture_id long, url string, fetched timestamp_ntz, verdict string"


def judge(spark, captures, entries):
    found = judge_captures(spark.createDataFrame(captures, CAPTURE), spark.createDataFrame(entries, ENTRY))
    return sorted((str(r.capture_id), r.verdict, r.matched_key, r.n_active) for r in found.collect())


def test_keys_of_urls(spark):
    urls = ["https://u@M.a.Example.com:80/en/1?q", "http://x.org", "http://10.0.0.1/p", "rel/path", None, "http://"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(url_keys(F.col("url")).alias("k"))
    assert [[k["key"] for k in r.k] for r in df.collect()] == [
        ["m.a.example.com", "a.example.com", "example.com", "m.a.example.com/en"], ["x.org"], ["10.0.0.1", "10.0.0.1/p"], [], [], []]


def test_entries_hold_from_their_date_to_the_next_change(spark):
    log = [("a.com", "block", D(2024, 1, 1)), ("a.com", "remove", D(2024, 3, 1)), ("a.com", "allow", D(2024, 5, 1)),
           ("b.com", "allow", D(2024, 1, 1)), ("b.com", "block", D(2024, 1, 1)), (None, "block", D(2024, 1, 1)), ("c.com", None, D(2024, 1, 1)), ("c.com", "block", None)]
    got = validity_intervals(spark.createDataFrame(log, ENTRY)).collect()
    assert sorted((r.key, r.action, r.valid_from.month, r.valid_to and r.valid_to.month) for r in got) == [
        ("a.com", "allow", 5, None), ("a.com", "block", 1, 3), ("b.com", "block", 1, None)]


def test_captures_meet_the_entries_of_their_time_the_most_specific_first(spark):
    log = [("a.com", "block", D(2024, 1, 1)), ("a.com", "remove", D(2024, 3, 1)), ("x.a.com", "allow", D(2024, 2, 1)), ("a.com/p", "block", D(2024, 1, 1))]
    captures = [(1, "http://a.com/q", D(2024, 1, 1), "z"), (2, "http://a.com/q", D(2024, 3, 1), "z"), (3, "http://x.a.com/", D(2024, 2, 2), "z"),
                (4, "http://x.a.com/", D(2024, 1, 2), "z"), (5, "http://a.com/p/1", D(2025, 1, 1), "z"), (6, "http://a.com/", D(2023, 1, 1), "z"),
                (7, None, D(2024, 1, 5), "z"), (8, "http://a.com/", None, "z"), (None, "http://b.org", D(2024, 1, 1), None)]
    assert judge(spark, captures, log) == [
        ("1", "block", "a.com", 1), ("2", "keep", None, 0), ("3", "allow", "x.a.com", 2), ("4", "block", "a.com", 1), ("5", "block", "a.com/p", 1),
        ("6", "keep", None, 0), ("7", "keep", None, 0), ("8", "keep", None, 0), ("None", "keep", None, 0)]


def test_repeats_stay_and_empty_inputs_are_defined(spark):
    log = [("a.com", "block", D(2024, 1, 1)), ("x.a.com", "block", D(2024, 1, 1))]
    twice = [(1, "http://x.a.com/", D(2024, 1, 2), "z")] * 3
    assert judge(spark, twice, log) == [("1", "block", "x.a.com", 2)] * 3
    assert judge(spark, twice, []) == [("1", "keep", None, 0)] * 3
    assert judge(spark, [], log) == []
