"""Judge every capture by the list entries active when it was fetched.

A list is a log of dated changes: from ``effective`` on, ``key`` has ``action``
("block", "allow" or "remove"). Each change holds until the next one of its key,
so the log becomes validity intervals. A capture is looked up under each of its
keys: its host, every parent domain of two labels or more, and the host with the
first path segment. The as-of join keeps the interval that holds at fetch time;
the most specific active entry decides.

Only narrow rows move (no page content). Intervals of a key do not overlap, so a
capture meets at most one per key, and both sides sit directly on their shuffle:
adaptive execution splits a host with a third of all captures.

Defined results: a null, relative or malformed url has no keys and is kept; a
capture without fetch time meets no entry; entries with a null key, time or action
are void; of several changes of one key at one instant the greatest action stands;
captures that repeat are repeated in the result; an empty list keeps everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def url_host(url: Column) -> Column:
    """Lower-case host without user and port; null if the url has none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def url_keys(url: Column) -> Column:
    """Keys of a url as (rank, key); a higher rank is more specific."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.when(host.rlike(r"^[0-9.]+$"), 1).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))),
        lambda first: F.struct(
            (F.size(labels) - first + 1).alias("rank"),
            F.array_join(F.slice(labels, first, F.size(labels)), ".").alias("key"),
        ),
    )
    segment = F.regexp_extract(url, SEGMENT, 1)
    path = F.when(
        segment != "",
        F.array(F.struct(F.lit(1000).alias("rank"), F.concat_ws("/", host, segment).alias("key"))),
    )
    none = F.array().cast("array<struct<rank:int,key:string>>")
    return F.when(host.isNull(), none).otherwise(F.concat(domains, F.coalesce(path, none)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, action, effective) as (key, action, valid_from, valid_to); removals end an interval."""
    log = (
        entries.where("key IS NOT NULL AND action IS NOT NULL AND effective IS NOT NULL")
        .groupBy("key", "effective")
        .agg(F.max("action").alias("action"))
    )
    following = F.lead("effective").over(Window.partitionBy("key").orderBy("effective"))
    return (
        log.select("key", "action", F.col("effective").alias("valid_from"), following.alias("valid_to"))
        .where("action <> 'remove'")
    )


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (capture_id, url, fetched): verdict and the entry that decides.

    Columns: capture_id, url, fetched, host, verdict ("block", "allow" or "keep"),
    matched_key, listed_since, n_active (entries active for any of its keys).
    """
    capture = captures.select("capture_id", "url", "fetched")
    keyed = capture.select("*", F.explode(url_keys(F.col("url"))).alias("_k"))
    active = validity_intervals(entries).withColumnRenamed("key", "_listed")
    hits = keyed.join(
        active,
        (F.col("_k.key") == F.col("_listed"))
        & (F.col("fetched") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))),
    ).select(
        *capture.columns,
        F.struct("_k.rank", "_k.key", "action", F.col("valid_from").alias("since")).alias("_hit"),
    )
    judged = (
        capture.unionByName(hits, allowMissingColumns=True)
        .groupBy("capture_id", "url", "fetched")
        .agg(
            F.count(F.when(F.col("_hit").isNull(), 1)).alias("_copies"),
            F.count("_hit").alias("_met"),
            F.max("_hit").alias("_hit"),
        )
    )
    return judged.select(
        "capture_id",
        "url",
        "fetched",
        url_host(F.col("url")).alias("host"),
        F.coalesce("_hit.action", F.lit("keep")).alias("verdict"),
        F.col("_hit.key").alias("matched_key"),
        F.col("_hit.since").alias("listed_since"),
        (F.col("_met") / F.col("_copies")).cast("long").alias("n_active"),
        F.explode(F.expr("array_repeat(0, CAST(_copies AS INT))")).alias("_copy"),
    ).drop("_copy")
