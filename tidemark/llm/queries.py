"""The queries of the operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    fingerprints,
    html_text,
    lexical_search,
    metric_tree,
    mixing,
    near_dedup,
    packed_ids,
    pieces,
    pii,
    quality,
    url_filter,
    warc,
    whitening,
)
from tidemark.llm.common import read_table, text_of, tokenizer_file, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op1_source_mix"] = """
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':1') AS k
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(list_extract([5, 2, 1], (rank - 1) % 3 + 1) AS BIGINT) AS w, 3 * source_size AS cap
  FROM ranked),
levels AS (
  SELECT *,
    CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gone,
    CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), rank
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
  FROM weighed),
stops AS (SELECT *, (total - gone) * w > cap * rest AS stop FROM levels),
shares AS (
  SELECT *,
    CAST(sum(CASE WHEN stop THEN cap ELSE 0 END) OVER () AS BIGINT) AS stopped,
    CAST(sum(CASE WHEN stop THEN 0 ELSE w END) OVER () AS BIGINT) AS open
  FROM stops),
budgets AS (
  SELECT source, source_size,
    CASE WHEN stop THEN CAST(cap AS DOUBLE)
         ELSE CAST((total - stopped) * w AS DOUBLE) / CAST(open AS DOUBLE) END AS target
  FROM shares),
placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target,
    CASE WHEN b.source_size > 0 THEN CAST(floor(b.target / b.source_size) AS BIGINT) ELSE 0 END AS epochs,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size,
    CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM placed
"""


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", html_text.extract_text("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return fingerprints.edited_fingerprints(docs, work_folder(spark), fingerprints.FEW_TERMS)


@query
def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = pieces.encode_digests(text_of("text"), tokenizer_file("piece_bpe_32k.model"))
    return read_table(spark, sf_dir, "documents").select("doc_id", digests.alias("_found")).select("doc_id", "_found.*")


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return near_dedup.near_duplicates(docs, near_dedup.Threshold(85, 100))


ORACLE_SQL["op5_near_duplicates"] = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM both_ways
  UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
  least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(m.low, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) m USING (doc_id)
"""


@query
def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = metric_tree.scaled_vectors(read_table(spark, sf_dir, "embeddings"))
    queries = vectors.where("vec_id % 100 = 0")
    return metric_tree.top_k(vectors, queries, work_folder(spark), k=10)


ORACLE_SQL["op6_top_products"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = packed_ids.byte_bpe_encoder(tokenizer_file("byte_bpe_50k.json"))
    folder = f"{work_folder(spark)}/shards"
    docs = read_table(spark, sf_dir, "documents")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = packed_ids.write_shards(docs, folder, encode, end_id=0, vocabulary=50_257, shards=shards)
    return packed_ids.read_documents(manifest, folder)


@query
def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.held_out(F.col("doc_id"))
    model = quality.fit_quality(docs.where(~held_out), read_table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        quality.quality_score(docs, model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = docs.select("doc_id", pii.pii_spans().alias("_found"))
    counts = [
        F.expr(f"CAST(size(filter(_found, s -> s.kind = '{kind}')) AS BIGINT) AS n_{kind}")
        for kind in pii.BASE_KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.spans_text(pii.base_spans(F.col("_found"))), 256).alias("base_sha256"),
        pii.spans_text(F.col("_found")).alias("spans"),
    )


FETCH_BASE = "2024-01-01 00:00:00"
YEAR_SECONDS = 365 * 24 * 3600


def _hex(digest: str, start: int, digits: int) -> F.Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures; the fetch time, which the table lacks, follows from the id's hash."""
    base = F.expr(f"timestamp_ntz'{FETCH_BASE}'")
    digest = pages.select(
        F.col("page_id").alias("capture_id"),
        "url",
        F.md5(F.concat(F.lit("fetch"), F.col("page_id").cast("string"))).alias("_digest"),
    )
    seconds = _hex("_digest", 1, 7) % YEAR_SECONDS
    return digest.select("capture_id", "url", (base + F.make_dt_interval(secs=seconds)).alias("fetched"))


def page_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, domains and path prefixes that occur in pages.

    Half of the keys, by hash, are listed; each has three changes at hashed dates.
    """
    keys = pages.select(F.explode(url_filter.url_keys(F.col("url")))).select("col.key").distinct()
    hashed = keys.select("key", F.md5("key").alias("_digest")).where("substring(_digest, 1, 1) < '8'")
    actions = F.array(*[F.lit(a) for a in ("block", "allow", "remove", "block")])
    change = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("_i")
    row = hashed.select("key", "_digest", change)
    days = F.conv(F.expr("substring(_digest, 2 + 4 * _i, 4)"), 16, 10).cast("int") % 365
    pick = F.conv(F.expr("substring(_digest, 20 + _i, 1)"), 16, 10).cast("int") % 4 + 1
    base = F.expr(f"timestamp_ntz'{FETCH_BASE}'")
    return row.select(
        "key", F.element_at(actions, pick).alias("action"), (base + F.make_dt_interval(days=days)).alias("effective")
    )


@query
def op10_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_captures(page_captures(pages), page_list(pages))
    return judged.withColumnRenamed("capture_id", "page_id")


ORACLE_SQL["op10_url_verdicts"] = """
WITH captures AS (
  SELECT page_id, url,
    TIMESTAMP '2024-01-01 00:00:00'
      + to_seconds(CAST('0x' || substr(md5('fetch' || CAST(page_id AS VARCHAR)), 1, 7) AS BIGINT) % 31536000) AS fetched,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS segment
  FROM pages),
numbered AS (SELECT *, row_number() OVER () AS n FROM captures),
labels_of AS (SELECT *, string_split(host, '.') AS parts FROM numbered WHERE host IS NOT NULL),
domains AS (
  SELECT n, fetched, unnest(range(1,
    1 + CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN 1 ELSE greatest(len(parts) - 1, 1) END)) AS first, parts
  FROM labels_of),
keys AS (
  SELECT n, fetched, len(parts) - first + 1 AS rank, array_to_string(parts[first:], '.') AS key FROM domains
  UNION ALL
  SELECT n, fetched, 1000, host || '/' || segment FROM labels_of WHERE segment <> ''),
listed AS (
  SELECT key, md5(key) AS d, unnest([0, 1, 2]) AS i
  FROM (SELECT DISTINCT key FROM keys) WHERE substr(md5(key), 1, 1) < '8'),
changes AS (
  SELECT key,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(CAST('0x' || substr(d, 2 + 4 * i, 4) AS BIGINT) % 365 AS INTEGER)) AS effective,
    max(list_extract(['block', 'allow', 'remove', 'block'], CAST('0x' || substr(d, 20 + i, 1) AS BIGINT) % 4 + 1)) AS action
  FROM listed GROUP BY ALL),
intervals AS (
  SELECT key, action, effective AS valid_from,
    lead(effective) OVER (PARTITION BY key ORDER BY effective) AS valid_to
  FROM changes),
hits AS (
  SELECT n, rank, k.key, action, valid_from
  FROM keys k JOIN intervals i ON k.key = i.key AND fetched >= valid_from
    AND (valid_to IS NULL OR fetched < valid_to)
  WHERE action <> 'remove'),
best AS (
  SELECT n, count(*) AS met, max_by(struct_pack(key := key, action := action, since := valid_from), rank) AS top
  FROM hits GROUP BY n)
SELECT page_id, url, fetched, host, coalesce(top.action, 'keep') AS verdict, top.key AS matched_key,
  top.since AS listed_since, CAST(coalesce(met, 0) AS BIGINT) AS n_active
FROM numbered LEFT JOIN best USING (n)
"""


@query
def op11_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_folder(spark)}/packages"
    manifest = warc.write_packages(read_table(spark, sf_dir, "pages"), folder)
    records = warc.read_packages(manifest, folder, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op11_warc_records"] = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
lasts AS (SELECT payload, max(page_id) AS last FROM hashed GROUP BY payload)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
    ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31)
    AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM hashed JOIN lasts USING (payload)
"""


@query
def op12_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.whole_vectors(read_table(spark, sf_dir, "embeddings"))
    return whitening.whiten(vectors, work_folder(spark))


@query
def op13_ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(read_table(spark, sf_dir, "documents"), work_folder(spark))
    return lexical_search.search(index, read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op13_ranked_documents"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
held AS (SELECT * FROM words WHERE len(w) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM held),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
counted AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM held)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals),
lengths AS (SELECT d, doc_id, 25 + ((75 * len(w) * n_docs) // n_terms) AS m FROM held, totals),
scored AS (
  SELECT item_id, d, doc_id,
    CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN lengths USING (d)
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
