import base64
import gzip
import hashlib
import io
import random
import zipfile

import pyarrow as pa
import pyarrow.fs
import pytest

from tidemark.llm import warc
from tidemark.llm.common import work_folder


def source_of(data):
    return pa.PythonFile(io.BytesIO(data), "r")


def expected(rows, min_bytes=0):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        last = max(same, default=None)
        revisit = len(data) >= min_bytes and last is not None and page_id != last
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


def rows_of(seed=1, n=300):
    rng = random.Random(seed)
    texts = ["", None, "same page", "ä日\r\n\r\nWARC/1.1\r\n", "x" * 300_000] + [f"<p>{rng.random()}</p>" * rng.randint(1, 50) for _ in range(100)]
    rows = [(k * 3 - 50, rng.choice([None, "http://a.b/c d\r\nWARC-Type: evil", f"https://x.y/{k}"]), rng.choice(texts)) for k in range(n)]
    rows += [(10_000 + k, "http://copy", "hot page") for k in range(200)]
    return rows + [(None, None, None), (None, "u", "only without id"), (None, "v", "only without id"), (999_999, "w", "repeated"), (999_999, "w", "repeated"), (None, "u", "same page")]


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_round_trip_equals_brute_force(spark, min_bytes):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, salt int")
    folder = work_folder(spark)
    manifest = warc.write_packages(df.repartition(3), folder, min_bytes)
    assert sum(r.n_records for r in manifest.collect()) == len(rows)
    found = warc.read_packages(manifest, folder).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=repr) == expected(rows, min_bytes)
    texts = sorted(((p, (h or "").encode()) for p, _, h in rows), key=repr)
    by_digest = {r.payload_digest: bytes(r.payload) for r in found if r.record_type == "response"}
    assert sorted(((r.page_id, by_digest[r.payload_digest]) for r in found), key=repr) == texts
    assert all((r.payload is None) == (r.record_type == "revisit") for r in found)
    urls = {(p, u) for p, u, _ in rows}
    assert all((r.page_id, r.url) in urls or "%0D%0A" in r.url for r in found)


def test_an_empty_table(spark):
    folder = work_folder(spark)
    manifest = warc.write_packages(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert manifest.count() == 0 and warc.read_packages(manifest, folder).collect() == []


def package(rows):
    sink = io.BytesIO()
    writer = warc.PackageWriter(sink)
    for page_id, url, html in rows:
        writer.add(page_id, url, (html or "").encode(), None)
    writer.close()
    return sink.getvalue()


def records(data, run_bytes=None):
    source, found = source_of(data), []
    for begin, offsets, lengths in warc.record_runs(source, run_bytes):
        for offset, length in zip(offsets, lengths):
            record = warc.parse_record(gzip.decompress(warc.read_at(source, begin + offset, length)))
            found.append((record["page_id"], record["payload"].decode()))
    return sorted(found, key=repr)


def test_packages_are_plain_zip_files_of_stored_members():
    rows = rows_of(2, 60)
    data = package(rows)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [i.filename for i in z.infolist()] == [warc.ARCHIVE, warc.INDEX] and z.testzip() is None
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        lines = z.read(warc.INDEX).decode().splitlines()
        assert lines == sorted(lines) and len(lines) == len(rows)
        whole = gzip.decompress(z.read(warc.ARCHIVE))  # members one after the other
    assert whole.count(b"WARC/1.1\r\nWARC-Type: response") == len(rows)
    wanted = sorted(((p, h or "") for p, _, h in rows), key=repr)
    assert records(data) == wanted and records(data, run_bytes=1) == wanted


def other_package(change):
    """The same members, packed again by the standard library."""
    rows = [(k, "u", f"text {k}") for k in range(30)]
    with zipfile.ZipFile(io.BytesIO(package(rows))) as z:
        archive, index = z.read(warc.ARCHIVE), z.read(warc.INDEX)
    sink = io.BytesIO()
    change(sink, archive, index)
    return sink.getvalue(), sorted(((k, t) for k, _, t in rows), key=repr)


def plain(sink, archive, index, comment=b"", **options):
    with zipfile.ZipFile(sink, "w", **options) as z:
        z.writestr("readme é.txt", "not an archive")
        with z.open("archive/data.warc.gz", "w", force_zip64=True) as f:
            f.write(archive)
        z.writestr(zipfile.ZipInfo("indexes/index.cdxj"), index, zipfile.ZIP_DEFLATED)
        z.comment = comment


@pytest.mark.parametrize("comment", [b"", b"a comment with PK\x05\x06 inside, and more behind it", b"x" * 65_535])
def test_foreign_packages_comments_and_packed_indexes(comment):
    data, wanted = other_package(lambda *a: plain(*a, comment=comment))
    assert records(data) == wanted


def test_leading_bytes_shift_the_package():
    data, wanted = other_package(plain)
    assert records(b"#!shell stub\n" + data) == wanted


def test_zip64_directories(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)  # the library then writes ZIP64 end records
    data, wanted = other_package(plain)
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    assert records(data) == wanted and records(b"stub" * 9 + data) == wanted
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)  # and ZIP64 sizes and offsets
    data, wanted = other_package(plain)
    assert records(data) == wanted


def test_faults_are_refused():
    def packed_archive(sink, archive, index):
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("archive/data.warc.gz", archive)
            z.writestr("indexes/index.cdxj", index)

    for data in (other_package(packed_archive)[0], b"no package", b"", package([(1, "u", "a")])[:-30]):
        with pytest.raises(ValueError):
            records(data)
    record, _ = warc.build_record(1, "u", b"payload", None)
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"payload\r\n\r\n", b"changed\r\n\r\n"))


def test_packages_stay_below_their_bounds(monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_RECORDS", 3)
    writer = warc.PackageWriter(io.BytesIO())
    for k in range(3):
        assert not writer.full()
        writer.add(k, None, b"x", None)
    assert writer.full()
