"""Web archive records in ZIP packages: written once per payload, read by ranges.

``write_packages`` stores rows as WARC 1.1 records, each its own gzip member, in packages: ZIP files
of two stored (uncompressed) members, the archive ``archive/data.warc.gz`` and its index
``indexes/index.cdxj``, one line per record with its place in the archive. Of rows with equal
payloads one is a response, the others revisits that refer to it and carry no payload.

``read_packages`` never extracts a member. It reads a package's end record, the ZIP64 one where
there is one, and the central directory; finds the stored archive members by their local headers; reads the
indexes piece by piece; and spreads the records' ranges over tasks, which fetch and
unpack runs of neighbouring records. Any ZIP package of stored ``*.warc.gz`` members with CDXJ
indexes beside them can be read.

Which row is the response is decided on (digest, page_id) alone. A payload that very many pages share
would be one key: rows also carry a salt, a hash of their id, the fold goes by (digest, salt) first, and
the join back by (digest, salt), for digests that occur more than once. Texts are equal by SHA-256.

A task streams its rows into packages of bounded size under names unique per attempt; only the
manifest rows of successful tasks count, so lost or repeated tasks leave no trace in the result.

Defined results: a null html is an empty payload; a null url gives no target URI, and white space and
control characters of a URL are escaped in its record. Of equal payloads the rows with the largest
page_id are responses, all of them if it repeats; null counts as the smallest id, and a payload that
only rows without id have is a response in each. Payloads of fewer than ``min_bytes`` bytes are all
responses. Reading checks length and digest of every payload it reads. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_of
from tidemark.llm.packed_ids import file_system

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 64 << 20  # of packed records, or
PACKAGE_RECORDS = 50_000
RUN_BYTES = 8 << 20  # packed records fetched at once
PIECE_BYTES = 1 << 20  # of an index or directory read at once
LEVEL = 6
UNKNOWN_DATE = "1970-01-01T00:00:00Z"
# Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
END_RECORD = struct.Struct("<4s4H2LH")
END64_LOCATOR = struct.Struct("<4sLQL")
END64_RECORD = struct.Struct("<4sQ2H2L4Q")
DIRECTORY_ENTRY = struct.Struct("<4s6H3L5H2L")
LOCAL_HEADER = struct.Struct("<4s5H3L2H")
END_MAGIC, LOCATOR_MAGIC, END64_MAGIC = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
ENTRY_MAGIC, LOCAL_MAGIC = b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

MANIFEST = "path string, n_records long, n_bytes long"
RUNS = "path string, begin long, offsets array<long>, lengths array<long>"
RECORDS = (
    "page_id long, url string, record_type string, payload_digest string, payload_bytes long,"
    " refers_to long, payload binary"
)


# --- which rows are responses ---------------------------------------------------------------------


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows (page_id, url, html, revisits, refers_to): of what row a row is a revisit, if it is one."""
    salts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    keyed = rows.withColumns(
        {
            "digest": F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha2("html", 256))),
            "salt": F.expr(f"int(pmod(xxhash64(page_id), {salts}L))"),
        }
    )
    # Few bytes a row: a digest with its salts, only where a payload repeats.
    originals = (
        keyed.where("digest IS NOT NULL")
        .groupBy("digest", "salt")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
        .groupBy("digest")
        .agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.collect_list("salt").alias("salts"))
        .where("n > 1")
        .select("digest", F.explode("salts").alias("salt"), "last")
    )
    joined = keyed.join(originals, ["digest", "salt"], "left")
    revisits = F.expr("last IS NOT NULL AND NOT (page_id <=> last)")
    return joined.select("page_id", "url", "html", F.when(revisits, F.col("last")).alias("refers_to"))


# --- writing --------------------------------------------------------------------------------------


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _target(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A response, or a revisit where ``refers_to`` is set; and the digest of the payload."""
    digest = base32_sha1(payload)
    http = HTTP % len(payload)
    block = http + payload if refers_to is None else http
    named = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", UNKNOWN_DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        named.append(("WARC-Target-URI", _target(url)))
    if refers_to is not None:
        named += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    head = "".join(f"{name}: {value}\r\n" for name, value in named)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", digest


class PackageWriter:
    """Streams records into one package; holds the lines of its index, not the records."""

    def __init__(self, sink: pa.NativeFile):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.written, self.lines = 0, []
        info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
        self._put(info % (str(uuid.uuid4()).encode(), UNKNOWN_DATE.encode()))

    def _put(self, record: bytes) -> tuple[int, int]:
        packed = gzip.compress(record, LEVEL, mtime=0)
        self.archive.write(packed)
        self.written += len(packed)
        return self.written - len(packed), len(packed)

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        record, digest = build_record(page_id, url, payload, refers_to)
        offset, length = self._put(record)
        place = {"filename": ARCHIVE.rsplit("/", 1)[1], "offset": offset, "length": length, "digest": f"sha1:{digest}"}
        key = _target(url) if url else "-"
        self.lines.append(f"{key} {re.sub('[^0-9]', '', UNKNOWN_DATE)} {json.dumps(place)}\n")

    def full(self) -> bool:
        return self.written >= PACKAGE_BYTES or len(self.lines) >= PACKAGE_RECORDS

    def close(self) -> None:
        self.archive.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as index:
            for line in sorted(self.lines):
                index.write(line.encode())
        self.zip.close()


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, html) rows; return the manifest (path, n_records, n_bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        part, writer, sink, path = TaskContext.get().partitionId(), None, None, ""

        def finish() -> pa.RecordBatch:
            writer.close()
            sink.close()
            size = store.get_file_info(path).size
            return pa.RecordBatch.from_pydict(
                {"path": [path], "n_records": pa.array([len(writer.lines)]), "n_bytes": pa.array([size])}
            )

        for batch in batches:
            page_id, url, html, refers_to = batch.columns
            for k in range(batch.num_rows):
                if writer is None:
                    path = f"{root}/package-{part:06d}-{uuid.uuid4().hex}.wacz"
                    sink = store.open_output_stream(path)
                    writer = PackageWriter(sink)
                writer.add(page_id[k].as_py(), url[k].as_py(), html[k].as_py().encode(), refers_to[k].as_py())
                if writer.full():
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return stored(with_originals(pages, min_bytes).mapInArrow(write, MANIFEST), folder, "manifest")


# --- reading --------------------------------------------------------------------------------------


class Member:
    """A member of a package: its name, whether it is stored, and where its bytes lie."""

    def __init__(self, name: str, method: int, header: int, size: int):
        self.name, self.stored, self.header, self.size = name, method == zipfile.ZIP_STORED, header, size

    def begin(self, source: pa.NativeFile) -> int:
        """Where its bytes begin; a local header may be longer than the directory says."""
        magic, *_, name, extra = LOCAL_HEADER.unpack(read_at(source, self.header, LOCAL_HEADER.size))
        if magic != LOCAL_MAGIC:
            raise ValueError(f"no local header of {self.name}")
        return self.header + LOCAL_HEADER.size + name + extra


def read_at(source: pa.NativeFile, offset: int, size: int) -> bytes:
    source.seek(offset)
    data = source.read(size)
    if len(data) != size:
        raise ValueError(f"{size} bytes at {offset} go beyond the package's end")
    return data


def directory(source: pa.NativeFile) -> list[Member]:
    """The members that the central directory of a package lists."""
    start, size, count, shift = _end_record(source)
    data, members, at = read_at(source, start + shift, size), [], 0
    for _ in range(count):
        fields = DIRECTORY_ENTRY.unpack_from(data, at)
        magic, method, packed, full, header = fields[0], fields[4], fields[8], fields[9], fields[16]
        name_size, extra_size, comment_size = fields[10:13]
        if magic != ENTRY_MAGIC:
            raise ValueError("broken central directory")
        at += DIRECTORY_ENTRY.size
        name = data[at : at + name_size].decode("utf-8" if fields[3] & 0x800 else "cp437")
        extra = data[at + name_size : at + name_size + extra_size]
        at += name_size + extra_size + comment_size
        full, packed, header = _zip64_values(extra, [full, packed, header])
        members.append(Member(name, method, header + shift, packed))
    return members


def _zip64_values(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset, with those that do not fit in 32 bits from the extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            wide = at + 4
            for k, value in enumerate(values):
                if value == FULL32:
                    values[k] = struct.unpack_from("<Q", extra, wide)[0]
                    wide += 8
            return values
        at += 4 + size
    return values


def _end_record(source: pa.NativeFile) -> tuple[int, int, int, int]:
    """Start, size and entries of the central directory, and how far the package is shifted in its file."""
    end = source.size()
    tail_start = max(0, end - END_RECORD.size - FULL16)
    tail = read_at(source, tail_start, end - tail_start)
    at = tail.rfind(END_MAGIC)
    while at >= 0:  # of a magic inside the comment, the comment's length is wrong
        if at + END_RECORD.size <= len(tail):
            _, _, _, _, count, size, start, comment = END_RECORD.unpack_from(tail, at)
            if at + END_RECORD.size + comment == len(tail):
                break
        at = tail.rfind(END_MAGIC, 0, at)
    if at < 0:
        raise ValueError("not a ZIP package")
    directory_end = tail_start + at
    where = directory_end - END64_LOCATOR.size
    if where >= END64_RECORD.size:
        magic, _, wide, _ = END64_LOCATOR.unpack(read_at(source, where, END64_LOCATOR.size))
        # The record stands where its locator says, or right before it if bytes precede the package.
        before = where - END64_RECORD.size
        for place in (wide, before) if magic == LOCATOR_MAGIC else ():
            if place <= before:
                fields = END64_RECORD.unpack(read_at(source, place, END64_RECORD.size))
                if fields[0] == END64_MAGIC:
                    return fields[9], fields[8], fields[7], place - fields[9] - fields[8]
    if count == FULL16 or FULL32 in (size, start):
        raise ValueError("no ZIP64 end record")
    return start, size, count, directory_end - start - size


def index_lines(source: pa.NativeFile, member: Member) -> Iterator[bytes]:
    """Lines of an index, a piece at a time; a packed index is unpacked as it is read."""
    at = member.begin(source)
    end, rest = at + member.size, b""
    unpacker = None if member.stored else zlib.decompressobj(-15)
    while at < end:
        piece = read_at(source, at, min(PIECE_BYTES, end - at))
        at += len(piece)
        *lines, rest = (rest + (unpacker.decompress(piece) if unpacker else piece)).split(b"\n")
        yield from lines
    if unpacker:
        *lines, rest = (rest + unpacker.flush()).split(b"\n")
        yield from lines
    if rest:
        yield rest


def record_runs(source: pa.NativeFile, run_bytes: int | None = None) -> Iterator[tuple[int, list[int], list[int]]]:
    """Runs of a package's records: where the run begins, and each record's offset in it and length."""
    run_bytes = run_bytes or RUN_BYTES
    members = directory(source)
    archives = {m.name.rsplit("/", 1)[-1]: m for m in members if m.name.endswith(".warc.gz")}
    places: dict[str, list[tuple[int, int]]] = {}
    for member in members:
        if member.name.endswith((".cdxj", ".cdx")):
            for line in index_lines(source, member):
                if (at := line.find(b"{")) >= 0:
                    place = json.loads(line[at:])
                    places.setdefault(place["filename"], []).append((int(place["offset"]), int(place["length"])))
    for name, found in places.items():
        if name not in archives or not archives[name].stored:
            raise ValueError(f"the package holds no stored archive {name}")
        base, found = archives[name].begin(source), sorted(found)
        begin, offsets, lengths = 0, [], []
        for offset, length in found:
            if offset + length > archives[name].size:
                raise ValueError(f"a record of {name} lies beyond its end")
            if offsets and offset + length - begin > run_bytes:
                yield base + begin, offsets, lengths
                offsets, lengths = [], []
            if not offsets:
                begin = offset
            offsets.append(offset - begin)
            lengths.append(length)
        if offsets:
            yield base + begin, offsets, lengths


def parse_record(record: bytes) -> dict | None:
    """Fields of a response or revisit, its payload checked; None for other kinds."""
    stream = io.BytesIO(record)
    if not stream.readline().startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    named = _header_lines(stream)
    kind = named.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = stream.read(int(named["content-length"]))
    http = io.BytesIO(block)
    http.readline()
    n_bytes = int(_header_lines(http).get("content-length", -1))
    payload = http.read() if kind == "response" else None
    digest = named["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None:
        n_bytes = len(payload) if n_bytes < 0 else n_bytes
        if len(payload) != n_bytes or base32_sha1(payload) != digest:
            raise ValueError(f"the payload of {named['warc-record-id']} is not what its record says")
    return {
        "page_id": _page_of(named["warc-record-id"]),
        "url": named.get("warc-target-uri"),
        "record_type": kind,
        "payload_digest": digest,
        "payload_bytes": n_bytes,
        "refers_to": _page_of(named.get("warc-refers-to", "")),
        "payload": payload,
    }


def _header_lines(stream: io.BytesIO) -> dict[str, str]:
    named = {}
    while line := stream.readline().strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        named[name.lower()] = value.strip()
    return named


def _page_of(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+):[A-Z2-7]*>", name)
    return int(found[1]) if found else None


def read_packages(packages: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Records (see ``RECORDS``) of the packages at ``path``; without payloads if these are not wanted.

    ``folder`` is where the packages lie; it names their store.
    """
    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = RECORDS if payload else RECORDS.replace(", payload binary", "")
    names = [c.split()[0] for c in kept.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        lists = pa.list_(pa.int64())
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as source:
                    for begin, offsets, lengths in record_runs(source):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path]), pa.array([begin], pa.int64()), pa.array([offsets], lists), pa.array([lengths], lists)],
                            names=["path", "begin", "offsets", "lengths"],
                        )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        schema = pa.schema(
            [(n, pa.binary() if n == "payload" else pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in names]
        )
        for batch in batches:
            for run in batch.to_pylist():
                with store.open_input_file(run["path"]) as source:
                    data = read_at(source, run["begin"], run["offsets"][-1] + run["lengths"][-1])
                records = (
                    parse_record(gzip.decompress(data[offset : offset + length]))
                    for offset, length in zip(run["offsets"], run["lengths"])
                )
                found, held = [], 0
                for record in records:
                    if record is None:
                        continue
                    held += len(record["payload"] or b"") if payload else 0
                    found.append({n: record[n] for n in names})
                    if held > RUN_BYTES:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    spread = packages.select("path").repartition(parts, "path")
    runs = spread.mapInArrow(find, RUNS)
    # A run's place is its key: a repeated task deals the same runs to the same tasks.
    return runs.repartition(parts, "path", "begin").mapInArrow(fetch, kept)
