"""Operator 7: WARC archives in Zstandard frames, written and read back.

An archive file is one skippable frame that holds the dictionary, then one frame
per WARC record, so that a record can be decoded alone.  Payloads that an earlier
page has already become ``revisit`` records, which carry the HTTP headers (with
the payload's length) and the digest, but no body.

Each task writes one archive under a name of its own attempt in the shared
folder; the list of files is itself a written table.  Defined results: a null
payload is empty; pages with a null id are always ``response``; rows that repeat
the smallest id of a payload are all ``response``; no pages, no archives."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayscope.llm import shared_files
from strayscope.llm.common import shared_path, written

# Fixed values of the formats: magic numbers of the skippable frame that holds
# a dictionary and of a Zstandard frame, and the WARC revisit profile.
DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"  # records carry no clock time, so that a rerun gives equal bytes

MIN_REVISIT = 100
#: a dictionary is trained on at most so many leading records of its own file
DICT_SAMPLES, DICT_SAMPLE_BYTES, DICT_BYTES = 128, 8192, 16384
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class ArchiveError(ValueError):
    """A frame, header or length that doesn't hold."""


# ----------------------------------------------------------------- records

def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record with its HTTP block and the two closing line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes, first: bytes) -> dict[str, str]:
    start, *rest = lines.split(b"\r\n")
    if not start.startswith(first):
        raise ArchiveError(f"record starts with {start[:20]!r}")
    out = {}
    for line in rest:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ArchiveError(f"header line without a colon: {line[:40]!r}")
        out[name.decode().lower()] = value.strip().decode()
    return out


def _page(urn: str | None) -> int | None:
    return None if urn is None else int(urn.removeprefix("<urn:page:").removesuffix(">"))


def parse_record(raw: bytes) -> dict:
    """Validate one record and return its fields (``payload`` is None for revisits)."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ArchiveError("record without an end of its header")
    fields = _headers(head, b"WARC/1.")
    if "content-length" not in fields or int(fields["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"Content-Length {fields.get('content-length')} but {len(rest) - 4} bytes")
    http, gap, body = rest[:-4].partition(b"\r\n\r\n")
    size = int(_headers(http, b"HTTP/1.")["content-length"])
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        if len(body) != size:
            raise ArchiveError(f"payload has {len(body)} bytes, its header says {size}")
        if hashlib.sha256(body).hexdigest() != digest:
            raise ArchiveError("payload doesn't match its digest")
    elif kind != "revisit" or body or "warc-refers-to" not in fields:
        raise ArchiveError(f"record type {kind!r} with {len(body)} bytes of payload")
    return {"page_id": _page(fields.get("warc-record-id")), "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"),
            "payload": body if kind == "response" else None}


# ------------------------------------------------------------------- files

def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few or too small samples give a raw-content one."""
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def write_archive(out, records: Iterator[bytes]) -> int:
    """Write records to an open stream: dictionary frame, then a frame for each."""
    first = []
    for r in records:
        first.append(r)
        if len(first) == DICT_SAMPLES:
            break
    raw = dictionary([r[:DICT_SAMPLE_BYTES] for r in first])
    out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
    press = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(raw) if raw else None, write_content_size=True)
    n = 0
    for source in (first, records):
        for r in source:
            out.write(press.compress(r))
            n += 1
    return n


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ArchiveError("archive ends inside its dictionary frame")
    return data


def read_archive(stream, block: int = 1 << 16) -> Iterator[dict]:
    """Records of an open archive: load the dictionary from the leading skippable
    frame, then decode and validate one frame per record."""
    magic, size = struct.unpack("<II", _exactly(stream, 8))
    if magic != DICT_MAGIC:
        raise ArchiveError(f"no dictionary frame: magic {magic:#x}")
    raw = _exactly(stream, size)
    if raw[:4] == struct.pack("<I", ZSTD_MAGIC):  # the dictionary may itself be compressed
        raw = zstd.ZstdDecompressor().decompress(raw)
    opener = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw)) if raw else zstd.ZstdDecompressor()
    data = stream.read(block)
    while data:
        frame, parts = opener.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data or stream.read(block)
                break
            data = stream.read(block)
            if not data:
                raise ArchiveError("archive ends inside a frame")
        yield parse_record(b"".join(parts))


# ------------------------------------------------------------------- spark

def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, payload, digest, refers_to.  Repeated payloads are counted on
    their digests alone (pre-aggregated), and only those are joined back."""
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"),
                        F.coalesce(pages[payload], F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    heads = (rows.filter((F.octet_length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull())
             .groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("_last"))
             .filter("first < _last").select("digest", "first"))
    return (rows.join(heads, "digest", "left")
            .select("page_id", "url", "payload", "digest",
                    F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to")))


def write_archives(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write one archive per task; return the written list (file, n_records)."""
    folder = folder or shared_path(pages.sparkSession, "warc")

    def run(batches):
        def records():
            for batch in batches:
                for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield record_bytes(page, url, payload, digest, refers)

        rows = records()
        head = next(rows, None)
        if head is None:
            return

        def again():
            yield head
            yield from rows

        uri, out = shared_files.create(folder, f"part-{TaskContext.get().partitionId():06d}", ".warc.zst")
        with out:
            n = write_archive(out, again())
        yield pa.RecordBatch.from_pydict({"file": [uri], "n_records": [n]})

    return written(with_revisits(pages, **columns).mapInArrow(run, "file string, n_records long"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """The records of the listed archives, one file a task; counts are validated."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, rows = 0, []
                with shared_files.open_stream(uri) as stream:
                    for record in read_archive(stream):
                        rows.append({k: record[k] for k in names})
                        n += 1
                        if len(rows) == 1024:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if n != expected:
                    raise ArchiveError(f"{uri} has {n} records, {expected} were written")
                yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, files.count())
    return files.select("file", "n_records").repartition(n).mapInArrow(run, FIELDS)


def archive_round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    return read_archives(write_archives(pages, **columns))
