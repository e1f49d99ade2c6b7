"""WARC archives in Zstandard: one frame a record, the dictionary in the leading skippable frame."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glossa.llm.common import read, written

SKIPPABLE = 0x184D2A5D  # of a dictionary frame
FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def train_dictionary(samples: list[bytes], size: int = 16_384) -> bytes:
    """A dictionary of the samples; raw bytes of them where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _ids(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build_record(page_id, url, payload: bytes | None, digest: str, n_bytes: int, refers_to) -> bytes:
    """A response with its payload, or (payload None) a revisit of refers_to."""
    kind = "response" if payload is not None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    target = "".join((url or "about:blank").split())
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_ids(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}", f"X-Payload-Length: {n_bytes}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head[4:4] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_ids(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; ValueError where the form, a length or a digest is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header without colon: {line[:80]}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"header {name} is missing")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest)} bytes, {length} and an end are declared")
    block = rest[:length]
    if (digest := headers.get("warc-block-digest", "")).startswith("sha1:") and digest[5:] != hashlib.sha1(block).hexdigest():
        raise ValueError("block digest differs")
    return headers, block


def http_payload(block: bytes) -> bytes:
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP header in a response")
    return payload


def write_archive(records: list[bytes], dictionary: bytes, level: int = 3) -> bytes:
    """Skippable frame with the dictionary, then one frame a record."""
    kwargs = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **kwargs)
    return b"".join([struct.pack("<II", SKIPPABLE, len(dictionary)), dictionary, *map(compressor.compress, records)])


def read_archive(data: bytes, piece: int = 1 << 15) -> Iterator[bytes]:
    """The content of each frame; the dictionary, plain or itself compressed, comes from the leading skippable frame."""
    view, at, kwargs = memoryview(data), 0, {}
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise ValueError("the dictionary frame is cut off")
        dictionary = bytes(view[8 : 8 + size])
        if dictionary[:4] == struct.pack("<I", FRAME):
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
        if dictionary:
            kwargs = {"dict_data": zstandard.ZstdCompressionDict(dictionary)}
        at = 8 + size
    decompressor = zstandard.ZstdDecompressor(**kwargs)
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("the archive is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            continue
        declared = zstandard.get_frame_parameters(view[at : at + 18]).content_size
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("a frame is cut off")
            parts.append(one.decompress(view[at : at + piece]))
            at += min(piece, len(data) - at)
        at -= len(one.unused_data)
        record = b"".join(parts)
        if declared not in (zstandard.CONTENTSIZE_UNKNOWN, len(record)):
            raise ValueError(f"frame of {len(record)} bytes, {declared} are declared")
        yield record


def _payloads(html) -> tuple:
    payload = F.coalesce(html, F.lit("")).cast("binary")
    return F.sha1(payload), F.length(payload).cast("long")


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with digest, n_bytes, refers_to (null: a response) and html null in revisits.

    Digests with one page are dropped before the join by a count summed on each partition first, so only repeated
    payloads are looked up; Spark splits a hot one's partition in the join.
    """
    digest, size = _payloads(F.col("html"))
    keyed = pages.select("page_id", "url", "html", digest.alias("digest"), size.alias("n_bytes"))
    repeated = (
        keyed.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select(F.col("digest").alias("known"), "last")
    )
    repeated = written(repeated, "warc-repeated")
    joined = keyed.join(repeated, F.col("digest") == F.col("known"), "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "digest", "n_bytes", F.when(again, F.col("last")).alias("refers_to"), F.when(~again, F.coalesce("html", F.lit(""))).alias("html"))


def write_archives(pages: DataFrame, dictionary: bytes, archive_bytes: int = 4 << 20) -> DataFrame:
    """(archive_id, data): archives of about archive_bytes before compression, from the rows of plan_records."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, records, total = TaskContext.get().partitionId(), 0, [], 0

        def close():
            return pa.RecordBatch.from_pydict({"archive_id": [f"{part:06d}-{n:06d}"], "data": pa.array([write_archive(records, dictionary)], pa.large_binary())}).cast(schema)

        schema = pa.schema([("archive_id", pa.string()), ("data", pa.binary())])
        for batch in batches:
            for r in range(batch.num_rows):
                page_id, url, digest, n_bytes, refers_to, html = (c[r].as_py() for c in batch.columns)
                record = build_record(page_id, url, None if html is None else html.encode(), digest, n_bytes, refers_to)
                if records and total + len(record) > archive_bytes:
                    yield close()
                    n, records, total = n + 1, [], 0
                records.append(record)
                total += len(record)
        if records:
            yield close()

    return pages.select("page_id", "url", "digest", "n_bytes", "refers_to", "html").mapInArrow(pack, "archive_id string, data binary")


RECORDS = "archive_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, with_html: bool = False) -> DataFrame:
    """A row for each record of archives (archive_id, data), for instance of files read as binaryFile.

    Payload length and digest are computed from what is read; a revisit has no payload, so there they are what its
    headers say. A record that isn't as its headers say raises ValueError.
    """
    schema = RECORDS + (", html string" if with_html else "")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def number(text: str) -> int | None:
        tail = text.rpartition(":")[2].rstrip(">")
        return int(tail) if tail else None

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[tuple] = []
                for record in read_archive(data.as_py()):
                    headers, block = parse_record(record)
                    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    payload = http_payload(block)
                    if kind == "response":
                        size, own = len(payload), hashlib.sha1(payload).hexdigest()
                        if digest and digest != own:
                            raise ValueError("payload digest differs")
                        digest = own
                    else:
                        size = int(headers["x-payload-length"])
                    refers = number(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
                    row = (name.as_py(), number(headers["warc-record-id"]), headers.get("warc-target-uri"), size, digest, kind, refers)
                    rows.append(row + ((payload.decode() if kind == "response" else None),) if with_html else row)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return archives.select("archive_id", "data").mapInArrow(unpack, schema)


def archive_pages(pages: DataFrame, samples: int = 200, sample_chars: int = 8192) -> DataFrame:
    """Writes a record for each of pages to archives in the shared folder and returns these (archive_id, data).

    Only the dictionary is fitted on a sample: the first sample_chars characters of about `samples` pages, those of
    smallest hashed page_id. Null pages have an empty payload; null page_ids give records without a number; repeated
    rows give repeated records; no pages give no archives.
    """
    order = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))
    some = pages.filter(order < 2**32 * min(1.0, samples / max(pages.count(), 1)))
    texts = some.select(F.substring(F.coalesce("html", F.lit("")), 1, sample_chars)).limit(2 * samples).collect()
    dictionary = train_dictionary([r[0].encode() for r in texts])
    return written(write_archives(plan_records(pages), dictionary), "warc")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    archives = archive_pages(read(spark, sf_dir, "pages"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM q
"""
