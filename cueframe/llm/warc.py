"""WARC archives: written beside an index, and read back through it.

Each writing task makes archives of gzip members, one for each record, in the shared folder, and
returns the index: archive, offset, length, URL, digest. The index is a Spark table, so only records of
tasks that ended well are in it; files of tasks that were lost are never read. Readers sort the index by
place, join neighbouring byte ranges into one read, and parse the records found there.

Files are opened by pyarrow.fs from the folder's URI, so any store works that pyarrow knows (local and
shared mounts, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, new_path, slices, stored

#: A new archive begins beyond so many bytes.
ARCHIVE_BYTES = 128 << 20
#: Byte ranges so near to each other are read at once, up to so many bytes.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20

INDEX = "page_id bigint, archive string, offset bigint, length bigint, url string, digest string, record_type string, refers_to bigint"
_LEVEL = 1


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(url: str) -> str:
    """A URL as a header may have it: what is no printable ASCII character, and blanks, percent-encoded."""
    return quote(url, safe="".join(chr(c) for c in range(33, 127)))


def _record(fields: dict[str, str], block: bytes) -> bytes:
    head = {**fields, "WARC-Record-ID": f"<{uuid.uuid4().urn}>", "WARC-Date": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "Content-Length": str(len(block))}
    return b"".join([b"WARC/1.1\r\n", *[f"{k}: {v}\r\n".encode() for k, v in head.items()], b"\r\n", block, b"\r\n\r\n"])


def archive_info(name: str) -> bytes:
    """The record that an archive begins with."""
    return _record({"WARC-Type": "warcinfo", "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"software: cueframe\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, dated when it is written. Its block is an HTTP response, that of a revisit without the payload. Own
    fields: the page's number, that of the page it refers to, and a URL that a header can't hold as it is."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {"WARC-Type": "response", "WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http;msgtype=response"}
    if page_id is not None:
        head["Page-ID"] = str(page_id)
    if url is not None:
        head["WARC-Target-URI"] = _field(url)
        if head["WARC-Target-URI"] != url:
            head["Page-URL"] = base64.b64encode(url.encode()).decode()
    if refers_to is not None:
        head |= {"WARC-Type": "revisit", "Refers-To-Page-ID": str(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        payload = b""
    return _record(head, http + payload)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record that data holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:n]


def payload_of(block: bytes) -> tuple[bytes, int]:
    """What stands behind the HTTP head of a block, and how long the head says it is."""
    head, _, payload = block.partition(b"\r\n\r\n")
    return payload, next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))


def _id(field: str | None) -> int | None:
    return None if field is None else int(field)


def with_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds refers_to: of rows with equal payloads of at least min_bytes, the smallest page_id on all
    others. Only digests are shuffled to find them; rows without a page_id refer to the smallest that
    has one, and rows that repeat the smallest page_id itself are responses too."""
    digests = pages.select("page_id", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("_sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("_n"))
    groups = digests.where(F.col("_n") >= min_bytes).groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_many"))
    later = digests.join(groups.where("_many > 1"), "_sha").where("_n >= %d AND NOT (page_id <=> _first)" % min_bytes)
    later = later.select(F.col("page_id").alias("_page"), F.col("_sha").alias("_same"), F.col("_first").alias("refers_to")).distinct()
    keyed = pages.withColumn("_sha", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    return keyed.join(later, keyed["page_id"].eqNullSafe(later["_page"]) & (keyed["_sha"] == later["_same"]), "left").drop("_page", "_same", "_sha")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes a record for each row (page_id, url, html) and returns the index; evaluate it once."""
    typed = with_types(pages.select("page_id", "url", "html"), min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name, files = None, 0, "", None
        try:
            for b in slices(batches, "html"):
                rows = []
                for page, url, html, ref in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        files, path = _open(folder)
                        files.create_dir(path)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                        z = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                        info = z.compress(archive_info(name)) + z.flush()
                        out.write(info)
                        at = len(info)
                    payload = (html or "").encode()
                    sha = digest(payload)
                    z = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                    member = z.compress(record(page, url, payload, sha, ref)) + z.flush()
                    out.write(member)
                    rows.append((page, name, at, len(member), url, sha, "response" if ref is None else "revisit", ref))
                    at += len(member)
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return typed.select("page_id", "url", "html", "refers_to").mapInArrow(write, INDEX)


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that the index rows name, as their own bytes tell: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url and, if asked for, payload (null for a revisit).
    A response's length and digest are counted from its payload and must agree with its header; a revisit's are what its
    head says (see checked())."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + ", payload binary" * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

        def rows(group: list[tuple[str, int, int]]) -> Iterator[tuple]:
            first, last = group[0][1], group[-1][1] + group[-1][2]
            with files.open_input_file(f"{path}/{group[0][0]}") as f:
                data = f.read_at(last - first, first)
            for _, at, n in group:
                fields, block = parse(zlib.decompress(data[at - first : at - first + n], 31))
                payload, size = payload_of(block)
                kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload), digest(payload)) != (size, sha):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} does not agree with its header")
                url = base64.b64decode(own).decode() if (own := fields.get("Page-URL")) else fields.get("WARC-Target-URI")
                yield (_id(fields.get("Page-ID")), size, sha, kind, _id(fields.get("Refers-To-Page-ID")), url, payload if kind == "response" else None)[: len(names)]

        def batch(group) -> pa.RecordBatch:
            cols = zip(*rows(group), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        group: list[tuple[str, int, int]] = []
        for b in batches:
            for name, at, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if group and (name != group[-1][0] or at - group[-1][1] - group[-1][2] > GAP_BYTES or at + n - group[0][1] > READ_BYTES):
                    yield batch(group)
                    group = []
                group.append((name, at, n))
        if group:
            yield batch(group)

    # ranges by place: a range of archives and offsets in each task, in order
    n = max(2, index.sparkSession.sparkContext.defaultParallelism)
    placed = index.select("archive", "offset", "length").repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return placed.mapInArrow(read, schema)


def checked(records: DataFrame) -> DataFrame:
    """records with length and digest of every revisit taken from the response it refers to; an error if that is not
    there or says otherwise. Only numbers and digests are joined."""
    responses = records.where("record_type = 'response' AND page_id IS NOT NULL").select(F.col("page_id").alias("_of"), F.col("payload_digest").alias("_sha"), F.col("payload_bytes").alias("_n")).distinct()
    same = (F.col("refers_to") == F.col("_of")) & (F.col("payload_digest") == F.col("_sha"))
    j = records.where("record_type = 'revisit'").join(responses, same, "left")
    lost = F.raise_error(F.concat(F.lit("a revisit does not agree with the response of page "), F.col("refers_to").cast("string"))).cast("long")
    found = j.withColumns({"payload_bytes": F.when(F.col("_n") == F.col("payload_bytes"), F.col("_n")).otherwise(lost), "payload_digest": F.col("_sha")})
    return records.where("record_type = 'response'").unionByName(found.select(records.columns))


def archive_and_read(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Archives all pages in the shared folder, then reads every record back through the index.

    Null html: an empty payload. Null page_id: such rows are archived as any other. Null url: the
    record has no target. Repeated rows: a record each. Other columns are not archived, whatever their names. An empty table
    gives an empty one. The archives stay, the index and what was read are stored tables.
    """
    folder = new_path(spark, "warc")
    index = stored(write_archives(pages, folder, min_bytes), "warc-index")
    records = stored(read_records(index, folder, with_payload), "warc-records")
    forget(index)
    return checked(records)


#: Digest by digest: five hexadecimal digits are four of base 32.
SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p),
d AS (
    SELECT *, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS digest
    FROM f
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""
