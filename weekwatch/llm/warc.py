"""WARC records inside ZIP archives, read by byte ranges.

Writing: each task puts its pages into archives of bounded size. An archive is a ZIP file whose members
are stored, not deflated: `archive/data.warc.gz` (one gzip member per record), `indexes/index.cdxj` (one
line per record with offset and length inside the member) and `datapackage.json`. Of pages with equal
payloads of at least `least` bytes the one with the largest page_id is a response record, the others
revisit it. Reading never extracts: the end record and the ZIP64 records are parsed, the central
directory gives the members, their local headers the place of the bytes, the index the record ranges,
and each record is read by one range.

Archives go to a new folder under the shared one, under names that hold the task's attempt; only archives
named in the checkpointed manifest are read, so what a lost executor left behind is never seen.

Files are opened through pyarrow's file systems (local, HDFS, S3, GCS), as Spark has no sink for
binary files. Defined cases: a null html is an empty payload; a null url is an empty target; a null
page_id sorts below all others and reads back as null; rows that repeat the largest page_id of a payload
are all responses; an empty table gives no record. Only page_id, url and html are read, so other columns
cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from weekwatch.llm.registry import query, table
from weekwatch.session import checkpoint_dir, cut_lineage

LEAST_PAYLOAD, ARCHIVE_BYTES, RANGE_GROUP = 1000, 32 << 20, 256
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2025-01-01T00:00:00Z"


# --- records -----------------------------------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(rid: str) -> int | None:
    tail = rid.strip("<>").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def _target(url: str) -> str:
    """A URL on one line: white space and control characters are percent-encoded."""
    return "".join(c if c > " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def build_record(page_id: int | None, url: str, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record with its HTTP headers; a revisit has no body, but the length of the full one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_target(url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, HTTP headers and body of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    http_fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    return {"fields": fields, "http": http_fields, "body": body}


# --- archives ----------------------------------------------------------------------------------------


def build_archive(records: list[tuple[bytes, str]]) -> bytes:
    """ZIP bytes of stored members: gzip-compressed records, their index, a small description."""
    data, lines = io.BytesIO(), []
    for raw, target in records:
        at = data.tell()
        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        data.write(gz.compress(raw) + gz.flush())
        lines.append(f"{target} {json.dumps({'offset': at, 'length': data.tell() - at})}\n")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, content in ((DATA, data.getvalue()), (INDEX, "".join(lines).encode()), ("datapackage.json", b'{"profile": "data-package"}')):
            member = zipfile.ZipInfo(name, (2025, 1, 1, 0, 0, 0))
            with z.open(member, "w", force_zip64=True) as f:  # sizes in the ZIP64 fields, whatever they are
                f.write(content)
    return out.getvalue()


_EOCD, _EOCD64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def _read(f, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) != n:
        raise ValueError("archive ends early")
    return got


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Place and length of the bytes of each stored member, from the central directory alone."""
    tail_at = max(0, size - 22 - 65535 - 20)
    tail = _read(f, tail_at, size - tail_at)
    at = tail.rfind(_EOCD)
    # the comment after the record may hold the same bytes, but then its length does not fit
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(_EOCD, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack("<10xH2I", tail[at : at + 20])
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF or tail[at - 20 : at - 16] == _LOCATOR64:
        (end64,) = struct.unpack("<8xQ4x", tail[at - 20 : at])
        record = _read(f, end64, 56)
        if record[:4] != _EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack("<32x3Q", record)
    directory, out, p = _read(f, start, length), {}, 0
    for _ in range(n):
        if directory[p : p + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, stored, full, name_n, extra_n, comment_n, local = struct.unpack_from("<10xH8xII3H8xI", directory, p)
        name = directory[p + 46 : p + 46 + name_n].decode("utf-8", "replace")
        extra = directory[p + 46 + name_n : p + 46 + name_n + extra_n]
        full, stored, local = _zip64(extra, full, stored, local)
        p += 46 + name_n + extra_n + comment_n
        if method != 0 or stored != full:
            continue  # not stored: its bytes cannot be read by ranges
        head = _read(f, local, 30)
        if head[:4] != _LOCAL:
            raise ValueError("broken local header")
        out[name] = (local + 30 + sum(struct.unpack("<26x2H", head)), stored)
    return out


def _zip64(extra: bytes, full: int, stored: int, local: int) -> tuple[int, int, int]:
    """Sizes and offset, taken from the ZIP64 extra field where the plain ones are all ones."""
    values, p = [full, stored, local], 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, p)
        if kind == 1:
            at = p + 4
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF:
                    (values[i],) = struct.unpack_from("<Q", extra, at)
                    at += 8
        p += 4 + n
    return values[0], values[1], values[2]


# --- writing -----------------------------------------------------------------------------------------


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def with_roles(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """page_id, url, html, sha1, revisit and refers_to. Payload groups are merged before they are joined."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    p = p.withColumn("sha1", F.sha1(F.encode("html", "utf-8")))
    large = F.octet_length("html") >= least
    # one row per repeated payload; a payload that a third of the pages share is one row here
    firsts = (
        p.where(large).groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("sha1").alias("f_sha1"), "refers_to")
    )
    joined = p.join(firsts, large & (F.col("sha1") == F.col("f_sha1")), "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select("page_id", "url", "html", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("refers_to")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of with_roles() and returns the manifest (path, size, records)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = _file_system(folder)
        filesystem.create_dir(root, recursive=True)
        context = TaskContext.get()
        task, batch, held, number = f"{context.partitionId():06d}-{context.taskAttemptId()}", [], 0, 0

        def flush() -> pd.DataFrame:
            nonlocal batch, held, number
            content, path = build_archive(batch), f"{root}/part-{task}-{number:05d}.wacz"
            with filesystem.open_output_stream(path) as f:
                f.write(content)
            row = pd.DataFrame({"path": [path], "size": [len(content)], "records": [len(batch)]})
            batch, held, number = [], 0, number + 1
            return row

        for frame in frames:
            for page_id, url, html, sha1, revisit, refers in frame[["page_id", "url", "html", "sha1", "revisit", "refers_to"]].itertuples(index=False):
                page = None if pd.isna(page_id) else int(page_id)
                raw = build_record(page, url, html.encode(), bytes.fromhex(sha1), None if pd.isna(refers) else int(refers), bool(revisit))
                batch.append((raw, _target(url)))
                held += len(raw)
                if held >= archive_bytes:
                    yield flush()
        if batch:
            yield flush()

    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]
    return cut_lineage(pages.select("url", "html", "sha1", "revisit", *ids).mapInPandas(run, "path string, size long, records long"))


# --- reading -----------------------------------------------------------------------------------------


def read_indexes(manifest: DataFrame, folder: str, group: int = RANGE_GROUP) -> DataFrame:
    """(path, ranges): ranges of records, `group` to a row, from directory and index of each archive."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, _ = _file_system(folder)
        for frame in frames:
            for path, size in zip(frame["path"], frame["size"]):
                with filesystem.open_input_file(path) as f:
                    places = members(f, int(size))
                    at, n = places[INDEX]
                    base = places[DATA][0]
                    lines = _read(f, at, n).decode().splitlines()
                entries = [json.loads(x.partition(" ")[2]) for x in lines]
                for i in range(0, len(entries), group):
                    part = entries[i : i + group]
                    yield pd.DataFrame({"path": [path], "offsets": [[base + e["offset"] for e in part]], "lengths": [[e["length"] for e in part]]})

    return manifest.mapInPandas(run, "path string, offsets array<long>, lengths array<long>")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, body binary"


def read_records(ranges: DataFrame, folder: str) -> DataFrame:
    """One row per record, each read by its own range; a revisit has no body."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, _ = _file_system(folder)
        for frame in frames:
            for path, offsets, lengths in zip(frame["path"], frame["offsets"], frame["lengths"]):
                rows = []
                with filesystem.open_input_file(path) as f:
                    for at, n in zip(offsets, lengths):
                        rec = parse_record(zlib.decompress(_read(f, int(at), int(n)), 31))
                        fields, kind = rec["fields"], rec["fields"]["warc-type"]
                        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                        if kind == "response" and hashlib.sha1(rec["body"]).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                        refers = fields.get("warc-refers-to")
                        rows.append(
                            (page_of(fields["warc-record-id"]), fields["warc-target-uri"], kind, page_of(refers) if refers else None,
                             int(rec["http"]["content-length"]), digest, rec["body"] if kind == "response" else None)
                        )
                out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "body"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return ranges.mapInPandas(run, RECORD)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one, for one run."""
    return f"{checkpoint_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"


def write_and_read(pages: DataFrame, folder: str | None = None, least: int = LEAST_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    folder = folder or new_folder(pages.sparkSession)
    manifest = write_archives(with_roles(pages, least), folder, archive_bytes)
    return read_records(read_indexes(manifest, folder), folder)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages
),
m AS (SELECT digest, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p LEFT JOIN m USING (digest)
"""


@query("op9_warc_archives", ORACLE)
def op9(spark, sf_dir):
    """Every page as a WARC record in ZIP archives, read back by ranges."""
    return write_and_read(table(spark, sf_dir, "pages")).drop("body", "url")
