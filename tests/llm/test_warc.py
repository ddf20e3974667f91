import io
import zipfile

import __spark_entry__ as entry
import oracle
import pytest
from conftest import SF

from weekwatch.llm import warc as A

SCHEMA = "page_id long, url string, html string"


def test_query_equals_its_sql(spark):
    problems, n, *_ = oracle.compare(spark, oracle.connect(SF), "op9_warc_archives", entry.queries()["op9_warc_archives"], A.ORACLE, SF)
    assert not problems and n > 0


def test_records_come_back():
    raw = A.build_record(7, "http://a/ b\n", "é<p>".encode() * 10, b"x" * 20, None, False)
    rec = A.parse_record(raw)
    assert rec["body"] == "é<p>".encode() * 10 and rec["fields"]["warc-target-uri"] == "http://a/%20b%0A"
    rec = A.parse_record(A.build_record(None, "", b"abc", b"x" * 20, 9, True))
    assert rec["body"] == b"" and rec["http"]["content-length"] == "3"
    assert A.page_of(rec["fields"]["warc-refers-to"]) == 9 and A.page_of(rec["fields"]["warc-record-id"]) is None


def test_directories_are_those_of_zipfile():
    data = A.build_archive([(b"record %d" % i, "http://x/") for i in range(40)])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name, (at, n) in A.members(io.BytesIO(data), len(data)).items():
            assert data[at : at + n] == z.read(name)
        assert set(z.namelist()) == {A.DATA, A.INDEX, "datapackage.json"}


def test_zip64_comments_and_deflated_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("plain.txt", b"stored")
        z.writestr("small.txt", b"deflated" * 100, zipfile.ZIP_DEFLATED)
        for i in range(66_000):  # more members than plain end records can count
            z.writestr(zipfile.ZipInfo(f"d/{i}"), b"")
        z.comment = b"PK\x05\x06 in a comment of many bytes"
    data = out.getvalue()
    found = A.members(io.BytesIO(data), len(data))
    assert len(found) == 66_001 and "small.txt" not in found
    at, n = found["plain.txt"]
    assert data[at : at + n] == b"stored"
    with pytest.raises(ValueError, match="central directory"):
        A.members(io.BytesIO(b"no archive at all, but long enough to look for one"), 50)


def test_large_sizes_come_from_the_zip64_field():
    extra = b"\x99\x99\x02\x00zz" + b"\x01\x00\x18\x00" + (5 << 32).to_bytes(8, "little") + (5 << 32).to_bytes(8, "little") + (9 << 32).to_bytes(8, "little")
    assert A._zip64(extra, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) == (5 << 32, 5 << 32, 9 << 32)
    assert A._zip64(extra, 0xFFFFFFFF, 7, 0xFFFFFFFF) == (5 << 32, 7, 5 << 32)


def test_awkward_pages(spark):
    big, other = "<p>ü</p>" * 300, "<p>v</p>" * 125
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/9", big), (9, "http://a/9", big), (3, None, None), (4, "", ""), (5, "http://b/5", "short"), (6, "u", "short"), (None, "http://c/", other), (None, "http://c/", other), (7, "x\ty", other), (8, "l", "z" * 2_000_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as sha1", "'r' as record_type").repartition(3)
    out = A.write_and_read(df, archive_bytes=10_000)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out.collect()), key=str)
    n = len(big.encode())
    want = [(1, n, "revisit", 9), (2, n, "revisit", 9), (9, n, "response", None), (9, n, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (None, 1000, "revisit", 7), (None, 1000, "revisit", 7), (7, 1000, "response", None), (8, 2_000_000, "response", None)]
    assert got == sorted(want, key=str)
    bodies = {r.page_id: bytes(r.body) for r in out.where("record_type = 'response' and page_id is not null").collect()}
    assert bodies[9] == big.encode() and bodies[8] == b"z" * 2_000_000
    assert A.write_and_read(spark.createDataFrame([], SCHEMA)).count() == 0
