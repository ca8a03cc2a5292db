"""Archives: round trip, revisits, salvage."""

import base64
import hashlib
import os
import zlib

from tickerpulse.llm import warc
from tickerpulse.session import work_path


def record(i, body, kind=b"response"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    digest = base64.b32encode(hashlib.sha1(block).digest())
    return (
        b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Type: application/http\r\n"
        b"WARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (kind, i, digest, len(block))
    ) + block + b"\r\n\r\n"


def member(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def found(content):
    return [x[:3] if x[0] == "gap" else warc._page(x[3]["warc-record-id"]) for x in warc.salvage(content)]


RECORDS = [record(i, os.urandom(300)) for i in range(5)]
MEMBERS = [member(r) for r in RECORDS]


def test_whole_archives():
    assert found(b"".join(RECORDS)) == found(warc.EMPTY_MEMBER.join(MEMBERS)) == found(member(b"".join(RECORDS))) == [0, 1, 2, 3, 4]
    assert found(b"") == [] and [x[:2] for x in found(b"\x1f\x8b\x08")] == [("gap", 0)]


def test_damage_costs_one_record_and_is_logged():
    for parts in (RECORDS, MEMBERS):
        low, high = len(parts[0]), len(parts[0]) + len(parts[1])
        for change in (lambda x: x[:-40] + bytes([x[-40] ^ 1]) + x[-39:], lambda x: x[:-30], lambda x: b"\x00" * len(x)):
            damaged = change(parts[1])
            got = found(parts[0] + damaged + b"".join(parts[2:]))
            assert [x for x in got if isinstance(x, int)] == [0, 2, 3, 4]
            gaps = [x for x in got if not isinstance(x, int)]
            assert gaps[0][1] == low and gaps[-1][2] == low + len(damaged) and high


def test_gzip_bodies_in_plain_archives():
    bodies = [member(b"<p>a page</p>" * 9), b"any bytes" + warc.MEMBER + b"more bytes", warc.EMPTY_MEMBER]
    coded = [record(10 + i, body) for i, body in enumerate(bodies)]
    assert found(RECORDS[0] + b"".join(coded) + RECORDS[1]) == [0, 10, 11, 12, 1]
    assert found(RECORDS[0][:-4] + MEMBERS[1] + coded[0] + MEMBERS[2]) == [0, 1, 10, 2]
    damaged = coded[0][:-20] + bytes([coded[0][-20] ^ 1]) + coded[0][-19:]
    assert found(RECORDS[0] + damaged + RECORDS[1]) == [0, ("gap", len(RECORDS[0]), len(RECORDS[0]) + len(damaged)), 1]


def test_wrong_length_and_bare_text_between():
    longer = RECORDS[1].replace(b"Content-Length: 319", b"Content-Length: 999")
    assert [x for x in found(RECORDS[0] + longer + RECORDS[2] + b"what is this\n" + RECORDS[3] + RECORDS[4][:100]) if isinstance(x, int)] == [0, 2, 3]


def test_revisits_nulls_and_repeats(spark):
    rows = [(5, "u5", "same"), (2, None, "same"), (9, "u\r\n9", "same"), (1, "u1", None), (4, "u4", ""), (7, "u7", "ü" * 9), (None, "u", "same"), (2, "again", "same")]
    df = spark.createDataFrame(rows, "page_id long, digest string, first string")  # names that the operator uses itself
    for gzip in (True, False):
        path = work_path(spark, "warc")
        warc.write(df, "page_id", "digest", "first", path, gzip=gzip, records_per_file=3)
        got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["url"]) for r in warc.read(spark, path).collect()}
        assert got == {
            (2, "response", None, 4, None), (2, "response", None, 4, "again"), (5, "revisit", 2, 4, "u5"), (9, "revisit", 2, 4, "u  9"),
            (None, "revisit", 2, 4, "u"), (1, "response", None, 0, "u1"), (4, "revisit", 1, 0, "u4"), (7, "response", None, 18, "u7"),
        }
    warc.write(df, "page_id", "digest", "first", path := work_path(spark, "warc"), min_bytes=5)
    assert {r["record_type"] for r in warc.read(spark, path).collect()} == {"response"}
    warc.write(df.limit(0), "page_id", "digest", "first", path := work_path(spark, "warc"))
    assert warc.read(spark, path).count() == 0


def test_a_damaged_file_in_spark(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(RECORDS[0] + RECORDS[1][:-40] + RECORDS[2])
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r["page_id"] for r in rows if r["kind"] == "record") == [0, 2]
    gap = [r for r in rows if r["kind"] == "gap"]
    assert [(r["begin"], r["end"]) for r in gap] == [(len(RECORDS[0]), len(RECORDS[0]) + len(RECORDS[1]) - 40)]
