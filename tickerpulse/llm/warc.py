"""WARC archives: a writer with revisit records and a salvage reader.

``write`` turns rows into response and revisit records and lets Spark's text writer commit them: as gzip members, one
per record, or as plain records. ``read`` goes through the archives and checks every record: version line, length,
the line breaks behind it and the SHA-1 digests that it names. After a failed check it searches for the next gzip
member that unpacks or the next version line, goes on from there and logs the bytes in between as a gap.

NULL payloads count as empty. Rows without an id are written with the id ``-`` and come back as NULL; they are never
what others refer to while a row of the same payload has an id. If several rows carry the smallest id of a payload,
each of them is a response. Line breaks and other control characters in a URL become blanks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# What the writer puts between members: itself an empty gzip member.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300000000000000 0000".replace(" ", ""))
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r?\n")  # anywhere: a record before it may lack its end
PAGE = re.compile(r"<urn:page:(-?\d+)>\Z")


def base32_sha1(value: Column) -> Column:
    """Upper-case base 32 of the SHA-1 digest: four digits for every twenty bits."""
    digest = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(df: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """id, url, payload, digest, payload_bytes and ``first``: for rows that repeat a payload of at least ``min_bytes``
    bytes, the smallest id that has it; NULL for responses."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
        base32_sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    firsts = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").drop("n")
    joined = rows.join(firsts, ["digest", "payload_bytes"], "left")
    return joined.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")))


def records(rows: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One binary column with a whole record, without the line breaks behind it."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    revisit = F.col("first").isNotNull()
    body = F.concat(F.lit(HTTP_HEAD), F.when(revisit, "").otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))), line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"\p{Cntrl}", " "))).otherwise(""),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(body.cast("binary")))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")), line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"),
    )
    return rows.select(F.concat(head, body).cast("binary").alias("record"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for record in batch.column("record"):
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(packer.compress(record.as_py() + b"\r\n\r\n") + packer.flush())
        yield pa.record_batch([pa.array(out, pa.binary())], ["record"])


def write(
    df: DataFrame, id_col: str, url_col: str, payload_col: str, path: str, min_bytes: int = 0, gzip: bool = True,
    records_per_file: int = 2000,
) -> None:
    """Write a record per row. A file holds ``records_per_file`` records at most, so that a reader can hold it."""
    out = records(with_revisits(df, id_col, url_col, payload_col, min_bytes))
    writer = {"maxRecordsPerFile": records_per_file, "encoding": "ISO-8859-1"}
    if gzip:
        out, writer["lineSep"] = out.mapInArrow(_members, "record binary"), EMPTY_MEMBER.decode("latin-1")
    else:
        writer["lineSep"] = "\r\n\r\n"
    out.select(F.col("record").cast("string").alias("value")).write.options(**writer).text(path)


def _digest_fits(stated: str | None, data: bytes) -> bool:
    if stated is None or not stated.lower().startswith("sha1:"):
        return True
    return stated[5:].upper() == base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_at(data: bytes, at: int) -> tuple[dict, bytes, int] | str:
    """Headers, block and end of the record that begins at ``at``, or why there is none."""
    version = VERSION.match(data, at)
    if not version:
        return "no version line"
    end = data.find(b"\r\n\r\n", version.end())
    if end < 0:
        return "header does not end"
    headers = {}
    for line in data[version.end() : end].decode("utf8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return "header line without a colon"
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        return "no length"
    begin, stop = end + 4, end + 4 + int(length)
    if stop > len(data):
        return "record is cut off"
    member = data[stop : stop + 3] == MEMBER
    if not member and data[stop : stop + 4] not in (b"\r\n\r\n", b""):
        return "length does not fit"
    block = data[begin:stop]
    if not _digest_fits(headers.get("warc-block-digest"), block):
        return "block digest differs"
    return headers, block, stop if member else min(stop + 4, len(data))


def _plain(data: bytes) -> Iterator[tuple]:
    """("record", begin, end, headers, block) and ("gap", begin, end, reason) over data that is not compressed."""
    at, n = 0, len(data)
    while at < n:
        found = _record_at(data, at)
        if isinstance(found, str):
            following = VERSION.search(data, at + 1)
            end = following.start() if following else n
            yield "gap", at, end, found
        else:
            headers, block, end = found
            yield "record", at, end, headers, block
        at = end


def _unpack(content: memoryview, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at ``at`` holds, where it ends, and whether it is whole."""
    unpacker, out, fed = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and fed < len(content):
            out.append(unpacker.decompress(content[fed : fed + 65536]))
            fed = min(fed + 65536, len(content))
    except zlib.error:
        return b"".join(out), at, False
    return b"".join(out), fed - len(unpacker.unused_data), unpacker.eof


def _following(content: bytes, view: memoryview, at: int) -> int:
    """Where the next version line, or the next gzip member that begins with one or is empty, stands."""
    version = VERSION.search(content, at)
    end = version.start() if version else len(content)
    member = content.find(MEMBER, at, end)
    while member >= 0:
        inside, _, good = _unpack(view, member)
        if VERSION.match(inside) or (good and not inside):
            return member
        member = content.find(MEMBER, member + 1, end)
    return end


def salvage(content: bytes) -> Iterator[tuple]:
    """("record", begin, end, headers, block) and ("gap", begin, end, reason) of an archive; the bytes are those of
    the file, for a record in a gzip member those of the member."""
    view, at, n = memoryview(content), 0, len(content)
    while at < n:
        if content[at : at + 3] == MEMBER:
            data, end, whole = _unpack(view, at)
            if not whole:
                end = at + 1
                while (end := content.find(MEMBER, end)) >= 0:
                    inside, _, good = _unpack(view, end)
                    if good and (not inside or VERSION.match(inside)):
                        break
                    end += 1
                end = n if end < 0 else end
            for found in _plain(data):
                if found[0] == "record":
                    yield "record", at, end, *found[3:]
                elif whole:
                    yield "gap", at, end, found[3]
            if not whole:
                yield "gap", at, end, "member does not unpack"
            at = end
            continue
        found = _record_at(content, at)
        if isinstance(found, str):
            end = _following(content, view, at + 1)
            yield "gap", at, end, found
        else:
            headers, block, end = found
            yield "record", at, end, headers, block
        at = end


_SCHEMA = (
    "kind string, file string, begin long, end long, reason string, page_id long, url string, record_type string, refers_to long, "
    "payload_digest string, payload_bytes long, payload binary"
)
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def _page(urn: str | None) -> int | None:
    found = PAGE.match(urn or "")
    return int(found[1]) if found else None


def _row(name: str, found: tuple) -> tuple:
    kind, begin, end, *rest = found
    if kind == "gap":
        return kind, name, begin, end, rest[0], *[None] * 7
    headers, block = rest
    head = block.find(b"\r\n\r\n") + 4 if headers.get("content-type", "").startswith("application/http") else 0
    payload, kept = block[head:], headers.get("warc-type")
    if kept != "revisit" and not _digest_fits(headers.get("warc-payload-digest"), payload):
        return "gap", name, begin, end, "payload digest differs", *[None] * 7
    stated = headers.get("warc-payload-digest")
    digest = stated[5:].upper() if stated else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    length = int(headers.get("x-payload-length", 0)) if kept == "revisit" else len(payload)
    ids = _page(headers.get("warc-record-id")), headers.get("warc-target-uri"), kept, _page(headers.get("warc-refers-to"))
    return kind, name, begin, end, None, *ids, digest, length, None if kept == "revisit" else payload


def read(spark: SparkSession, path: str, batch_bytes: int = 8_000_000) -> DataFrame:
    """All records (``kind`` record) and quarantined byte gaps (``kind`` gap) of the archives below ``path``.

    A task holds one archive at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for found in salvage(content.as_py()):
                    rows.append(_row(name, found))
                    size += 500 + len(rows[-1][-1] or b"")
                    if size > batch_bytes:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)
