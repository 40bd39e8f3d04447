"""Operator 2: legacy web archives (ARC, versions 1 and 2) converted to WARC, and readers of both.

An ARC file begins with a version block that names its header fields; each record has one header
line of those fields and as many bytes as its last field declares. The converter parses the lines by
the file's version and synthesises what WARC wants: a record id from the archive's name, the record's
place in it and its content, a date in ISO form, a record type from the scheme and content type, and
block and payload digests. Of responses with equal payloads of at least LEAST bytes one stays, the
others become revisit records that keep the HTTP header alone and name the response's record id, uri
and date; readers find what a revisit refers to by that id.

Files are gzip members, one per record, as archive readers expect; an empty member follows each. A file
ends after about FILE_BYTES, so that readers can hold one.

Edge cases: a null payload is empty; a null url becomes urn:x-page:<id>; white space and control
characters in a url are percent-escaped; a null page_id has no X-Page-Id header and comes back
null; of repeated rows with the winning payload one row is the response and the others revisit
it; an empty table writes no records and reads back empty. Urls and content types of archives may
hold spaces. A date that is cut short means its first moment; one that isn't a date gives way to that of
the archive, and stays beside it as X-Archive-Date. A damaged record raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import common

LEAST = 1000
#: The fields of an ARC header line by version.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: The same as patterns: URL and content type may hold spaces, the fields between them do not.
_ADDRESS, _KIND, _LENGTH = r"(?P<ip>[0-9A-Fa-f.:]+|-) (?P<date>\d{4,14}|-)", r"(?P<kind>\S+(?: \S*[=;]\S*)*)", r"(?P<length>\d+)"
LINES = {1: re.compile(rf"(?P<url>.*?) {_ADDRESS} {_KIND} {_LENGTH}"), 2: re.compile(rf"(?P<url>.*?) {_ADDRESS} {_KIND} (?P<code>\d{{1,3}}|-) (?P<sum>\S+) (?P<to>.*?) (?P<at>\d+) (?P<name>\S+) {_LENGTH}")}
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300000000000000" + "0000")
LEVEL = 3
#: Bytes given to a decompressor at once; what it leaves over is copied, so not the whole file.
STRIDE = 1 << 13
CRLF = b"\r\n"
#: The moment that archives written here name, since a table of pages has none.
CAPTURED = "20200101000000"


def member(data: bytes) -> bytes:
    """One gzip member, without a time of its own."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(content) -> "iter":
    """The plain bytes of each gzip member that isn't empty; a file without gzip is one piece."""
    view = memoryview(content)
    if bytes(view[:2]) != b"\x1f\x8b":
        if len(view):
            yield bytes(view)
        return
    at, end = 0, len(view)
    while at < end:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= end:
                raise ValueError("a gzip member is cut short")
            parts.append(z.decompress(view[at : at + STRIDE]))
            at = min(end, at + STRIDE)
        at -= len(z.unused_data)
        if any(parts):
            yield b"".join(parts)


def safe_url(url: str | None, page_id) -> str:
    if not url:
        return f"urn:x-page:{'none' if page_id is None else page_id}"
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]-._")


def http_block(page_id, payload: bytes) -> bytes:
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    return "\r\n".join(head).encode() + 2 * CRLF + payload


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 spanforge\n{FIELDS[version]}\n\n".encode()
    shared = f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain"
    return (f"{shared} {len(body)}\n" if version == 1 else f"{shared} 200 - - 0 {name} {len(body)}\n").encode() + body


def arc_record(version: int, url: str, block: bytes, name: str, offset: int) -> bytes:
    shared = f"{url} 0.0.0.0 {CAPTURED} text/html"
    line = f"{shared} {len(block)}" if version == 1 else f"{shared} 200 {hashlib.md5(block).hexdigest()} - {offset} {name} {len(block)}"
    return line.encode() + b"\n" + block + b"\n"


def write_arc(pages: DataFrame, path: str, size: int = common.FILE_BYTES) -> None:
    """One record per (page_id, url, html); tasks take version 1 and 2 in turn."""

    def made(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, files = 1 + part % 2, [0]
        name = lambda: f"pages-{part:05d}-{files[0]:05d}.arc"

        def head(k: int) -> bytes:
            files[0] = k
            return member(version_block(version, name()))

        def records():
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    block = http_block(page_id, (html or "").encode("utf-8", "surrogatepass"))
                    yield lambda at, u=safe_url(url, page_id), x=block: member(arc_record(version, u, x, name(), at + len(EMPTY_MEMBER)))

        yield from common.files_of(records(), head, EMPTY_MEMBER, size)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    common.write_blobs(common.map_arrow(rows, made, "data binary"), "data", path, EMPTY_MEMBER)


def parse_arc(content):
    """(archive, url, ip, date, content type, block) of each record after the version block, by the file's version.

    archive: (name, date) as the version block's own line gives them.
    """
    line_of, archive = None, None
    for piece in members(content):
        at = 0
        while at < len(piece):
            end = piece.index(b"\n", at)
            line = piece[at:end].decode("utf-8", "replace")
            length = int(line.rpartition(" ")[2])
            block = piece[end + 1 : end + 1 + length]
            if len(block) != length:
                raise ValueError("an ARC record is shorter than it declares")
            at = end + 1 + length
            while piece[at : at + 1] == b"\n":
                at += 1
            if line.startswith("filedesc://"):
                version = int(block[: block.index(b" ")])
                line_of = LINES[version]
                if block.split(b"\n")[1].decode().strip() != FIELDS[version]:
                    raise ValueError("the version block names other fields")
                own = line_of.fullmatch(line)
                archive = (line.split(" ")[0].removeprefix("filedesc://"), own["date"] if own else CAPTURED)
                continue
            r = line_of.fullmatch(line) if line_of else None
            if r is None:
                raise ValueError("a header line doesn't fit the file's version")
            yield archive, r["url"], r["ip"], r["date"], r["kind"], block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(header with its empty line, payload); no header: all is payload."""
    m = re.search(rb"\r?\n\r?\n", block) if block.startswith(b"HTTP/") else None
    return (block[: m.end()], block[m.end() :]) if m else (b"", block)


def http_field(header: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", header)
    return m[1].decode("latin-1").strip() if m else None


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}"


def iso_date(date: str) -> str | None:
    """The first moment of a date of 4 to 14 digits; None if there is no such date."""
    d = date + "00000101000000"[len(date) :]
    try:
        return datetime.strptime(d, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except ValueError:
        return None


def record_type(url: str, kind: str, header: bytes) -> tuple[str, str]:
    """(WARC type, content type) of a record that isn't a revisit."""
    if header:
        return "response", "application/http; msgtype=response"
    return ("response", "text/dns") if url.startswith("dns:") else ("resource", kind)


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", sha1(block)), ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + CRLF + block + 2 * CRLF


def _scanned(batches, fold):
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield from fold(name, content.as_buffer())


def _chunks(rows, names, kinds, size: int = 256):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _int(x: str | None) -> int | None:
    return int(x) if x is not None else None


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST, size: int = common.FILE_BYTES) -> None:
    """Writes the WARC files of a folder of ARC files.

    A first scan gathers digests; only payloads that occur more than once have an entry in the
    table that says which record stays. A second scan joins that table and writes the records.
    """
    files = common.read_blobs(spark, arc_path)

    def digests(batches):
        def one(_, content):
            for k, (archive, url, _, date, _, block) in enumerate(parse_arc(content)):
                header, payload = split_http(block)
                if len(payload) >= least and header:
                    yield hashlib.sha1(payload).digest(), len(payload), _int(http_field(header, b"X-Page-Id")), archive[0], k, url, iso_date(date) or iso_date(archive[1]) or iso_date(CAPTURED)

        yield from _chunks(_scanned(batches, one), ["digest", "n", "page_id", "file", "k", "url", "date"], [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()], 4096)

    seen = common.map_arrow(files, digests, "digest binary, n long, page_id long, file string, k long, url string, date string")
    best = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("rank"), "file", "k", "url", "date"))
    first = seen.groupBy("digest", "n").agg(F.count(F.lit(1)).alias("copies"), best.alias("best")).where("copies > 1")
    first = common.saved(first.select(F.col("digest").alias("d"), F.col("n").alias("dn"), F.col("best.file").alias("first_file"), F.col("best.k").alias("first_k"), F.col("best.url").alias("first_url"), F.col("best.date").alias("first_date")), "first")

    names = ["file", "k", "url", "ip", "date", "written", "kind", "digest", "n", "block"]

    def records(batches):
        def one(_, content):
            for k, (archive, url, ip, date, kind, block) in enumerate(parse_arc(content)):
                payload = split_http(block)[1]
                own = iso_date(date)
                # packed, since a large table of repeated payloads makes this join a shuffle
                yield archive[0], k, url, ip, own or iso_date(archive[1]) or iso_date(CAPTURED), None if own else date, kind, hashlib.sha1(payload).digest(), len(payload), zlib.compress(block, 1)

        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.binary()]
        yield from _chunks(_scanned(batches, one), names, kinds)

    rows = common.map_arrow(files, records, "file string, k long, url string, ip string, date string, written string, kind string, digest binary, n long, block binary")
    rows = rows.join(first, (rows["digest"] == first["d"]) & (rows["n"] == first["dn"]), "left").select(*names, "first_file", "first_k", "first_url", "first_date")

    def built(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def head(k: int) -> bytes:
            block = b"software: spanforge\r\nformat: WARC File Format 1.0\r\n"
            name = f"records-{part:05d}-{k:05d}.warc.gz"
            return member(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id('warcinfo', name)}>"), ("WARC-Date", iso_date(CAPTURED)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block))

        def of_row(r) -> bytes:
            block = zlib.decompress(r["block"])
            header, _ = split_http(block)
            digest = "sha1:" + base64.b32encode(r["digest"]).decode()
            fields = [("WARC-Record-ID", f"<{record_id(r['file'], r['k'], digest)}>"), ("WARC-Target-URI", r["url"]), ("WARC-Date", r["date"]), ("WARC-Payload-Digest", digest)]
            if r["ip"] != "-":
                fields.append(("WARC-IP-Address", r["ip"]))
            if r["written"] is not None:
                fields.append(("X-Archive-Date", r["written"]))
            if header and r["first_file"] is not None and (r["file"], r["k"]) != (r["first_file"], r["first_k"]):
                kind, content = "revisit", "application/http; msgtype=response"
                fields += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(r['first_file'], r['first_k'], digest)}>"), ("WARC-Refers-To-Target-URI", r["first_url"]), ("WARC-Refers-To-Date", r["first_date"])]
                block = header
            else:
                kind, content = record_type(r["url"], r["kind"], header)
            return member(warc_record([("WARC-Type", kind), *fields, ("Content-Type", content)], block))

        yield from common.files_of((of_row(r) for batch in batches for r in batch.to_pylist()), head, EMPTY_MEMBER, size)

    common.write_blobs(common.map_arrow(rows, built, "data binary"), "data", warc_path, EMPTY_MEMBER)


def parse_warc(content):
    """(fields with lower-case names, block) of each record; digests and lengths are checked."""
    for piece in members(content):
        at = 0
        while at < len(piece):
            if not piece.startswith(b"WARC/", at):
                raise ValueError("not a WARC record")
            end = piece.index(2 * CRLF, at)
            lines = piece[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = int(fields["content-length"])
            block = piece[end + 4 : end + 4 + length]
            at = end + 4 + length
            if len(block) != length or piece[at : at + 4] != 2 * CRLF:
                raise ValueError("a WARC record is shorter than it declares")
            at += 4
            if "warc-block-digest" in fields and fields["warc-block-digest"] != sha1(block):
                raise ValueError("a block's digest differs")
            yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date) of all but warcinfo records.

    A response's digest is taken from the payload read, and must be the one declared; a revisit's
    digest and length are those that its own headers declare for the full payload, and refers_to is the
    page of the response that has the record id which the revisit names.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "target", "record_id", "url", "date"]

    def rows(batches):
        def one(_, content):
            for fields, block in parse_warc(content):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                header, payload = split_http(block)
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind == "revisit":
                    size = int(http_field(header, b"Content-Length"))
                else:
                    size = len(payload)
                    if hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError("a payload's digest differs")
                yield _int(http_field(header, b"X-Page-Id")), size, digest, kind, fields["warc-refers-to"].strip("<>") if kind == "revisit" else None, fields["warc-record-id"].strip("<>"), fields["warc-target-uri"], fields["warc-date"]

        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 6]
        yield from _chunks(_scanned(batches, one), names, kinds, 4096)

    read = common.map_arrow(common.read_blobs(spark, path), rows, "page_id long, payload_bytes long, payload_digest string, record_type string, target string, record_id string, url string, date string")
    read = common.saved(read, "records")  # one scan of the archives
    wanted = read.where("target is not null").select(F.col("target").alias("t")).distinct()
    found = read.where("record_type <> 'revisit'").join(wanted, F.col("record_id") == F.col("t"), "left_semi")
    found = common.saved(found.select(F.col("record_id").alias("found_id"), F.col("page_id").alias("refers_to")), "targets")
    return read.join(found, read["target"] == found["found_id"], "left").select(*names[:4], "refers_to", *names[5:])
