"""Legacy archive converter: ARC files of version 1 and 2 become WARC files.

The version block at the head of an ARC file names its header line's fields; each record is such a line and as many
bytes as the line declares. From these the converter makes the WARC record's identifier, date, type and digests. It
reads any such archive, gzipped or not: an identifier comes from the archive's name and the record's place in it, so no
two are equal; HTTP answers become responses and other contents resources; a malformed header line is reported and the
records after it are read, and a record that ends early is reported.

Defined results: equal payloads of at least 100 bytes are kept once, as the response with the smallest page_id, and the
others are revisits that refer to it; repeated rows of that page_id are responses too; rows without page_id never are
the one referred to; a null html is an empty payload, a null url has the URI urn:page:<id>; no pages, no rows."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_rows, pieces, utf8

#: Fields of a record's header line, by version. Fixed values of the format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
LEAST_DUPLICATE = 100
#: Records in a file: a file is read back by one task.
RECORDS_PER_FILE = 2048


def arc_archive(version: int, records: Iterable[tuple[str, str, str, bytes]], name: str = "pages.arc") -> bytes:
    """An ARC file from (url, date of 14 digits, content type, content)."""
    fields = ARC_FIELDS[version]
    about = f"{version} 0 readloom\n{' '.join(fields)}\n\n".encode()
    values = {"IP-address": "0.0.0.0", "Result-code": "200", "Checksum": "-", "Location": "-", "Filename": name}
    out = io.BytesIO()
    for url, date, kind, content in [(f"filedesc://{name}", "20000101000000", "text/plain", about), *records]:
        values |= {"URL": url, "Archive-date": date, "Content-type": kind, "Offset": str(out.tell()), "Archive-length": str(len(content))}
        # the version block's own line has version 1's fields in either version
        names = ARC_FIELDS[1] if content is about else fields
        out.write(" ".join(values[f] for f in names).encode() + b"\n" + content + b"\n")
    return out.getvalue()


def arc_header(line: bytes, fields: list[str]) -> dict[str, str] | None:
    """A record's header fields, or None if the line is none."""
    parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    # a URL may hold blanks in old files: the other fields are counted from the right
    extra = len(parts) - len(fields)
    if extra < 0:
        return None
    got = dict(zip(fields, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]], strict=True))
    date, length = got.get("Archive-date", ""), got.get("Archive-length", "")
    return got if date.isascii() and date.isdigit() and 8 <= len(date) <= 14 and length.isascii() and length.isdigit() else None


def arc_records(stream) -> Iterator[tuple[int, dict[str, str] | None, bytes]]:
    """Place, header fields and content of each record after the version block; without fields, the content says what
    is wrong there."""
    fields, head, lost = ARC_FIELDS[1], True, False
    while True:
        at = stream.tell()
        line = stream.readline(1 << 20)
        if not line:
            return
        if not line.strip():
            continue
        got = arc_header(line, fields)
        if got is None:
            if not lost:  # once for all lines up to the next header
                yield at, None, b"not a header line: " + line[:100].rstrip()
            lost = True
            continue
        lost, length = False, int(got["Archive-length"])
        content = stream.read(length)
        if len(content) != length:
            yield at, None, f"{len(content)} of {length} bytes declared".encode()
            return
        if head:
            head = False
            if got["URL"].startswith("filedesc:"):
                version, _, names = content.partition(b"\n")
                number = version.split()[:1]
                fields = names.split(b"\n")[0].decode("utf-8", "replace").split() or ARC_FIELDS.get(int(number[0]) if number and number[0].isdigit() else 1, ARC_FIELDS[1])
                continue
        yield at, got, content


def record_id(archive: str, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{at}')}>"


def parts_of(content: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head, payload and header fields of an HTTP answer; other contents are payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content, {}
    cut = min((i, len(x)) for x in (b"\r\n\r\n", b"\n\n") if (i := content.find(x)) >= 0) if b"\n\n" in content or b"\r\n\r\n" in content else (len(content), 0)
    head, payload = content[: sum(cut)], content[sum(cut) :]
    lines = (x.partition(":") for x in head.decode("utf-8", "replace").splitlines()[1:])
    return head, payload, {k.strip(): v.strip() for k, c, v in lines if c}


def warc_record(arc: dict[str, str], content: bytes, id_: str, first: int | None = None) -> bytes:
    """The WARC record for an ARC record, without its last line feed; first: the page to which a revisit refers."""
    d = arc["Archive-date"].ljust(8, "0").ljust(14, "0")
    head, payload, _ = parts_of(content)
    kind = "revisit" if first is not None else "response" if head else "resource"
    block = head if kind == "revisit" else content
    lines = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {id_}", f"WARC-Target-URI: {arc['URL']}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", f"WARC-IP-Address: {arc.get('IP-address', '0.0.0.0')}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Type: {'application/http; msgtype=response' if head else arc.get('Content-type', 'application/octet-stream')}", f"Content-Length: {len(block)}",
    ]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"Refers-To-Page: {first}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r"


def converted(data: bytes, archive: str) -> Iterator[tuple[bytes | None, str | None]]:
    """The WARC records of an ARC file of any origin, each with its last line feed, or what is wrong in its place."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    for at, fields, content in arc_records(io.BytesIO(data)):
        if fields is None:
            yield None, f"{archive}, byte {at}: {content.decode('utf-8', 'replace')}"
        else:
            yield warc_record(fields, content, record_id(archive, at)) + b"\n", None


def convert_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, record, error: the ARC files of a folder, one task a file, converted; a bad record has an error instead."""

    def rows(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                for record, error in converted(content, name):
                    yield name, record, error

    return map_rows(spark.read.format("binaryFile").load(path).select("path", "content"), "archive string, record binary, error string", rows, 64)


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().strip()) != b"":
            k, _, v = line.decode("utf-8", "replace").partition(": ")
            fields[k] = v
        block = stream.read(int(fields["Content-Length"]))
        yield fields, block


def with_refers(pages: DataFrame) -> DataFrame:
    """page_id, url, html, first: the page whose equal payload is kept instead, else null."""
    p = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    firsts = p.where(F.col("n") >= LEAST_DUPLICATE).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("sha", "first")
    # only digests that repeat are joined; a hot one is a skewed join, which adaptive execution splits
    return p.join(firsts, "sha", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def convert(pages: DataFrame, batch: int = 256) -> DataFrame:
    """A column, record: pages as legacy ARC files (version 1 and 2 by turns), converted."""

    def run(batches):
        made, task = 0, TaskContext.get().partitionId()
        for big in pieces(batches):
            for at in range(0, big.num_rows, batch):
                b = big.slice(at, batch).to_pydict()
                made += 1
                rows = list(zip(b["page_id"], b["url"], b["html"], b["first"], strict=True))
                out = []
                for version in (1, 2):
                    part = rows[version - 1 :: 2]
                    sources = []
                    for page, url, html, _ in part:
                        body = utf8(html)
                        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {page}\r\n\r\n"
                        sources.append((quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page}", "20000101000000", "text/html", head.encode() + body))
                    name = f"pages-{task}-{made}-{version}.arc"
                    parsed = arc_records(io.BytesIO(arc_archive(version, sources, name)))
                    out += [warc_record(fields, content, record_id(name, place), first) for (place, fields, content), (*_, first) in zip(parsed, part, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return pages.mapInArrow(run, "record binary")


def write(pages: DataFrame, path: str) -> None:
    """WARC files, gzipped, in a folder that Spark reaches. A record ends with the writer's line feed."""
    records = convert(with_refers(pages)).select(F.col("record").cast("string"))
    records.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from a folder of WARC files."""

    def rows(batches):
        for b in batches:
            for content in b["content"]:
                for f, block in warc_records(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    _, payload, http = parts_of(block)
                    page = None if http.get("X-Page-Id", "None") == "None" else int(http["X-Page-Id"])
                    if f["WARC-Type"] != "revisit":
                        yield page, len(payload), hashlib.sha256(payload).hexdigest(), "response", None
                    else:
                        yield page, int(http["Content-Length"]), f["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", int(f["Refers-To-Page"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return map_rows(files, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint", rows)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages as WARC files into the shared folder and reads them back."""
    scratch = Scratch(spark, "warc")
    write(pages, scratch.path("files"))
    return read(spark, scratch.path("files"))
