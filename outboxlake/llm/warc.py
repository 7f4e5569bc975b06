"""Legacy web archives (ARC versions 1 and 2) converted to WARC.

`write_arc` writes captures as gzipped ARC files, `read_arc` parses such files by the header
line of their version and the declared lengths, `to_warc` turns the captures into WARC
records with identifiers, ISO timestamps, types and SHA-1 digests of block and payload, and
`read_warc` reads WARC files back. Archives are written by Spark's text writer with the
record separator of the format, so any file system Spark knows will do, and a file is as
large as an input split. A file is read as one value of at most 2 GB and parsed a record at a
time; payloads stay bytes throughout, so images and the like come through.

Addresses and media types in header lines may hold spaces. A record that cannot be read (a
line that is no header, a wrong date, a missing end, broken compression) raises, or, where a
path for rejects is given, is written there with its file, offset and problem while reading
goes on at the next header line.

Of captures with equal payloads of at least 1000 bytes, the one with the largest page id is
a response and the others are revisits of it; captures of equal, largest id are all
responses. A revisit keeps its HTTP header and leaves the payload out. A null id counts as
smaller than all; a group of null ids only is all responses. Null html is empty; a null or
empty address becomes `urn:page`, and white space in addresses is escaped. Extra columns are
ignored, an empty table gives empty archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outboxlake.llm import bytescan as bs
from outboxlake.llm.store import prepare
from outboxlake.session import fresh_path

SMALLEST = 1000
BATCH_BYTES = 8 << 20

#: The fields of a header line by version.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: What the values of a header line look like, if not free of spaces.
_SHAPES = {"URL": r"(.*)", "Archive-date": r"(\d{14})", "Content-type": r"(.*)", "Archive-length": r"(\d+)"}
_LINES = {version: re.compile(" ".join(_SHAPES.get(f, r"(\S+)") for f in fields), re.ASCII) for version, fields in FIELDS.items()}
_PAGE = "urn:page:"
_START = datetime(2024, 1, 1, tzinfo=UTC)


def _arc_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    version, name, opened = 1 + part % 2, f"part-{part:05d}.arc.gz", False
    for piece in bs.pieces(batches, "html", BATCH_BYTES):
        out = []
        if not opened:
            opened = True
            about = f"{version} 0 pages\n{' '.join(FIELDS[version])}\n"
            out.append(f"{_arc_header(1, f'filedesc://{name}', _START, 'text/plain', name, len(about))}\n{about}")
        for page_id, url, html in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            html = html or ""
            size = len(html.encode())
            page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {size}\r\n\r\n"
            when = _START + timedelta(seconds=(page_id or 0) % 31_536_000)
            address = _address(url or "") or "urn:page"
            out.append(f"{_arc_header(version, address, when, 'text/html', name, len(http) + size)}\n{http}{html}")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def _address(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _arc_header(version: int, url: str, when: datetime, kind: str, name: str, length: int) -> str:
    known = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": f"{when:%Y%m%d%H%M%S}", "Content-type": kind, "Result-code": "200"}
    known |= {"Filename": name, "Archive-length": str(length)}
    return " ".join(known.get(field, "-") for field in FIELDS[version])


def write_arc(pages: DataFrame, path: str) -> None:
    """Writes `pages` (page_id, url, html) as ARC files; odd splits use version 2."""
    prepare(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    lines = pages.mapInArrow(_arc_lines, "value string")
    lines.write.option("compression", "gzip").option("lineSep", "\n").text(path)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, io.BufferedReader]]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            raw = content.as_buffer()
            data = pa.BufferReader(raw)
            if raw[:2].to_pybytes() == b"\x1f\x8b":
                data = gzip.GzipFile(fileobj=data)
            yield path.as_py(), io.BufferedReader(data, 1 << 20)


def _exactly(stream: io.BufferedReader, length: int, path: str) -> bytes:
    block = stream.read(length)
    if len(block) != length:
        raise ValueError(f"{path}: a record declares {length} bytes and has {len(block)}")
    return block


#: A record that could not be read: its offset in the (unpacked) file and why.
Broken = tuple[int, str]


def arc_records(stream: io.BufferedReader, path: str, broken: list[Broken] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record; the first record names the version of the rest.

    Records that cannot be read are added to `broken`, or raise ValueError where it is None.
    """

    def fail(at: int, problem: str) -> None:
        if broken is None:
            raise ValueError(f"{path}: {problem} at byte {at}")
        broken.append((at, problem))

    version, first, offset, lost = 1, True, 0, False
    try:
        while line := stream.readline():
            at, offset = offset, offset + len(line)
            if line in (b"\n", b"\r\n"):
                continue
            # The first line has the version-1 shape whatever the version.
            found = _LINES[version].fullmatch(line.decode("utf-8", "replace").rstrip("\r\n"))
            if not found:
                if not lost:
                    fail(at, f"a line that is no header of version {version}")
                lost = True
                continue
            lost = False
            header = dict(zip(FIELDS[version], found.groups(), strict=True))
            length = int(header["Archive-length"])
            block = stream.read(length)
            offset += len(block)
            if len(block) != length:
                fail(at, f"a record declares {length} bytes and has {len(block)}")
                return
            try:
                datetime.strptime(header["Archive-date"], "%Y%m%d%H%M%S")
            except ValueError:
                fail(at, f"the date {header['Archive-date']}")
                continue
            yield header, block
            if first:
                first, own = False, block.split(b" ", 1)[0].strip()
                if own.isdigit() and int(own) in FIELDS:
                    version = int(own)
                else:
                    fail(at, f"ARC version {own[:20]!r} is not known")
    except (EOFError, OSError, zlib.error) as error:
        fail(offset, f"broken compression ({error})")


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """HTTP header with its empty line, payload, and header values by lower-case name."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    end = block.find(b"\r\n\r\n")
    head, payload = (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")
    values = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return head, payload, {k.strip().lower(): v.strip() for k, _, v in values}


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


_CAPTURES = pa.schema(
    [
        ("archive", pa.string()),
        ("position", pa.int64()),
        ("uri", pa.string()),
        ("ip", pa.string()),
        ("date", pa.string()),
        ("kind", pa.string()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha1", pa.string()),
        ("block_sha1", pa.string()),
        ("head_sha1", pa.string()),
        ("head", pa.binary()),
        ("payload", pa.binary()),
    ]
)
_TYPES = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
_CAPTURES_DDL = ", ".join(f"{f.name} {_TYPES[f.type]}" for f in _CAPTURES)


def _parse_arc(strict: bool):
    return lambda batches: _captures(batches, strict)


def _captures(batches: Iterator[pa.RecordBatch], strict: bool) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for path, stream in _streams(batches):
        for k, (header, block) in enumerate(arc_records(stream, path, None if strict else [])):
            about = header["URL"].startswith("filedesc:")
            head, payload, values = (b"", block, {}) if about else http_parts(block)
            date = datetime.strptime(header["Archive-date"], "%Y%m%d%H%M%S")
            rows.append(
                (
                    path,
                    k,
                    _address(header["URL"]),
                    header["IP-address"],
                    f"{date:%Y-%m-%dT%H:%M:%SZ}",
                    "warcinfo" if about else "response",
                    _number(values.get("x-page-id")),
                    len(payload),
                    *(hashlib.sha1(x).hexdigest() for x in (payload, block, head)),
                    head,
                    payload,
                )
            )
            held += len(block)
            if held > BATCH_BYTES:
                yield bs.batch_of(_CAPTURES, *([r[c] for r in rows] for c in range(len(_CAPTURES))))
                rows, held = [], 0
    if rows:
        yield bs.batch_of(_CAPTURES, *([r[c] for r in rows] for c in range(len(_CAPTURES))))


_REJECTS = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("problem", pa.string())])


def _broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, stream in _streams(batches):
        broken: list[Broken] = []
        for _ in arc_records(stream, path, broken):
            pass
        if broken:
            yield bs.batch_of(_REJECTS, [path] * len(broken), [b[0] for b in broken], [b[1] for b in broken])


def _files(spark: SparkSession, path: str) -> DataFrame:
    # Spark's own files start with an underscore or a dot.
    return spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, rejects: str | None = None) -> DataFrame:
    """One row per record: address, time, payload and digests (hex SHA-1).

    With a path for `rejects`, records that cannot be read are written there as Parquet
    (archive, offset, problem) by a pass of its own; without one they raise.
    """
    files = _files(prepare(spark), path)
    if rejects is not None:
        files.mapInArrow(_broken, "archive string, offset long, problem string").write.parquet(rejects)
    return files.mapInArrow(_parse_arc(rejects is None), _CAPTURES_DDL)


def with_revisits(captures: DataFrame) -> DataFrame:
    """Adds `lead`, the page id of the response that a capture revisits, or null."""
    large = captures.where(f"kind = 'response' and payload_bytes >= {SMALLEST}")
    # Copies combine before the shuffle; only payloads that repeat come back.
    leads = large.groupBy("payload_sha1", "payload_bytes").agg(F.max("page_id").alias("lead"), F.count("*").alias("n"))
    leads = leads.where("n > 1 and lead is not null").drop("n")
    found = captures.join(leads, ["payload_sha1", "payload_bytes"], "left")
    same = F.col("page_id").eqNullSafe(F.col("lead")) | (F.col("kind") != "response")
    return found.withColumn("lead", F.when(~same, F.col("lead")))


def _digest(column: str) -> Column:
    return F.concat(F.lit("sha1:"), F.col(column))


def _identity(page: Column, other: Column) -> Column:
    named = F.concat(F.lit(f"<{_PAGE}"), page.cast("string"), F.lit(">"))
    return F.coalesce(named, F.concat(F.lit("<urn:md5:"), F.md5(other), F.lit(">")))


def warc_lines(captures: DataFrame) -> DataFrame:
    """The WARC record of each capture, without the closing empty lines."""
    revisit = F.col("lead").isNotNull()
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.col("kind"))
    block = F.concat("head", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    about = F.col("kind") == "warcinfo"
    media = F.when(about, F.lit("application/arc-fields")).when(F.length("head") == 0, F.lit("text/html"))
    media = media.otherwise(F.lit("application/http; msgtype=response"))
    own = F.concat_ws(" ", F.regexp_extract("archive", "[^/]+$", 0), F.col("position").cast("string"))
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _identity(F.col("page_id"), own)),
        ("WARC-Date", F.col("date")),
        ("WARC-Target-URI", F.when(~about, F.col("uri"))),
        ("WARC-Filename", F.when(about, F.col("uri"))),
        ("WARC-IP-Address", F.when(~about & (F.col("ip") != "0.0.0.0"), F.col("ip"))),
        ("WARC-Refers-To", F.when(revisit, _identity(F.col("lead"), own))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Payload-Digest", F.when(~about, _digest("payload_sha1"))),
        ("WARC-Block-Digest", F.when(revisit, _digest("head_sha1")).otherwise(_digest("block_sha1"))),
        ("Content-Type", media),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    lines = F.concat_ws("\r\n", F.lit("WARC/1.1"), *(F.concat(F.lit(f"{name}: "), value) for name, value in fields))
    # The text writer writes a string's bytes as they are, valid UTF-8 or not.
    whole = F.concat(F.concat(lines, F.lit("\r\n\r\n")).cast("binary"), block)
    return captures.select(whole.cast("string").alias("value"))


def write_warc(captures: DataFrame, path: str) -> None:
    warc_lines(captures).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def to_warc(spark: SparkSession, arc_path: str, warc_path: str, rejects: str | None = None) -> None:
    """Converts a folder of ARC files to one of WARC files; for `rejects` see `read_arc`."""
    write_warc(with_revisits(read_arc(spark, arc_path, rejects)), warc_path)


def warc_records(stream: io.BufferedReader, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by lower-case name and block of every record."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"{path}: a record starts with {line[:40]!r}")
        header = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            header[name.strip().lower()] = value.strip()
        yield header, _exactly(stream, int(header["content-length"]), path)


def _hex(digest: str) -> str:
    """The SHA-1 of a digest header, which may be written in hex or in base 32."""
    value = digest.partition(":")[2]
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


_PAGES = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("date", pa.string())]
)
_PAGES_DDL = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in _PAGES)


def _parse_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for path, stream in _streams(batches):
        for header, block in warc_records(stream, path):
            if header["warc-type"] not in ("response", "revisit"):
                continue
            _, payload, values = http_parts(block)
            revisit = header["warc-type"] == "revisit"
            digest = _hex(header["warc-payload-digest"])
            if not revisit and digest != hashlib.sha1(payload).hexdigest():
                raise ValueError(f"{path}: the payload of {header['warc-record-id']} does not have its digest")
            size = int(values.get("content-length", 0)) if revisit else len(payload)
            refers = header.get("warc-refers-to", "").strip("<>").removeprefix(_PAGE)
            row = (_number(values.get("x-page-id")), size, digest, header["warc-type"], _number(refers), header.get("warc-target-uri"), header.get("warc-date"))
            rows.append(row)
            if len(rows) >= 10_000:
                yield bs.batch_of(_PAGES, *([r[c] for r in rows] for c in range(len(_PAGES))))
                rows = []
    if rows:
        yield bs.batch_of(_PAGES, *([r[c] for r in rows] for c in range(len(_PAGES))))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit: page, payload size and digest, type, referred page."""
    return _files(prepare(spark), path).mapInArrow(_parse_warc, _PAGES_DDL)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages through ARC and WARC archives in the shared folder, as read back from the latter."""
    spark = pages.sparkSession
    arc, archive = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc)
    to_warc(spark, arc, archive)
    return read_warc(spark, archive)
