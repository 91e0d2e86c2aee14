"""Legacy archives: ARC records parsed and converted to WARC.

An ARC file is a row of records: a header line, the declared number of bytes, a
line end. Its first record (``filedesc:``) names the version, and with it the
fields of the header lines:

* 1: URL, IP address, archive date, content type, length
* 2: URL, IP address, archive date, content type, result code, checksum,
  location, offset, file name, length

A WARC record takes over URL, address, date and block; its identifier is made
of the archive's name and the record's offset, so that a second conversion
gives the same; types are ``warcinfo`` for the first record, ``response`` for
HTTP, ``resource`` for others, ``revisit`` for a payload that another record
holds. Digests are SHA-1 in base 32. WARC files hold a gzip member a record, and
any number of members is read. Archives that break off or don't parse give the
records before the fault and a row that tells it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import fields, salted_join, scratch, small_batches

# Fixed values of the two formats.
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
HEADINGS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS_PER_FILE = 2000
#: Compressed bytes that are inflated at a time; bytes that a record's header may have.
PIECE = 1 << 16
HEADER = 1 << 20
#: What stands between the members of two records: a member of nothing, as Spark's text writer separates lines by something.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


@dataclass
class ArcRecord:
    offset: int
    version: int
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block after an HTTP header; all of another block."""
        if not self.block.startswith(b"HTTP/"):
            return self.block
        for end in (b"\r\n\r\n", b"\n\n"):
            if end in self.block:
                return self.block.partition(end)[2]
        return b""


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file's bytes, by declared length. Raises ValueError on a header line that doesn't fit its version or a record cut short."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no line end after the header at byte {at}")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not version:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("the first record is no version block")
            about = data[end + 1 : end + 3].split()
            if not about or about[0] not in (b"1", b"2"):
                raise ValueError(f"unknown version {about[:1]}")
            version = int(about[0])
            names = FIELDS[version if len(parts) == len(FIELDS[version]) else 1]
        else:
            names = FIELDS[version]
        if len(parts) < len(names):
            raise ValueError(f"{len(parts)} fields in the header at byte {at}, version {version} has {len(names)}")
        # Only a URL can hold spaces, so fields count from the right.
        rest = parts[len(parts) - len(names) + 1 :]
        got = dict(zip(names[1:], rest), url=" ".join(parts[: len(parts) - len(names) + 1]))
        length = int(got["length"])
        if length < 0 or end + 1 + length > len(data):
            raise ValueError(f"the record at byte {at} declares {length} bytes, {len(data) - end - 1} are left")
        yield ArcRecord(at, version, got["url"], got["ip"], got["date"], got["content_type"], data[end + 1 : end + 1 + length])
        at = end + 1 + length


def arc_bytes(records: Iterable[tuple[str, str, str, str, bytes]], version: int = 1, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, ip, date, content type, block) records."""
    about = f"{version} 0 tidewater\n{HEADINGS[version]}\n".encode()
    first = f"filedesc://{name} 0.0.0.0 20240101000000 text/plain"
    first += " 200 - - 0 " + name if version == 2 else ""
    out, at = [f"{first} {len(about)}\n".encode() + about + b"\n"], 0
    at = len(out[0])
    for url, ip, date, kind, block in records:
        head = f"{url} {ip} {date} {kind}" + (f" 200 - - {at} {name}" if version == 2 else "")
        out.append(f"{head} {len(block)}\n".encode("utf-8", "surrogatepass") + block + b"\n")
        at += len(out[-1])
    return b"".join(out)


def inflate(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file, member after member, or of a plain one, in pieces. Raises ValueError on a broken one."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at, view = 0, memoryview(content)
    while at < len(content):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(content):
                raise ValueError("the last gzip member is cut short")
            piece = view[at : at + PIECE]
            try:
                out = member.decompress(piece)
            except zlib.error as e:
                raise ValueError(f"gzip member near byte {at}: {e}") from None
            at += len(piece) - len(member.unused_data)
            if out:
                yield out
        while at < len(content) and not content[at]:  # padding
            at += 1


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date: str) -> str:
    """14 digits (shorter ones end early) as an ISO date; what is no date becomes the epoch."""
    d = date if date.isdigit() and 4 <= len(date) <= 14 else "19700101000000"
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


CONVERTED = "record_id string, record_type string, uri string, ip string, date string, content_type string, payload_bytes long, payload_digest string, block_digest string, block binary, error string"


def convert(archives: DataFrame, path_col: str = "path", content_col: str = "content", keep: tuple[str, ...] = (), version_blocks: bool = True) -> DataFrame:
    """WARC records of ARC files, one row a record: ``keep``, then the columns of ``CONVERTED``.

    ``path`` is the archive's name (null: empty), ``content`` its bytes, gzipped
    or not (null or empty: no records). Equal archives under equal names give
    equal identifiers, as they are the same records. What follows a fault in an
    archive is lost; a row with an ``error``, null but for ``keep``, tells it.
    """
    small_batches(archives.sparkSession)
    src = archives.select(*keep, F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("_path"), F.col(content_col).alias("_content"))
    names = [x.split(" ")[0] for x in CONVERTED.split(", ")]

    def records(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for r in parse_arc(b"".join(inflate(content))):
                first = r.url.startswith("filedesc:")
                if first and not version_blocks:
                    continue
                http = r.block.startswith(b"HTTP/")
                kind = "warcinfo" if first else "response" if http else "resource"
                rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{r.offset}')}>"
                media = "application/http; msgtype=response" if http else r.content_type
                payload = r.payload
                yield rid, kind, r.url, r.ip, warc_date(r.date), media, len(payload), digest(payload), digest(r.block), r.block, None
        except ValueError as e:
            yield *[None] * (len(names) - 1), f"{path}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], []
            for i, (path, content) in enumerate(zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist())):
                rows += records(path, content or b"")
                at += [i] * (len(rows) - len(at))
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "block" else pa.string() for n in names]
            kept = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, kinds))], [*keep, *names])

    return src.mapInArrow(run, ", ".join([*([fields(src, *keep)] if keep else []), CONVERTED]))


def header_block(block: Column) -> Column:
    """What a revisit record keeps of an HTTP block: its header."""
    end = F.locate("\r\n\r\n", block.cast("string"))
    text = block.cast("string")
    return F.when(end > 0, F.substring(text, F.lit(1), end + 3)).otherwise(F.lit(""))


def refer(records: DataFrame, order: str) -> DataFrame:
    """``records`` with ``refers_to`` and ``refers_record``, ``refers_uri``, ``refers_date``.

    They are the ``order``, identifier, URI and date of the record with the
    largest ``order`` of those with an equal payload digest, if that is larger
    than the record's own; else null. Digests gather in partial aggregations;
    then each record finds its digest, if several share it, in a salted join, so
    a payload that a third of the records share is no task of its own. Of records
    that tie on digest and order each stays a response.
    """
    last = F.max(F.struct(F.col(order).alias("at"), "record_id", "uri", "date")).alias("_last")
    several = records.where("payload_digest is not null").groupBy("payload_digest").agg(last, F.count("*").alias("n")).where("n > 1").drop("n")
    got = salted_join(records, several, "payload_digest", "left")
    for name, field in (("refers_to", "at"), ("refers_record", "record_id"), ("refers_uri", "uri"), ("refers_date", "date")):
        got = got.withColumn(name, F.when(F.col("_last.at") > F.col(order), F.col(f"_last.{field}")))
    return got.drop("_last")


def write_warc(records: DataFrame, path: str, extra: tuple[str, ...] = (), per_file: int = RECORDS_PER_FILE) -> None:
    """Write records (columns of ``CONVERTED`` and ``refers_to``, and what else ``refer`` adds) as WARC 1.1 files of at most ``per_file`` records, a gzip member each.

    ``extra`` columns become ``WARC-X-`` headers; error rows are left out.
    Spark's text writer makes the files, so any file system it knows will do;
    bytes pass through unchanged.
    """
    records = records.where("error is null")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]", " "), F.lit("\r\n")), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, header_block(F.col("block"))).otherwise(F.col("block").cast("string"))
    origin = (("WARC-Refers-To", "refers_record"), ("WARC-Refers-To-Target-URI", "refers_uri"), ("WARC-Refers-To-Date", "refers_date"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("record_type"))),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.when(F.col("record_type") != "warcinfo", F.col("uri"))),
        line("WARC-IP-Address", F.when(F.col("ip") != "0.0.0.0", F.col("ip"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.when(~revisit, F.concat(F.lit("sha1:"), F.col("block_digest")))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        *[line(name, F.col(c)) for name, c in origin if c in records.columns],
        line("WARC-X-Payload-Length", F.col("payload_bytes")),
        line("WARC-X-Refers-To", F.col("refers_to")),
        *[line(f"WARC-X-{x}", F.col(x)) for x in extra],
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r\n"),
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x, 6, mtime=0) for x in b.column(0).to_pylist()], pa.binary())], ["value"])

    small_batches(records.sparkSession)
    packed = records.select(head.cast("binary").alias("value")).mapInArrow(members, "value binary")
    as_lines = packed.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    as_lines.option("maxRecordsPerFile", per_file).text(path)


def parse_warc(data: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, by declared length; ``data`` in one or in pieces, of which one record is held."""
    pieces, held, at = iter([data] if isinstance(data, bytes) else data), bytearray(), 0

    def have(test: Callable[[], bool]) -> bool:
        while not test():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while have(lambda: len(held) > 1) and held[:2] == b"\r\n":
            del held[:2]
            at += 2
        if not held:
            return
        if not have(lambda: len(held) > 4) or not held.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        if not have(lambda: b"\r\n\r\n" in held or len(held) > HEADER) or (end := held.find(b"\r\n\r\n")) < 0:
            raise ValueError(f"no end of the header of the record at byte {at}")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        length = head.get("content-length", "")
        if not length.isdecimal():
            raise ValueError(f"the record at byte {at} declares no length")
        size = end + 4 + int(length)
        if not have(lambda: len(held) >= size):
            raise ValueError(f"the record at byte {at} is cut short")
        yield head, bytes(held[end + 4 : size])
        del held[:size]
        at += size


def read_warc(df_files: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of gzipped or plain WARC files (``content`` as of the binaryFile source), record by record.

    ``columns`` maps header names to column names, as strings; ``block_bytes``,
    ``held_bytes`` and ``held_digest`` are those of the block and the payload
    that the file holds. A file with a fault gives the records before it and a
    row that tells it in ``error``.
    """
    names = [*columns.values(), "block_bytes", "held_bytes", "held_digest", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = []
                try:
                    for head, block in parse_warc(inflate(content or b"")):
                        payload = ArcRecord(0, 1, "", "", "", "", block).payload
                        rows.append((*(head.get(k.lower()) for k in columns), len(block), len(payload), digest(payload), None))
                except ValueError as e:
                    rows.append((*[None] * (len(names) - 1), str(e)))
                cols = list(zip(*rows)) if rows else [[] for _ in names]
                kinds = [*[pa.string()] * len(columns), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    schema = ", ".join([*(f"`{c}` string" for c in columns.values()), "block_bytes long, held_bytes long, held_digest string, error string"])
    return df_files.select("content").mapInArrow(run, schema)


def pages_as_arc(pages: DataFrame) -> DataFrame:
    """``(page_id, path, content)``: each page as an ARC file of its own, of version 1 or 2 by turns; payload the html, null: empty."""
    small_batches(pages.sparkSession)
    src = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, url, html in zip(*(b.column(k).to_pylist() for k in range(3))):
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode()
                out.append(arc_bytes([((url or "unknown:").replace("\n", "%0A").replace("\r", "%0D"), "192.0.2.1", "20240102030405", "text/html", block)], 1 + (i or 0) % 2, f"page-{i}.arc"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"page-{i}.arc" for i in b.column(0).to_pylist()]), pa.array(out, pa.binary())], ["page_id", "path", "content"])

    return src.mapInArrow(run, f"{fields(src, 'page_id')}, path string, content binary")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages through ARC to WARC files in the shared folder and back: one row a page as the archives have it.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``. Of
    equal payloads, empty ones too, that of the largest page_id is the response.
    Null html is an empty payload, a null url a placeholder URI. Pages without
    id are responses and nobody refers to them; so do pages that repeat an id
    with an equal payload stay responses each. No pages: no archives, no rows.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    records = convert(pages_as_arc(pages), keep=("page_id",), version_blocks=False)
    write_warc(refer(records, "page_id"), path := scratch(spark, "warc"), ("page_id",))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    back = read_warc(files, {"WARC-Type": "record_type", "WARC-X-page_id": "page_id", "WARC-X-Refers-To": "refers_to", "WARC-X-Payload-Length": "payload_bytes", "WARC-Payload-Digest": "payload_digest"})
    return back.select(
        F.when(F.col("error").isNotNull(), F.raise_error("error")).otherwise(F.col("page_id").cast(kind)).alias("page_id"),
        F.when(F.col("record_type") == "revisit", F.col("payload_bytes").cast("long")).otherwise(F.col("held_bytes")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.expr("substring(payload_digest, 6)")).otherwise(F.col("held_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
