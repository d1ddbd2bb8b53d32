r"""WARC archives: writing pages as segmented records, reading them back whole.

**Writing.** A page is a ``response`` record of an HTTP message whose body is
in chunked transfer coding, or, when a larger id holds the same payload, a
``revisit`` that names it. A block longer than ``segment`` bytes is cut into a
first record (segment 1) and ``continuation`` records that name the first
record's id; the last gives the total length. Records end with CRLF CRLF, and
Spark's text writer with that line separator writes just these bytes, gzipped;
so archives go wherever Spark writes, and no task holds more than its records.

**Reading** parses each archive by Content-Length (never by searching for a
separator, which a payload may hold), groups the segments by origin id, orders
them by number, requires numbers 1..n and the stated total length, decodes the
chunked framing and verifies the payload's digest.

**Damage** never fails a job nor holds it up: every record or stretch that
cannot be read becomes a row of type ``damaged`` with its ``problem``, and the
parser goes on at the next line that begins a record, after damaged gzip at the
next member. Lengths are decimal digits, chunk sizes hexadecimal ones, both
held against what is there before anything is taken.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import Scratch

END = "\r\n\r\n"
SEGMENT, CHUNK, ROWS_PER_FILE = 1 << 13, 1 << 12, 4000
#: A block beyond this is skipped by its length and reported; Arrow's binary cells end at 2 GB.
LONGEST_BLOCK = 1 << 30
LONGEST_LINE, MOST_HEADERS = 1 << 16, 1000
GZIP, PADDING, START = b"\x1f\x8b\x08", re.compile(rb"\0*"), re.compile(rb"WARC/\d+\.\d+\r?\n")
HEX, NATURAL, INTEGER = re.compile(rb"[0-9A-Fa-f]{1,16}"), re.compile(r"[0-9]{1,18}"), re.compile(r"-?[0-9]{1,19}")
CHUNKED = re.compile(rb"^transfer-encoding:[ \t]*chunked[ \t]*\r?$", re.IGNORECASE | re.MULTILINE)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer coding: hexadecimal length and data of each chunk, then a chunk of none."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i:i + size]), payload[i:i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The data of chunked framing; extensions and trailers are skipped, a broken frame raises ``ValueError``."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line without end")
        stated = body[at:end].split(b";")[0].strip()
        if not HEX.fullmatch(stated):
            raise ValueError("chunk size is not hexadecimal")
        size, at = int(stated, 16), end + 2
        if size == 0:
            return b"".join(out)
        if size > len(body) - at - 2 or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk is not as long as stated")
        out.append(body[at:at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its closing CRLF CRLF (the writer's line separator)."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return head.encode() + b"\r\n" + block


def page_records(page_id: int | None, row: int, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, segment: int) -> Iterator[bytes]:
    """The records of one page. ``row`` makes record ids unique where page ids repeat or are null."""
    origin = f"<urn:equiscope:page:{'null' if page_id is None else page_id}:{row}>"
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    base = [("WARC-Target-URI", uri), ("WARC-Date", "2024-01-01T00:00:00Z")]
    page = [("X-Page-Id", "null" if page_id is None else str(page_id))]
    digest = ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")
    if revisit:
        message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *base, *page, digest, ("Content-Type", "application/http; msgtype=response"),
                      ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))], message)
        return
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [message[i:i + segment] for i in range(0, len(message), segment)]
    for number, part in enumerate(parts, 1):
        head = [("WARC-Type", "response" if number == 1 else "continuation"), ("WARC-Record-ID", origin if number == 1 else f"{origin[:-1]}:{number}>"), *base]
        if number == 1:
            head += [*page, digest, ("Content-Type", "application/http; msgtype=response")]
        if len(parts) > 1:
            head += [("WARC-Segment-Number", str(number))]
            head += [("WARC-Segment-Origin-ID", origin)] if number > 1 else []
            head += [("WARC-Segment-Total-Length", str(len(message)))] if number == len(parts) else []
        yield record(head, part)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0,
                   segment: int = SEGMENT, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One or more records per row into gzipped archives at ``path``.

    Payload: the html in UTF-8 (null: empty). Of equal payloads of at least
    ``least_bytes`` bytes the row of the largest id is the response, the
    others revisit it; shorter ones, and all rows with a null id, are
    responses. Rows that repeat the winning id are responses each. Empty
    tables write no record. Other columns are not archived.
    """
    given = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    body = F.encode("html", "UTF-8")
    scratch = Scratch(pages.sparkSession, "digests")
    digests = scratch.table(given.where((F.octet_length(body) >= least_bytes) & F.col("id").isNotNull())
                            .groupBy(F.unhex(F.sha1(body)).alias("digest"), F.octet_length(body).alias("length"))
                            .agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "length", "winner"), "digests")
    # the revisiting ids alone are joined, so that no page's text moves for it
    revisits = scratch.table(given.select("id", F.unhex(F.sha1(body)).alias("d"), F.octet_length(body).alias("l")).join(
        digests, (F.col("d") == F.col("digest")) & (F.col("l") == F.col("length"))).where("id != winner")
        .select(F.col("id").alias("_id"), F.col("digest").alias("_d"), "winner").distinct(), "revisits")
    marked = given.withColumn("_digest", F.unhex(F.sha1(body))).join(revisits.hint("shuffle_hash"), (F.col("id") == F.col("_id")) & (F.col("_digest") == F.col("_d")), "left").select("id", "url", "html", "winner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                row += 1
                refers = batch.column(3)[i].as_py()
                for made in page_records(batch.column(0)[i].as_py(), row, batch.column(1)[i].as_py(), batch.column(2)[i].as_py().encode(), refers, refers is not None, segment):
                    held.append(made)
                    size += len(made)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    (marked.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", rows_per_file).text(path))


class Members(io.RawIOBase):
    """The content of whole gzip members from ``at`` on. It ends where one is damaged or cut: then ``damaged`` is set and ``at`` is behind that member's start."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.start, self.engine, self.damaged = data, at, at, None, False

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.damaged:
            if self.engine is None:
                self.at = PADDING.match(self.data, self.at).end()
                if self.at >= len(self.data):
                    return 0
                self.engine, self.start = zlib.decompressobj(31), self.at
            piece = self.data[self.at:self.at + (1 << 16)]
            try:
                made = self.engine.decompress(piece, len(buffer))
            except zlib.error:
                break
            self.at += len(piece) - len(self.engine.unconsumed_tail) - len(self.engine.unused_data)
            if self.engine.eof:
                self.engine = None
            if made:
                buffer[:len(made)] = made
                return len(made)
            if not piece and self.engine is not None:
                break
        if not self.damaged:
            self.damaged, self.at = True, self.start + 1
        return 0


def taken(f, length: int, keep: bool) -> tuple[bytes, int]:
    """The next ``length`` bytes (none if not ``keep``) and how many there were; a length far beyond the end takes no memory."""
    parts, got = [], 0
    while got < length and (part := f.read(min(length - got, 1 << 20))):
        got += len(part)
        if keep:
            parts.append(part)
    return b"".join(parts), got


def records_of(f) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """Headers, block and problem of each record of a plain stream (see ``parse_archive``)."""
    lost = False  # inside a stretch that is reported already
    while line := f.readline(LONGEST_LINE):
        if line in (b"\r\n", b"\n"):
            continue
        if not START.fullmatch(line):
            if not lost:
                yield {}, None, "foreign"
            lost = True
            continue
        lost, headers, problem = False, {}, None
        while (line := f.readline(LONGEST_LINE)) not in (b"\r\n", b"\n"):
            if not line.endswith(b"\n") or len(headers) == MOST_HEADERS:
                problem = "header" if line.endswith(b"\n") or len(line) == LONGEST_LINE else "cut"
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        if problem is None and not NATURAL.fullmatch(headers.get("content-length", "")):
            problem = "length"
        if problem is not None:
            lost = problem != "cut"
            yield headers, None, problem
            continue
        length = int(headers["content-length"])
        block, got = taken(f, length, length <= LONGEST_BLOCK)
        problem = "cut" if got < length else "long" if length > LONGEST_BLOCK else None
        yield headers, block if problem is None else None, problem


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """Headers (names in lower case), block and problem of each record of an archive, gzipped (any number of members) or plain.

    Problem: null, then the block is whole; else the block is null, and it is
    ``foreign`` (lines where a record should begin, one row a stretch),
    ``header`` (an endless line or over ``MOST_HEADERS`` headers), ``length``
    (Content-Length missing, negative or no number), ``cut`` (the data end
    inside the record), ``long`` (over ``LONGEST_BLOCK``) or ``gzip`` (one row
    for a damaged or cut stretch). Behind a bad length the next record is
    looked for line by line, so a payload's own line of that form may be
    taken for one. Empty archives have no row. Every byte is read at most
    once, but for damaged members, which are read up to their damage.
    """
    if data[:2] != GZIP[:2]:
        yield from records_of(io.BytesIO(data))
        return
    at, lost = 0, False
    while 0 <= at < len(data):
        members = Members(data, at)
        for found in records_of(io.BufferedReader(members, 1 << 16)):
            # what follows a damaged member's start by chance is no archive: only records end that stretch
            if lost and found[2] is not None:
                continue
            lost = False
            yield found
        if not members.damaged:
            return
        if not lost:
            yield {}, None, "gzip"
        at, lost = data.find(GZIP, members.at), True


def segment_of(h: dict[str, str], block: bytes | None, problem: str | None) -> tuple:
    """A row of ``read_segments``. A record without type or id, or with numbers that are none, has the problem ``header``."""
    def number(name: str, most: int, default: int | None = None) -> int | None:
        value = h.get(name, "null")
        if value == "null":
            return default
        if not INTEGER.fullmatch(value) or not -most - 1 <= int(value) <= most:
            raise ValueError(name)
        return int(value)

    if problem is None:
        try:
            total = number("warc-segment-total-length", 2**63 - 1) if "warc-segment-number" in h else len(block)
            return (h["warc-type"], h.get("warc-segment-origin-id", h["warc-record-id"]), number("warc-segment-number", 2**31 - 1, 1), total,
                    number("x-page-id", 2**63 - 1), h.get("warc-target-uri"), h.get("warc-payload-digest") or None,
                    number("x-refers-to-page", 2**63 - 1), block, None)
        except (KeyError, ValueError):
            problem = "header"
    return "damaged", h.get("warc-record-id"), None, None, None, h.get("warc-target-uri"), None, None, None, problem


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: type, origin id, segment number, total length (on the last), page fields, stated digest, block, problem.

    Records that cannot be read are rows of type ``damaged`` (see
    ``parse_archive``). Empty files have no row. An archive is one row while it
    is read, so it must be shorter than 2 GB.
    """
    schema = ("type string, origin string, segment int, total long, page_id long, uri string, digest string, refers_to long, block binary, problem string")
    names = ["type", "origin", "segment", "total", "page_id", "uri", "digest", "refers_to", "block", "problem"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for found in parse_archive(content.as_py()):
                    rows.append(segment_of(*found))
                    size += len(found[1] or b"") + 1000
                    if size > 1 << 23:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, schema)


def digest_agrees(payload: bytes, stated: str) -> bool | None:
    """Whether a digest (``algorithm:value``, the value in base32 or hexadecimal) is the payload's; null for an unknown algorithm."""
    algorithm, _, value = stated.partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if algorithm not in {"md5", "sha1", "sha224", "sha256", "sha384", "sha512"}:
        return None
    made = hashlib.new(algorithm, payload).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def reassemble(segments: DataFrame) -> DataFrame:
    """A row per original record: ``type``, ``page_id``, ``uri``, ``digest`` (as stated, ``algorithm:value``), ``refers_to``, ``payload`` and ``problem`` (null if whole).

    Problems: ``segments`` (one missing, repeated or extra); ``length`` (the
    total is not as stated); ``framing`` (no HTTP header end, broken chunks);
    ``digest`` (another one; unknown algorithms are not checked), and those of
    the rows of type ``damaged``. Such a record stays, without payload. A record's segments are one page's
    bytes, so a group is as long as a page.
    """
    whole = segments.where("type = 'damaged' OR (type != 'continuation' AND segment = 1 AND total IS NOT NULL)")
    parts = segments.where("type != 'damaged' AND NOT (type != 'continuation' AND segment = 1 AND total IS NOT NULL)")
    fields = ["type", "page_id", "uri", "digest", "refers_to"]
    lead = lambda c: F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c)
    joined = (parts.groupBy("origin").agg(*[lead(c) for c in fields], F.max("total").alias("total"), F.count("total").alias("totals"),
                                          F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts")))
    in_order = F.transform("parts", lambda p: p["segment"]) == F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: i.cast("int"))
    joined = joined.select(*[F.coalesce("type", F.lit("continuation")).alias("type") if c == "type" else F.col(c) for c in fields], "total",
                           F.when(~in_order | (F.col("totals") != 1), "segments").alias("problem"),
                           F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"])).alias("block"))
    everything = whole.select(*fields, "total", "problem", "block").unionByName(joined)
    everything = everything.withColumn("problem", F.coalesce("problem", F.when(F.octet_length("block") != F.col("total"), "length")))

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, problems = [], []
            for kind, digest, problem, block in zip(*[batch.column(i).to_pylist() for i in (0, 3, 5, 6)]):
                payload = None
                if problem is None and kind == "response":
                    head, end, body = block.partition(b"\r\n\r\n")
                    try:
                        if not end:
                            raise ValueError
                        payload = unchunked(body) if CHUNKED.search(head) else body
                        if digest is not None and digest_agrees(payload, digest) is False:
                            payload, problem = None, "digest"
                    except ValueError:
                        problem = "framing"
                out.append(payload)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(problems, pa.string()), pa.array(out, pa.binary())], names)

    names = [*fields, "problem", "payload"]
    schema = "type string, page_id long, uri string, digest string, refers_to long, problem string, payload binary"
    return everything.select(*fields, "problem", "block").mapInArrow(payloads, schema)
