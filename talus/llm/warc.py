"""Archives: writing and reading ARC files, and converting their records to WARC.

Both formats are written by Spark's text writer, one row a record, and read with its binary file source, so any file
system that Spark knows will do. A reader streams through one archive and holds one record at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import BROADCAST_LIMIT, Scratch, broadcast_if_small

#: Records a file at most, bytes that a file's records may have, and bytes of payload that an emitted batch holds.
ARCHIVE_RECORDS = 2000
ARCHIVE_BYTES = 512 << 20
BATCH_BYTES = 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Fields of an ARC header line after the url, by version of the file.
ARC_FIELDS = {
    1: ("ip", "date", "content_type", "length"),
    2: ("ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}


@dataclass
class ArcRecord:
    offset: int
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    truncated: bool

    @property
    def payload_start(self) -> int:
        """Where the entity begins: after the HTTP header, if the block has one."""
        if self.block.startswith(b"HTTP/"):
            end = self.block.find(b"\r\n\r\n")
            return end + 4 if end >= 0 else len(self.block)
        return 0

    @property
    def warc_type(self) -> str:
        if self.url.startswith("filedesc:"):
            return "warcinfo"
        return "response" if self.block.startswith(b"HTTP/") else "resource"

    def record_id(self, archive: str) -> str:
        """The same for each conversion of one archive: from its name and the record's place."""
        return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{archive}#{self.offset}'.encode()).digest(), version=3)}"

    @property
    def warc_date(self) -> str:
        d = (re.sub(r"\D", "", self.date) + "19700101000000"[len(re.sub(r"\D", "", self.date)) :])[:14]
        return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def stream(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file of version 1 or 2, plain or gzipped.

    The version block names the version; a file that has lost it is read as version 1 or 2 by each header line's number
    of fields. Lines that are no header are skipped; a record that ends before its declared length is marked truncated.
    """
    f, offset, version = stream(content), 0, None
    while line := f.readline():
        at, offset = offset, offset + len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        for v in [version] if version else (2, 1):
            parts = text.rsplit(" ", len(ARC_FIELDS[v]))
            if len(parts) == len(ARC_FIELDS[v]) + 1 and parts[-1].isdigit() and re.fullmatch(r"\d{8,14}", parts[2]):
                break
        else:
            continue
        head = dict(zip(ARC_FIELDS[v], parts[1:], strict=True))
        length = int(head["length"])
        block = f.read(length)
        offset += len(block)
        record = ArcRecord(at, parts[0], head["ip"], head["date"], head["content_type"], block, len(block) < length)
        if record.warc_type == "warcinfo" and (m := re.match(rb"([12]) ", block)):
            version = int(m[1])
        yield record


def arc_version_block(version: int, name: str, date: str) -> bytes:
    columns = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 talus\n{columns}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body)) + body


def arc_header(version: int, url: str, ip: str, date: str, content_type: str, length: int) -> bytes:
    more = "" if version == 1 else "200 - - 0 - "
    return f"{url} {ip} {date} {content_type} {more}{length}\n".encode()


def warc_record(kind: str, record_id: str, date: str, block: bytes, fields: dict[str, str]) -> bytes:
    """One record without its final two line ends, which the text writer adds."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, **fields}
    head |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of each record, by declared length."""
    f = stream(content)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, f.read(int(head.get("content-length", 0)))


def page_of(block: bytes, end: int) -> str | None:
    found = re.search(rb"\r\nX-Page-Id: ([^\r\n]*)\r\n", block[:end])
    return unquote(found[1].decode()) if found else None


def in_batches(rows: Iterator[tuple], columns: dict[str, str], cost: Callable[[tuple], int]) -> Iterator[pd.DataFrame]:
    held, size = [], 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame(held, columns=list(columns)).astype({c: t for c, t in columns.items() if t == "Int64"})

    for row in rows:
        held.append(row)
        size += cost(row)
        if size >= BATCH_BYTES or len(held) >= 5000:
            yield frame()
            held, size = [], 0
    if held:
        yield frame()


def write_records(records: DataFrame, path: str, line_end: str, per_file: int) -> None:
    """Writes the binary column ``record``, compressed fast; a cast to string keeps its bytes."""
    (records.select(F.col("record").cast("string").alias("value"))
     .write.mode("overwrite").option("lineSep", line_end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", per_file).text(path))


def read_archives(spark: SparkSession, path: str, rows: Callable[[str, bytes], Iterator[tuple]], columns: dict[str, str], schema: str, cost: Callable[[tuple], int]) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = (row for batch in batches for name, content in zip(batch["path"], batch["content"], strict=True) for row in rows(name.rpartition("/")[2], content))
        yield from in_batches(every, columns, cost)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(parse, schema)


def records_a_file(pages: DataFrame, html_col: str = "html") -> int:
    """So many records that even of the largest pages a file holds ``ARCHIVE_BYTES``, or a version block and one page, as readers take whole files.

    A reader takes a file of less than 2 GB; so a page that alone passes that when compressed cannot be read back.
    """
    largest = pages.agg(F.max(F.octet_length(html_col))).first()[0] or 0
    return max(2, min(ARCHIVE_RECORDS, ARCHIVE_BYTES // (largest + 4096)))


def write_arc(pages: DataFrame, path: str, *, per_file: int = ARCHIVE_RECORDS, version: int = 1, date: str = "19700101000000", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes pages as gzipped ARC files of ``per_file`` records, each with a version block first and two records at least.

    The page id travels in an HTTP header; a null html is an empty entity. The writer counts records as the builder does, so
    a block stands where a file begins.
    """
    per_file = max(2, per_file)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page_id, url, html in zip(batch["id"], batch["url"], batch["html"], strict=True):
                body = (html or "").encode()
                known = f"X-Page-Id: {quote(page_id, safe='')}\r\n" if page_id is not None else ""
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{known}\r\n".encode() + body
                target = quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")
                if n % per_file == 0:  # the writer begins a file here
                    out.append(arc_version_block(version, f"pages-{task:05d}-{n // per_file:05d}.arc", date))
                    n += 1
                n += 1
                out.append(arc_header(version, target, "0.0.0.0", date, "text/html", len(block)) + block)
            yield pd.DataFrame({"record": out})
        if not n:
            yield pd.DataFrame({"record": [arc_version_block(version, f"pages-{task:05d}-00000.arc", date)]})

    source = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    write_records(source.mapInPandas(build, "record binary"), path, "\n", per_file)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, scratch: Scratch, *, id_type: str = "long", per_file: int = ARCHIVE_RECORDS, revisit_bytes: int = 100, broadcast_limit: int = BROADCAST_LIMIT) -> None:
    """Converts a folder of ARC files to WARC files.

    Of responses with equal payloads of at least ``revisit_bytes``, the one with the smallest page id (as ``id_type``; null
    last, then by record id) stays a response; the others become revisits that keep only their HTTP header.
    """

    def facts(archive: str, content: bytes) -> Iterator[tuple]:
        for r in read_arc(content):
            if r.warc_type == "response":
                payload = memoryview(r.block)[r.payload_start :]
                if len(payload) >= revisit_bytes:
                    yield r.record_id(archive), page_of(r.block, r.payload_start), hashlib.sha256(payload).digest()

    seen = scratch.save(
        read_archives(spark, arc_path, facts, {"record_id": "str", "page_id": "str", "digest": "bytes"}, "record_id string, page_id string, digest binary", lambda r: 100),
        "seen",
    )
    order = F.struct(F.col("page_id").isNull(), F.col("page_id").try_cast(id_type), "page_id", "record_id")
    first = seen.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.record_id").alias("refers_to"))
    first = scratch.save(first, "first")
    later = scratch.save(
        seen.join(broadcast_if_small(first, 100, broadcast_limit), "digest").filter("record_id <> refers_to").select("record_id", "refers_to"), "later"
    )

    schema = "record_id string, kind string, date string, url string, ip string, content_type string, truncated boolean, payload_start long, block binary"
    names = {c.split()[0]: "" for c in schema.split(", ")}

    def whole(archive: str, content: bytes) -> Iterator[tuple]:
        for r in read_arc(content):
            yield r.record_id(archive), r.warc_type, r.warc_date, r.url, r.ip, r.content_type, r.truncated, r.payload_start, r.block

    records = read_archives(spark, arc_path, whole, names, schema, lambda row: len(row[-1]))
    records = records.join(broadcast_if_small(later, 120, broadcast_limit), "record_id", "left")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.kind == "warcinfo":
                    out.append(warc_record("warcinfo", r.record_id, r.date, b"format: WARC File Format 1.0\r\nisPartOf: " + r.url.encode() + b"\r\n", {"Content-Type": "application/warc-fields"}))
                    continue
                fields = {"WARC-Target-URI": r.url, "WARC-IP-Address": r.ip, "Content-Type": "application/http; msgtype=response" if r.kind == "response" else r.content_type}
                block, kind = r.block, r.kind
                if r.truncated:
                    fields["WARC-Truncated"] = "unspecified"
                if kind == "response":
                    fields["WARC-Payload-Digest"] = f"sha256:{hashlib.sha256(memoryview(block)[r.payload_start :]).hexdigest()}"
                    if isinstance(r.refers_to, str):
                        kind, block = "revisit", block[: r.payload_start]
                        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{r.refers_to}>"}
                out.append(warc_record(kind, r.record_id, r.date, block, fields))
            yield pd.DataFrame({"record": out})

    ordered = ["record_id", "kind", "date", "url", "ip", "content_type", "truncated", "payload_start", "block", "refers_to"]
    write_records(records.select(*ordered).mapInPandas(build, "record binary"), warc_path, "\r\n\r\n", per_file)


def read_warc_pages(spark: SparkSession, warc_path: str, scratch: Scratch) -> DataFrame:
    """One row per response or revisit record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest come from its payload; a revisit has the digest that it declares and the length and
    page id of the response it refers to.
    """

    def rows(_: str, content: bytes) -> Iterator[tuple]:
        for head, block in read_warc(content):
            kind = head["warc-type"]
            if kind in ("response", "revisit"):
                end = block.find(b"\r\n\r\n") + 4
                own = kind == "response"
                digest = hashlib.sha256(memoryview(block)[end:]).hexdigest() if own else head["warc-payload-digest"].partition(":")[2]
                yield head["warc-record-id"], page_of(block, end), len(block) - end if own else None, digest, kind, head.get("warc-refers-to")

    columns = {"record_id": "", "page_id": "", "payload_bytes": "Int64", "payload_digest": "", "record_type": "", "refers_id": ""}
    schema = "record_id string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_id string"
    found = scratch.save(read_archives(spark, warc_path, rows, columns, schema, lambda r: 200), "found")
    referred = found.filter("record_type = 'revisit'").select(F.col("refers_id").alias("record_id")).distinct()
    targets = found.join(referred, "record_id", "left_semi").select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("refers_bytes")
    )
    return found.join(targets, "refers_id", "left").select(
        "page_id", F.coalesce("payload_bytes", "refers_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def archive_pages(pages: DataFrame, *, version: int = 1, revisit_bytes: int = 100) -> DataFrame:
    """Writes pages as ARC files, converts these to WARC, reads the WARC files back, and returns what they hold.

    Defined cases: a null html is an empty payload, a null url ``about:blank``, a null id stays null, and ids may be of any
    type. Repeated rows have a record each, all but one of them a revisit where the payload is long enough. Further columns are ignored; an empty
    table gives archives without pages and an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    per_file, id_type = records_a_file(pages), pages.schema["page_id"].dataType
    write_arc(pages, scratch.path("arc"), per_file=per_file, version=version)
    arc_to_warc(spark, scratch.path("arc"), scratch.path("warc"), scratch, id_type=id_type.simpleString(), per_file=per_file, revisit_bytes=revisit_bytes)
    scratch.drop("arc", "seen", "first", "later")
    out = read_warc_pages(spark, scratch.path("warc"), scratch)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
