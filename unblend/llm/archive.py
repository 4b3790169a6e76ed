"""Web archives: write the legacy ARC form, convert it to WARC, read WARC back.

Archives are real files of gzip members, a member a record, in a folder that
pyarrow's file systems reach (file, hdfs, s3, gs). A task holds one archive at a
time; writers start a new one after ``max_bytes``. Files appear under their
names only when whole, and a task that runs again writes the same file.

Conversion goes over the ARC files twice. First they are indexed: parsed by the
version that each file names and the lengths its header lines declare, without
passing payloads on. Spark picks, for each payload that occurs
more than once, the capture that stays whole; then each ARC file is read again
next to its own part of that plan and written as WARC. Payloads are never shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_dir
from .spread import join_by_count

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = b"x-page-id"

INDEX_SCHEMA = (
    "archive string, offset long, record_id string, url string, date string, page_id long, "
    "payload_bytes long, payload_digest string"
)
WARC_SCHEMA = (
    "archive string, offset long, record_type string, record_id string, refers_to_id string, date string, url string, "
    "page_id long, payload_bytes long, payload_digest string, payload binary"
)


def _file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def _read(uri: str) -> bytes:
    fs, path = _file_system(uri)
    # member by member from a stream: gzip.decompress copies all that is left for each member
    with fs.open_input_stream(path, compression=None) as f, gzip.GzipFile(fileobj=io.BytesIO(f.read())) as members:
        return members.read()


class _Writer:
    """Writes archives ``{folder}/{stem}-{k}{suffix}``, each whole or not at all."""

    def __init__(self, folder: str, stem: str, suffix: str, max_bytes: int):
        self.fs, self.folder = _file_system(folder)
        self.stem, self.suffix, self.max_bytes = stem, suffix, max_bytes
        self.fs.create_dir(self.folder, recursive=True)
        self.k, self.parts, self.size = 0, [], 0

    @property
    def name(self) -> str:
        return f"{self.stem}-{self.k:04d}{self.suffix}"

    def add(self, record: bytes) -> None:
        self.parts.append(gzip.compress(record, 1, mtime=0))
        self.size += len(record)

    def full(self) -> bool:
        return self.size >= self.max_bytes

    def close(self) -> str | None:
        """Finish the current archive; its name, or None if it has no records."""
        if not self.parts:
            return None
        name, own = self.name, f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(own, compression=None) as f:
            for part in self.parts:
                f.write(part)
        self.fs.move(own, f"{self.folder}/{name}")
        self.k, self.parts, self.size = self.k + 1, [], 0
        return name


def _archives(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """The paths of a folder's archives; their contents aren't read here."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    )


# ---------------------------------------------------------------- ARC


def _clean(field: str | None) -> str:
    """A header field: no white space or control characters, never empty."""
    text = "-" if not field else field
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def write_arc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "20000101000000",
    max_bytes: int = 32 << 20,
) -> DataFrame:
    """Write pages as ARC files, of version 1 and 2 by turns; returns the names.

    The payload is the html in UTF-8 (null: empty). White space in URLs is
    percent-encoded, a null URL is "-", a null id leaves its header out. The
    result is what has been written: it is made when this returns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        out, names = _Writer(folder, f"part-{part:06d}", ".arc.gz", max_bytes), []
        for batch in batches:
            for page, url, html in zip(batch["i"], batch["u"], batch["h"]):
                version = 1 + (part + out.k) % 2
                if not out.parts:
                    body = f"{version} 0 unblend\n{ARC_FIELDS[version]}\n\n".encode()
                    out.add(f"filedesc://{out.name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body + b"\n")
                payload = (html or "").encode("utf-8", "replace")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                if page is not None:
                    head += f"X-Page-Id: {int(page)}\r\n"
                block = head.encode() + b"\r\n" + payload
                more = f" 200 - - 0 {out.name}" if version == 2 else ""
                line = f"{_clean(url)} 0.0.0.0 {date} text/html{more} {len(block)}\n"
                out.add(line.encode() + block + b"\n")
                if out.full():
                    names.append(out.close())
        names.append(out.close())
        yield pd.DataFrame({"name": [n for n in names if n]}, dtype=object)

    rows = pages.select(
        F.col(id_col).cast("long").cast("string").alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h")
    )
    return materialize(rows.mapInPandas(run, "name string"), "arc-names")


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields of the header line, block) of each record after the first,
    which names the version and fields that the others are read by."""
    end = data.index(b"\n")
    length = int(data[:end].rsplit(b" ", 1)[1])
    about = data[end + 1 : end + 1 + length].split(b"\n")
    version = int(about[0].split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version}")
    fields = [x.lower() for x in about[1].decode().split()] or ARC_FIELDS[version].lower().split()
    at = end + 1 + length
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").split(" ")
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields at {at}, {len(fields)} declared")
        head = dict(zip(fields, values))
        size = int(head["archive-length"])
        block = data[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError(f"record at {at} ends early")
        yield at, head, block
        at = end + 1 + size


def _http(block: bytes) -> tuple[bytes, dict[bytes, bytes], bytes]:
    """(head with its blank line, headers by lower-case name, payload)."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    end = block.find(b"\r\n\r\n")
    head, payload = (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    return head, headers, payload


def _record_id(archive: str, at: int, head: dict[str, str]) -> str:
    name = archive.rsplit("/", 1)[-1]
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{at} {head["archive-date"]} {head["url"]}')}"


def _when(date: str) -> str:
    """A 14-digit date (or a shorter one, as old files have) as WARC writes it."""
    d = date.ljust(14, "0") if len(date) != 8 else date + "000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def index_arc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of a folder's ARC files, without payloads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = []
                for at, head, block in parse_arc(_read(path)):
                    _, headers, payload = _http(block)
                    page = headers.get(PAGE_HEADER)
                    sha = hashlib.sha1(payload).hexdigest()
                    own = _record_id(path, at, head)
                    page = None if page is None else int(page)
                    rows.append((path, at, own, head["url"], _when(head["archive-date"]), page, len(payload), sha))
                names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    return _archives(spark, folder, ".arc.gz").mapInPandas(run, INDEX_SCHEMA)


# ---------------------------------------------------------------- WARC


def revisit_plan(index: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """The index with refers_to_id: of records with equal payloads of at least
    ``min_bytes`` bytes the one with the largest page id (then archive and offset)
    has none and all others name it. Smaller ones name nothing. A payload that very
    many records share is joined apart from the others."""
    key = [F.col("payload_digest"), F.col("payload_bytes")]
    first = F.max(F.struct("page_id", "archive", "offset", "record_id"))
    groups = (
        index.where(F.col("payload_bytes") >= min_bytes)
        .groupBy(*key)
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "payload_bytes", F.col("first.record_id").alias("first_id"), "n")
    )
    refers = F.when(F.col("first_id") != F.col("record_id"), F.col("first_id"))
    named = join_by_count(index, groups, ["payload_digest", "payload_bytes"], "n", index.count(), "left")
    return named.withColumn("refers_to_id", refers)


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_warc(plan: DataFrame, folder: str, archives: int) -> DataFrame:
    """Convert the ARC files of a plan: one WARC file each; returns their names.

    A record keeps its HTTP head; a revisit's payload is left out. What is
    not HTTP becomes a resource record. The plan is small beside what it names, so
    the number of tasks is set by ``archives``, how many files there are.
    """

    def convert(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        (path,) = key
        refers = dict(zip(part["offset"], part["refers_to_id"]))
        stem = path.rsplit("/", 1)[-1].removesuffix(".arc.gz")
        out = _Writer(folder, stem, ".warc.gz", 1 << 62)
        for at, head, block in parse_arc(_read(path)):
            http, _, payload = _http(block)
            other = refers[at]
            kind = "revisit" if isinstance(other, str) else "response" if http else "resource"
            body = http if kind == "revisit" else block
            lines = [
                "WARC/1.1",
                f"WARC-Type: {kind}",
                f"WARC-Record-ID: <{_record_id(path, at, head)}>",
                f"WARC-Date: {_when(head['archive-date'])}",
                f"WARC-Target-URI: {head['url']}",
                f"WARC-IP-Address: {head['ip-address']}",
                f"Content-Type: {'application/http;msgtype=response' if http else head['content-type']}",
                f"WARC-Payload-Digest: {_digest(payload)}",
                f"WARC-Block-Digest: {_digest(body)}",
            ]
            if kind == "revisit":
                lines += [f"WARC-Refers-To: <{other}>", f"WARC-Profile: {REVISIT_PROFILE}"]
            lines += [f"Content-Length: {len(body)}", "", ""]
            out.add("\r\n".join(lines).encode() + body + b"\r\n\r\n")
        return pd.DataFrame({"name": [out.close()]})

    parts = plan.select("archive", "offset", "refers_to_id").repartition(max(1, archives), "archive").groupBy("archive")
    return materialize(parts.applyInPandas(convert, "name string"), "warc-names")


def parse_warc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers by lower-case name, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record at {at} ends early")
        yield at, head, block
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of a folder's WARC files. Digests of blocks, and of
    payloads that are there, are checked; ``payload`` is null for revisits and where
    ``payloads`` is false. payload_bytes is that of the full payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = []
                for at, head, block in parse_warc(_read(path)):
                    if _digest(block) != head["warc-block-digest"]:
                        raise ValueError(f"{path}: the block at {at} is damaged")
                    _, headers, payload = _http(block)
                    revisit = head["warc-type"] == "revisit"
                    digest = head["warc-payload-digest"]
                    if not revisit and _digest(payload) != digest:
                        raise ValueError(f"{path}: the payload at {at} is damaged")
                    size = int(headers[b"content-length"]) if revisit else len(payload)
                    page = headers.get(PAGE_HEADER)
                    refers = head.get("warc-refers-to")
                    rows.append(
                        (
                            path,
                            at,
                            head["warc-type"],
                            head["warc-record-id"].strip("<>"),
                            refers and refers.strip("<>"),
                            head["warc-date"],
                            head["warc-target-uri"],
                            None if page is None else int(page),
                            size,
                            base64.b32decode(digest.removeprefix("sha1:")).hex(),
                            payload if payloads and not revisit else None,
                        )
                    )
                names = [x.split()[0] for x in WARC_SCHEMA.split(", ")]
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    return _archives(spark, folder, ".warc.gz").mapInPandas(run, WARC_SCHEMA)


def convert_arc(spark: SparkSession, arc_folder: str, warc_folder: str, min_bytes: int = 1000) -> DataFrame:
    """ARC files to WARC files; returns the names written. No files: no names."""
    index = materialize(index_arc(spark, arc_folder), "arc-index")
    return write_warc(revisit_plan(index, min_bytes), warc_folder, _archives(spark, arc_folder, ".arc.gz").count())


def archive_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000
) -> DataFrame:
    """Pages through ARC and WARC files and back: one row per page with ``id_col``,
    payload_bytes, payload_digest, record_type and refers_to, the id of the page
    whose record a revisit names (null for responses). Rows that repeat an id are
    records of their own; of equal payloads with one id, one is the response. A null html is an empty
    payload, a null url is written as "-". A page is one record, however long; it is held whole by the task
    that writes or reads it. Other columns are ignored, whatever their names; an empty table gives no rows."""
    spark = pages.sparkSession
    arc, warc = new_dir(spark, "arc"), new_dir(spark, "warc")
    written = write_arc(pages, arc, id_col, url_col, html_col)
    if written.isEmpty():
        return spark.createDataFrame(
            [],
            f"`{id_col}` long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string",
        )
    convert_arc(spark, arc, warc, min_bytes)
    rows = read_warc(spark, warc, payloads=False).drop("payload")
    rows = materialize(rows, "warc-rows")
    whole = rows.where("refers_to_id is null").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    revisits = rows.where("refers_to_id is not null")
    named = whole.join(revisits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n")), "refers_to_id")
    found = join_by_count(revisits, named, ["refers_to_id"], "n", revisits.count(), "left")
    responses = rows.where("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    return found.unionByName(responses).select(
        F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )

