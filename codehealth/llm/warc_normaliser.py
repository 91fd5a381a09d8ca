"""WARC archives: whole-file gzip streams rewritten as one gzip member for each record.

Crawlers often leave an archive as one gzip stream, of which no record can be read
without inflating all that comes before it. ``normalise`` inflates each such stream once,
front to back, writes every record again as its own member and a sidecar index with each
record's offset and length, so that ``read_records`` reads any slice of an archive alone.

1. ``write_monolithic``: the tasks that read the table write archives of bounded size, all
   records as responses, and return one row for each record with its payload's digest.
   Pages themselves are never shuffled.
2. ``duplicates``: of records with one digest the one with the smallest id is kept
   (a partial minimum for each digest, joined back; rows without payloads).
3. ``normalise``: one group for each archive holds its duplicates' numbers; the task inflates
   the archive in a stream and writes a duplicate as a revisit of the kept record.
4. ``read_records``: the sidecar rows are dealt out by slices of 8 MB, every record of a slice
   is inflated by itself, and its payload held against its digest.

Files of a task that failed or ran twice are not in the returned tables and thus never
read. Tables between the steps are written to the shared folder.

Defined cases: a null payload counts as empty; payloads under ``least`` bytes are all
responses; equal ids, or none, are told apart by their place in the archives, and a null id
comes after all others; urls are optional, control characters and blanks in them are
escaped; a record is held in memory whole, an archive never; a gzip stream that ends early
or is damaged gives the records before that place and ``complete`` false; an empty table
gives no archive; further columns are not stored.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import drop_path, shared_path, ship_package

# ---- fixed values: field names and profile of the WARC 1.1 format -----------------------
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ----------------------------------------------------------------------------------------
DATE = "1970-01-01T00:00:00Z"  # the tables name no time of capture
SLICE = 8 << 20  # bytes of an archive that one row of a read stands for
ESCAPED = re.compile(r"[\x00-\x20\x7f]")


@dataclass(frozen=True)
class Layout:
    archive_bytes: int = 64 << 20  # bytes before compression at which an archive is full
    archive_records: int = 20_000  # records likewise
    level: int = 4


def _open(uri: str):
    return FileSystem.from_uri(uri)


def record(kind: str, record_id: str, page, url, block: bytes, digest: str, refers: tuple | None = None, date: str = DATE) -> bytes:
    """One record: its head, block and closing line ends."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if page is not None:
        head.append(f"X-Page-ID: {quote(str(page))}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers:
        head += [f"WARC-Refers-To: <urn:uuid:{refers[0]}>", f"WARC-Profile: {PROFILE}"]
        if refers[1] is not None:
            head.append(f"X-Refers-To-Page-ID: {quote(refers[1])}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def page_of(named: dict[str, str], name: str) -> str | None:
    return unquote(named[name]) if name in named else None


def fields(head: list[bytes]) -> dict[str, str]:
    """Field names in lower case and their values; a line that starts with a blank goes on with the one before."""
    out, last = {}, None
    for line in head:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Fields, head and block of every record of an inflated stream; EOFError where it ends inside one."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise EOFError("no record starts here")
        head = [line]
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise EOFError("the stream ends in a head")
            head.append(line)
        named = fields(head[1:])
        if not named.get("content-length", "").isdigit():
            raise EOFError("no length")
        n = int(named["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise EOFError("the stream ends in a block")
        yield named, b"".join(head), block


class _Inflated(io.RawIOBase):
    """The content of a gzip file of one or more members; ends where the file is damaged, ``whole`` tells."""

    def __init__(self, raw):
        self.raw, self.gzip, self.held, self.whole = raw, None, b"", True

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while self.whole:
            ended = not self.held and not (more := self.raw.read(1 << 18))
            self.held = self.held or (b"" if ended else more)
            if self.gzip is None:
                self.held = self.held.lstrip(b"\0")  # padding between members
                if not self.held:
                    if ended:
                        return 0
                    continue
                self.gzip = zlib.decompressobj(31)
            try:
                data = self.gzip.decompress(self.held, len(out))
            except zlib.error:
                self.whole = False
                break
            if self.gzip.eof:
                self.held, self.gzip = self.gzip.unused_data, None
            else:
                self.held = self.gzip.unconsumed_tail
                self.whole = bool(data or self.held or not ended)
            if data:
                out[:len(data)] = data
                return len(data)
        return 0


class _Archive:
    """A new archive in one gzip stream."""

    def __init__(self, folder: str, layout: Layout):
        self.uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        self.layout, self.bytes, self.records = layout, 0, 0
        fs, path = _open(self.uri)
        self.file = fs.open_output_stream(path, compression=None)
        self.gzip = zlib.compressobj(layout.level, zlib.DEFLATED, 31)

    def add(self, data: bytes) -> int:
        self.file.write(self.gzip.compress(data))
        self.bytes += len(data)
        self.records += 1
        return self.records - 1

    def full(self) -> bool:
        return self.bytes >= self.layout.archive_bytes or self.records >= self.layout.archive_records

    def close(self) -> None:
        self.file.write(self.gzip.flush())
        self.file.close()


def _make_folder(uri: str) -> None:
    fs, path = _open(uri)
    fs.create_dir(path, recursive=True)


def write_monolithic(pages: DataFrame, folder: str, page: str = "page_id", url: str | None = "url", payload: str = "html",
                     layout: Layout = Layout()) -> DataFrame:
    """Write archives, a gzip stream each, below ``folder``/crawl; ``archive, seq, page_id, record_id, payload_bytes,
    payload_digest`` of every record, read back from a table beside them."""
    ship_package(pages.sparkSession)
    _make_folder(f"{folder}/crawl")
    rows = pages.select(F.col(page).alias("page"), (F.col(url) if url else F.lit(None)).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    kind = rows.schema["page"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            out = []
            for i in range(len(batch)):
                if archive is None:
                    archive = _Archive(f"{folder}/crawl", layout)
                body, at = batch["payload"][i].as_py(), batch["page"][i].as_py()
                digest, record_id = hashlib.sha256(body).hexdigest(), str(uuid.uuid4())
                seq = archive.add(record("response", record_id, at, batch["url"][i].as_py(), http_head(len(body)) + body, digest))
                out.append((archive.uri, seq, record_id, len(body), digest))
                if archive.full():
                    archive.close()
                    archive = None
            names = ["archive", "seq", "record_id", "payload_bytes", "payload_digest"]
            columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*columns, batch["page"]], [*names, "page_id"])
        if archive is not None:
            archive.close()

    made = rows.mapInArrow(write, f"archive string, seq bigint, record_id string, payload_bytes bigint, payload_digest string, page_id {kind}")
    made.write.parquet(f"{folder}/written")
    return pages.sparkSession.read.parquet(f"{folder}/written")


def duplicates(written: DataFrame, least: int = 100) -> DataFrame:
    """``archive, seq, refers_record, refers_page`` of every record but the first of its digest, by id."""
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "seq", "record_id")
    large = written.where(F.col("payload_bytes") >= least)
    first = large.groupBy("payload_digest").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    both = large.join(first.select("payload_digest", "first"), "payload_digest")
    return both.where("archive != first.archive or seq != first.seq").select(
        "archive", "seq", F.col("first.record_id").alias("refers_record"), F.col("first.page_id").cast("string").alias("refers_page"))


def _rewrite(uri: str, out: str, refers: dict[int, tuple], level: int) -> tuple[str, str, int, bool]:
    """Inflate one archive in a stream and write its records as members; names of the new archive and index, count, whole."""
    stem = f"{out}/{uri.rsplit('/', 1)[-1].removesuffix('.warc.gz')}-{uuid.uuid4().hex}"
    (source, path), (target, new) = _open(uri), _open(f"{stem}.warc.gz")
    n, offset, whole = 0, 0, True
    with source.open_input_stream(path, compression=None) as raw, target.open_output_stream(new, compression=None) as members, \
            target.open_output_stream(f"{new.removesuffix('.warc.gz')}.idx.gz", compression="gzip") as index:
        stream = _Inflated(raw)
        found = records(io.BufferedReader(stream, 1 << 20))
        while True:
            try:
                named, head, block = next(found)
            except StopIteration:
                break
            except EOFError:
                whole = False
                break
            kind, digest = named.get("warc-type", ""), named.get("warc-payload-digest", "").removeprefix("sha256:")
            record_id = named.get("warc-record-id", "").removeprefix("<urn:uuid:").removesuffix(">")
            if n in refers:
                kind, block = "revisit", b"".join(block.partition(b"\r\n\r\n")[:2])
                data = record(kind, record_id, page_of(named, "x-page-id"), named.get("warc-target-uri"), block, digest, refers[n], named.get("warc-date", DATE))
            else:
                data = head + b"\r\n" + block + b"\r\n\r\n"
            gz = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = gz.compress(data) + gz.flush()
            members.write(member)
            index.write((json.dumps({"offset": offset, "length": len(member), "record_id": record_id, "type": kind, "digest": digest}) + "\n").encode())
            offset, n = offset + len(member), n + 1
    return f"{stem}.warc.gz", f"{stem}.idx.gz", n, whole and stream.whole


def normalise(archives: DataFrame, folder: str, revisits: DataFrame | None = None, layout: Layout = Layout()) -> DataFrame:
    """Rewrite every archive of ``archives`` (column ``archive``) below ``folder``/members.

    ``revisits`` (``archive, seq, refers_record, refers_page``) names records that become revisits; a group
    holds one archive's, at most its records. Returns ``archive, normalised, index, records, complete``.
    """
    spark = archives.sparkSession
    ship_package(spark)
    _make_folder(f"{folder}/members")
    names = archives.select("archive").distinct().select("archive", F.lit(-1).cast("long").alias("seq"), *[
        F.lit(None).cast("string").alias(x) for x in ("refers_record", "refers_page")])
    todo = names if revisits is None else names.unionByName(revisits)
    out, level = f"{folder}/members", layout.level

    def rewrite(group: pa.Table) -> pa.Table:
        refers = {r["seq"]: (r["refers_record"], r["refers_page"]) for r in group.to_pylist() if r["seq"] >= 0}
        archive = group["archive"][0].as_py()
        row = (archive, *_rewrite(archive, out, refers, level))
        return pa.table([pa.array([x]) for x in row], names=["archive", "normalised", "index", "records", "complete"])

    # rows are few and the work behind each is large: as many parts as archives, whatever the rows' bytes
    parts = max(1, archives.select("archive").distinct().count())
    done = todo.repartition(2 * parts, "archive").groupBy("archive").applyInArrow(
        rewrite, "archive string, normalised string, index string, records bigint, complete boolean")
    done.write.parquet(f"{folder}/normalised")
    return spark.read.parquet(f"{folder}/normalised")


def read_index(normalised: DataFrame) -> DataFrame:
    """``normalised, slice, seq, offset, length, record_id, type, digest`` of every record, from the sidecars."""
    schema = pa.schema([("normalised", pa.string()), ("slice", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
                        ("record_id", pa.string()), ("type", pa.string()), ("digest", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _open(row["index"])
                with fs.open_input_stream(path, compression="gzip") as f:
                    at = 0
                    while lines := (f.read(4 << 20) + _rest_of_line(f)).splitlines():
                        out = [json.loads(x) for x in lines]
                        yield pa.RecordBatch.from_pylist([{**x, "normalised": row["normalised"], "slice": x["offset"] // SLICE, "seq": at + i}
                                                          for i, x in enumerate(out)], schema)
                        at += len(out)
    return normalised.select("normalised", "index").mapInArrow(
        read, "normalised string, slice bigint, seq bigint, offset bigint, length bigint, record_id string, type string, digest string")


def _rest_of_line(stream) -> bytes:
    out = b""
    while (c := stream.read(1)) and c != b"\n":
        out += c
    return out + c if c else out


def read_records(normalised: DataFrame, page_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload`` of every stored record.

    A revisit has no payload of its own; without ``payloads`` they are checked and left out.
    Each row of the plan is one slice of one archive, so a slice is read, and lost work redone, alone.
    A payload that does not have its digest is an error.
    """
    spark = normalised.sparkSession
    ship_package(spark)
    slices = read_index(normalised).groupBy("normalised", "slice").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"))
    schema = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.string()), ("url", pa.string()), ("payload", pa.binary())])

    def one(named: dict, block: bytes) -> tuple:
        cut = block.find(b"\r\n\r\n") + 4
        http, body = fields(block[:cut].splitlines(keepends=True)), block[cut:]
        kind, digest = named["warc-type"], named["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"record {named.get('warc-record-id')} does not have its digest")
        return (page_of(named, "x-page-id"), int(http["content-length"]), digest, kind, page_of(named, "x-refers-to-page-id"), named.get("warc-target-uri"),
                body if payloads and kind == "response" else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _open(row["normalised"])
                with fs.open_input_file(path) as f:
                    f.seek(row["start"])
                    data = f.read(row["end"] - row["start"])
                out, size = [], 0
                for named, _, block in records(io.BufferedReader(_Inflated(io.BytesIO(data)))):
                    out.append(one(named, block))
                    size += len(block)
                    if size > SLICE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types, strict=True)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types, strict=True)], schema=schema)
    # a row stands for megabytes of archive: dealt out by number, not by the rows' bytes, and not left as the sum above has them
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = slices.repartition(width, F.xxhash64("normalised", "slice")).mapInArrow(
        read, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, payload binary")
    return rows.withColumn("page_id", F.col("page_id").cast(page_type)).withColumn("refers_to", F.col("refers_to").cast(page_type))


def archive_pages(pages: DataFrame, folder: str | None = None, layout: Layout = Layout(), least: int = 100) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as monolithic archives, normalise them and drop the former; the table of archives."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    written = write_monolithic(pages, folder, layout=layout)
    done = normalise(written, folder, duplicates(written, least), layout)
    drop_path(pages.sparkSession, f"{folder}/crawl")
    return done


def stored_pages(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` and read their records back, payloads left out."""
    return read_records(archive_pages(pages), pages.schema["page_id"].dataType.simpleString(), payloads=False)
