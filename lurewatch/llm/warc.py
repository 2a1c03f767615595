"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES``; each frame can be read by itself.  An
archive ends with a skippable frame that lists the compressed and the plain size of every frame
(the public seekable format of Zstandard).  The index maps a record to its archive, its frame and
its place within the frame, so one record is read with one seek.

Equal payloads are stored once: the record with the smallest id is the response, the others are
revisits that name it and keep its digest and length in their headers.  Payloads are equal if
their SHA-256 is; ids of equal payloads meet in a grouping that keeps one row per digest and task.  Only
ids and digests move by digest, and a payload that many rows have is dealt to several tasks there;
payloads themselves move by (id, digest), if at all.

Tasks write archives under names of their own and hand back index rows; only the index of tasks
that succeeded is kept, so a lost executor leaves at most files that nothing refers to.  Archives
are written through Arrow's file systems to the folder in ``spark.checkpoint.dir``.

Null payloads are empty.  Rows that share the smallest id of their payload are all responses
(repeated rows); rows without an id are responses, as their id cannot be smaller than another's,
and no record refers to them.  Payloads of fewer than ``revisit_from`` bytes are all responses.
An empty table writes no archive.  Columns other than the id, the address and the payload are
not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import text_slices
from lurewatch.session import run_dir, stage

FRAME_BYTES = 1 << 20
ARCHIVE_BYTES = 256 << 20
# Bytes of records that a task reads back, about.
READ_BYTES = 32 << 20
LEVEL = 3
# --- fixed values of the WARC and the seekable Zstandard format ------------------------------
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ---------------------------------------------------------------------------------------------
INDEX = "record string, archive string, frame int, offset long, length long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record; a revisit holds the response's header lines without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <urn:record:" + record_id.encode() + b">",
        b"WARC-Date: 1970-01-01T00:00:00Z",
        # Line breaks in an address would end its header.
        b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode(),
        b"WARC-Payload-Digest: sha1:" + payload_digest(payload).encode(),
        b"Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        lines += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: <urn:record:" + refers_to.encode() + b">"]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION:
        raise ValueError(f"not a WARC record: {first[:20]!r}")
    headers = dict(line.decode().split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(line.decode().split(": ", 1) for line in http.split(b"\r\n")[1:]), payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body) + len(footer)) + body + footer


def frame_places(file) -> list[tuple[int, int]]:
    """Where each frame of an open archive begins and how long it is, from its seek table."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the archive")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - count * width)
    table, places, at = file.read(count * width), [], 0
    for row in range(count):
        length = struct.unpack_from("<I", table, row * width)[0]
        places.append((at, length))
        at += length
    return places


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class ArchiveWriter:
    """Frames of one archive at a time; index rows come out when their archive is complete."""

    def __init__(self, folder: str):
        import zstandard

        self.system, self.folder = _file_system(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.file, self.frame, self.plain = None, [], 0

    def _open(self) -> None:
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.file = self.system.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.frames, self.rows, self.written = [], [], 0

    def add(self, record_id: str, data: bytes) -> list[tuple]:
        """Rows of an archive that this record completes, if it does."""
        if self.file is None:
            self._open()
        self.rows.append((record_id, self.name, len(self.frames), self.plain, len(data)))
        self.frame.append(data)
        self.plain += len(data)
        if self.plain >= FRAME_BYTES:
            self._end_frame()
        return self.close() if self.written >= ARCHIVE_BYTES else []

    def _end_frame(self) -> None:
        data = self.compress(b"".join(self.frame))
        self.file.write(data)
        self.frames.append((len(data), self.plain))
        self.written += len(data)
        self.frame, self.plain = [], 0

    def close(self) -> list[tuple]:
        if self.file is None:
            return []
        if self.frame:
            self._end_frame()
        self.file.write(seek_table(self.frames))
        self.file.close()
        self.file = None
        return self.rows


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    columns = zip(*rows, strict=True)
    names = ["record", "archive", "frame", "offset", "length"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def with_originals(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Adds ``refers_to``: the smallest id among records of equal payload, if it is another's."""
    digest = F.when(F.octet_length("payload") >= revisit_from, F.unhex(F.sha2("payload", 256)))
    known = stage(pages.select("id", digest.alias("digest")).filter("digest is not null and id is not null"), "payload-digests")
    firsts = known.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    # Staged, so that Spark may split the rows of a hot digest in the join that follows.
    firsts = stage(firsts.filter("first <> last").select("digest", "first"), "repeated-payloads")
    later = known.join(firsts, "digest").filter("id > first").dropDuplicates(["id", "digest"])
    later = later.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
    joined = pages.withColumn("_own", digest).join(later, (F.col("id") == F.col("_id")) & (F.col("_own") == F.col("_digest")), "left")
    return joined.select(*pages.columns, "refers_to")


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html", revisit_from: int = 0,
) -> DataFrame:
    """Writes all rows and returns the index, one row per record."""
    payload = F.coalesce(F.encode(F.col(payload_col), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = with_originals(rows, revisit_from)
    sent = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder)
        for batch in text_slices(batches, "payload"):
            done = []
            for row in batch.to_pylist():
                name = row["id"] if row["id"] is not None else f"none-{uuid.uuid4().hex}"
                done += writer.add(name, record(name, row["url"], row["payload"], row["refers_to"]))
            if done:
                yield _index_batch(done)
        if rest := writer.close():
            yield _index_batch(rest)

    return stage(sent.mapInArrow(run, INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """``record, record_type, payload_bytes, payload_digest, refers_to`` of all indexed records,
    from the archives; the digest of a response is computed anew and must agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        system, root = _file_system(folder)
        name, file, places, number, frame = None, None, [], None, b""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["archive"] != name:
                    name, number = row["archive"], None
                    file = system.open_input_file(f"{root}/{name}")
                    places = frame_places(file)
                if row["frame"] != number:
                    number = row["frame"]
                    file.seek(places[number][0])
                    frame = decompress(file.read(places[number][1]))
                headers, http, payload = parse_record(frame[row["offset"] : row["offset"] + row["length"]])
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and payload_digest(payload) != digest:
                    raise ValueError(f"record {row['record']}: the payload does not have its digest")
                refers = headers.get("WARC-Refers-To")
                refers = refers.removeprefix("<urn:record:").removesuffix(">") if refers else None
                own = headers["WARC-Record-ID"].removeprefix("<urn:record:").removesuffix(">")
                out.append((own, kind, int(http["Content-Length"]), digest, refers))
            if out:
                types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["record", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    # Some frames of an archive together, in order, so each is read once.  The number of tasks goes
    # by the bytes to be read; index rows are small, and by their size Spark would take too few.
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // READ_BYTES))
    parted = index.withColumn("part", F.floor(F.col("frame") / 16)).repartition(tasks, "archive", "part")
    ordered = parted.sortWithinPartitions("archive", "frame", "offset").drop("part")
    return ordered.mapInArrow(
        run, "record string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    )


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads the archives back: one row per page."""
    folder = run_dir(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    kind = dict(pages.dtypes)["page_id"]
    found = read_archives(index, folder)
    return found.select(
        F.expr(f"try_cast(record as {kind})").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
