"""WARC archives of pages: a dictionary-compressed writer, and a reader.

An archive starts with a skippable frame that holds a Zstandard dictionary
trained on its own first records; every record then is a frame of its own,
compressed with that dictionary, so a record can be read by its offset alone.
Of records with equal long payloads one is a ``response``; the others are
``revisit`` records that refer to it and hold no payload.

Archives go to a folder that all executors share, under names of their own,
and count only if the finished task's row names them: a task that is run again
leaves nothing behind that is read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import pin, scratch
from .common import small

# The magic number of the skippable frame that holds a dictionary, and WARC header names.
DICT_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

SAMPLE_BYTES, ARCHIVE_BYTES, DICT_BYTES = 1 << 20, 64 << 20, 1 << 16


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; the payload stands after the block's HTTP header, and a revisit has the header alone."""
    clean = None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", clean), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"),
        ("WARC-Profile", PROFILE if is_revisit else None), ("WARC-Refers-To", record_id(refers_to) if is_revisit else None),
        ("X-Refers-To-Page-Id", refers_to if is_revisit else None), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records; None if they are too few or too short to train one."""
    held = sum(map(len, samples))
    if len(samples) < 8 or held < 8 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(size, held // 8), samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


class Writer:
    """Writes archives of about ``ARCHIVE_BYTES`` of records; the dictionary comes from the first ``SAMPLE_BYTES`` of each."""

    def __init__(self, folder: str) -> None:
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.out, self.name, self.held, self.size, self.count = None, "", [], 0, 0

    def add(self, rec: bytes) -> Iterator[tuple[str, int]]:
        """Takes a record; yields an archive's name and number of records when it is full."""
        self.size += len(rec)
        self.count += 1
        if self.out is None:
            self.held.append(rec)
            if self.size >= SAMPLE_BYTES:
                self._open()
        else:
            self.out.write(self.zstd.compress(rec))
        if self.size >= ARCHIVE_BYTES:
            yield from self.close()

    def _open(self) -> None:
        words = train_dictionary([r[:65_536] for r in self.held])  # frames are whole; only the training material is cut
        self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(self.name, compression=None)  # not by the name: records are compressed one by one
        data = words.as_bytes() if words else b""
        self.out.write(struct.pack("<II", DICT_MAGIC, len(data)) + data)
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True)
        for r in self.held:
            self.out.write(self.zstd.compress(r))
        self.held = []

    def close(self) -> Iterator[tuple[str, int]]:
        if self.count:
            if self.out is None:
                self._open()
            self.out.close()
            yield self.name, self.count
        self.out, self.held, self.size, self.count = None, [], 0, 0


def read_records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Header, HTTP header and payload of each record of an archive, one frame in memory at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    data = stream.read(size)
    words = zstandard.ZstdCompressionDict(data) if data else None
    rest = b""
    zstd = zstandard.ZstdDecompressor(dict_data=words)
    while True:
        frame, part = zstd.decompressobj(), rest or stream.read(1 << 16)
        if not part:
            return
        got = []
        while not frame.eof:
            if not part:
                raise ValueError("the archive ends within a record")
            got.append(frame.decompress(part))
            part = b"" if frame.eof else stream.read(1 << 16)
        rest = frame.unused_data
        yield parse(b"".join(got))


def _headers(raw: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in raw.decode().split("\r\n")[1:])


def parse(rec: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    head, _, rest = rec.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _headers(http), payload


def assign(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """``(page_id, url, payload, refers_to)``: refers_to is the largest id with an equal payload of ``min_bytes`` at least, else null.

    Only digests that more than one row has go into the join, and payloads stay
    where they are while those are few enough to be sent to every executor.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).cast("binary").alias("payload"))
    long = F.octet_length("payload") >= min_bytes
    equal = rows.where(long).groupBy(F.unhex(F.sha2("payload", 256)).alias("digest")).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    equal = small(pin(equal))
    # a short payload's key equals none, and is not the same for all of them
    rows = rows.withColumn("key", F.when(long, F.unhex(F.sha2("payload", 256))).otherwise(F.unhex(F.md5(F.concat_ws("|", F.xxhash64("page_id", "url"))))))
    return rows.join(equal, rows.key == equal.digest, "left").select("page_id", "url", "payload", "refers_to")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Archives ``pages`` under ``folder``; returns the written table of ``(archive, records)``.

    Null payloads are empty. A row whose id equals the largest of its equal
    payloads is a response, rows that repeat it too; so are rows with a null
    id, which cannot be told from it. A null url has no WARC-Target-URI.
    """
    rows = assign(pages, id_col, url_col, payload_col, min_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Writer(f"{folder}/archives")
        for pdf in batches:
            for page, url, payload, to in zip(pdf.page_id, pdf.url, pdf.payload, pdf.refers_to, strict=True):
                page, to = (None if pd.isna(x) else int(x) for x in (page, to))
                revisit = to is not None and page is not None and page != to
                for done in out.add(record(page, url if isinstance(url, str) else None, bytes(payload), to, revisit)):
                    yield pd.DataFrame([done], columns=["archive", "records"])
        for done in out.close():
            yield pd.DataFrame([done], columns=["archive", "records"])

    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))
    rows.mapInPandas(run, "archive string, records long").write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives that ``folder``'s index names: ids, url, type, payload, and digest and length as stated.

    Archives are read in parallel, a record at a time; a response whose payload
    does not have the stated digest is an error. A revisit's payload is null.
    """
    index = spark.read.parquet(f"{folder}/index")
    index = index.repartition(max(1, index.count()), F.xxhash64("archive"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        columns = ["page_id", "url", "record_type", "refers_to", "payload", "payload_digest", "payload_bytes"]
        for pdf in batches:
            for name in pdf.archive:
                rows, held = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for warc, http, payload in read_records(stream):
                        kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload does not have its digest")
                        rows.append((warc.get("X-Page-Id"), warc.get("WARC-Target-URI"), kind, warc.get("X-Refers-To-Page-Id"), payload if kind == "response" else None, digest, int(http["Content-Length"])))
                        held += len(payload)
                        if held >= 4 << 20 or len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    found = index.mapInPandas(run, "page_id string, url string, record_type string, refers_to string, payload binary, payload_digest string, payload_bytes long")
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Writes ``pages`` and reads the archives back, from a fresh folder under the shared one unless another is named."""
    folder = folder or scratch(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    write(pages, folder, **columns)
    return read(pages.sparkSession, folder)
