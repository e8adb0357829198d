"""Dictionary-compressed WARC archives (.warc.zst): writer and reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary built from the archive's own leading records; then each record is a frame of
its own, compressed with that dictionary. Executors write archives through Spark's text
sink, so any file system that Spark knows will do: a row is a segment of frames, and the line
separator is an empty skippable frame, which readers of Zstandard pass over. An archive is
full after SEGMENTS segments of SEGMENT_BYTES or a little more, and the next one begins with
a dictionary of its own; so archives, and what a reader holds, don't grow with the table.

Of records with equal payloads of at least MIN_REVISIT bytes (by SHA-256), the one with the
smallest page_id is a response and the others revisit it. Only digests and ids are
grouped; payloads move once, by page, and not at all where the revisits are few.

Defined results: null html is an empty payload; a null url is written as about:blank; a null
page_id is kept, and revisits if another row with an id has its payload; rows that repeat
the smallest page_id are all responses; empty tables make archives without records; other
columns are left out.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path

MIN_REVISIT = 100
DICTIONARY_BYTES = 64 << 10
#: A dictionary is trained on records spread over so many leading bytes of an archive.
BUFFER_BYTES, TRAIN_BYTES = 8 << 20, 2 << 20
LEVEL = 3
#: An archive's size: 64 MB, and a segment's last record beyond.
SEGMENT_BYTES, SEGMENTS = 4 << 20, 16
DATE = "2026-01-01T00:00:00Z"
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
#: An empty skippable frame of magic 0x184D2A50: eight ASCII characters.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
URN = "urn:glotspark:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, and refers_to for revisits."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    keys = base.where(F.octet_length("html") >= min_revisit).select("page_id", "digest")
    several = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    repeats = keys.join(several, "digest").where("page_id IS NULL OR page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    return base.alias("b").join(repeats.alias("r"), F.expr("b.page_id <=> r.page_id AND b.digest = r.digest"), "left").select("b.page_id", "url", "html", "b.digest", "refers_to")


def _clean(url: str | None) -> str:
    return "about:blank" if url is None else "".join(c if c > "\x20" and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def encode(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode(record: bytes) -> tuple[int | None, str, bytes, int, str, str, int | None]:
    """page_id, url, payload, payload bytes, digest, type and refers_to. A response whose payload has another digest is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if lines[0] != "WARC/1.1" or kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    number = lambda x: int(x) if (x := x[1:-1].removeprefix(URN)) else None
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload, size, digest, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None


def _dictionary(plain: list[bytes]) -> bytes:
    """A dictionary from records spread evenly over ``plain``; with too little to train on, empty."""
    every = max(1, sum(map(len, plain)) // TRAIN_BYTES)
    chosen = plain[::every]
    if sum(map(len, chosen)) < 8 * 1024 or len(chosen) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, chosen)) // 8), chosen).as_bytes()
    except zstandard.ZstdError:
        return b""


def opened(plain: Iterator[bytes], level: int = LEVEL) -> tuple[bytes, zstandard.ZstdCompressor, Iterator[bytes]] | None:
    """A new archive's first frame, which holds the dictionary, its compressor, and all of ``plain``; None without records."""
    first: list[bytes] = []
    held = 0
    for x in plain:
        first.append(x)
        held += len(x)
        if held >= BUFFER_BYTES:
            break
    if not first:
        return None
    own = _dictionary(first)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(own) if own else None, write_content_size=True)
    return DICTIONARY_MAGIC + len(own).to_bytes(4, "little") + own, packer, itertools.chain(first, plain)


def archive_frames(plain: Iterator[bytes], level: int = LEVEL) -> Iterator[bytes]:
    """The frames of one archive: dictionary first, then one for each record."""
    made = opened(plain, level)
    if made:
        yield made[0]
        yield from map(made[1].compress, made[2])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard or skippable frame at ``at`` ends, from its headers."""
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if magic != 0xFD2FB528:
        raise ValueError(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * (flags >> 2 & 1)


def archived(data: bytes) -> Iterator[bytes]:
    """The uncompressed records of an archive."""
    view, at, unpacker = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        if view[at : at + 4] == DICTIONARY_MAGIC:
            if end > at + 8:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : end])))
        elif int.from_bytes(view[at : at + 4], "little") == 0xFD2FB528:
            yield unpacker.decompress(view[at:end])
        at = end


def archive_rows(plain: Iterator[bytes], segment_bytes: int = SEGMENT_BYTES, segments: int = SEGMENTS) -> Iterator[bytes]:
    """Archives one after the other, each as 1 + ``segments`` rows (the last one as fewer): its dictionary, then segments of frames."""
    while made := opened(plain):
        head, packer, plain = made
        yield head
        done, held, size = 0, [], 0
        for x in plain:
            held.append(packer.compress(x))
            size += len(held[-1])
            if size >= segment_bytes:
                yield SEPARATOR.encode().join(held)
                done, held, size = done + 1, [], 0
                if done == segments:
                    break
        if held:
            yield SEPARATOR.encode().join(held)


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, segment_bytes: int = SEGMENT_BYTES, segments: int = SEGMENTS) -> None:
    """Archives of the records in ``path``, named ``*.warc.zst``: one or more from each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield encode(page_id, url, html.encode(), digest, refers_to)

        for row in archive_rows(plain(), segment_bytes, segments):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["frames"])

    frames = records(pages, min_revisit).mapInArrow(run, "frames binary")
    frames.select(F.col("frames").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1 + segments).text(path)
    _rename(pages.sparkSession, path)


def _rename(spark: SparkSession, path: str) -> None:
    """Gives the archives their extension: as many calls to the file system as there are archives."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in files.listStatus(folder):
        name = f.getPath().getName()
        if name.endswith(".txt"):
            files.rename(f.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.zst"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in ``path``; revisits have an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for record in archived(data.as_buffer()):
                    rows.append(decode(record))
                    held += len(record)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of ``pages`` to the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM k)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""
