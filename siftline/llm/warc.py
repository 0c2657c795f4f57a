"""Dictionary-compressed WARC archives.

Each archive is a complete ``.warc.zst`` file: a leading skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary built from the archive's own records, then one Zstandard frame per record.  Archives are rows (name, data)
of a Parquet table in the shared folder, so Spark's commit protocol covers them; ``export`` writes them as files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.runtime import materialise

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Raw bytes of records to an archive; bytes of the dictionary; raw bytes of the records that it is built from.
ARCHIVE_BYTES, DICT_BYTES, SAMPLE_BYTES, LEVEL = 16 << 20, 32 << 10, 2 << 20, 3
REVISIT_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"


def decisions(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another: equal payloads of ``least`` bytes or more, largest id kept."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least).drop("n")
    kept = x.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    # concat() makes the digest a new expression: the join deals out both sides itself and can split a hot digest
    kept = kept.select(F.concat("digest").alias("same"), "refers_to")
    return x.join(kept, x["digest"] == kept["same"]).where(F.col("page_id") != F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()


def record(page_id, url, payload: bytes, refers_to, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit has the payload's digest and length but not the payload."""
    sha1 = hashlib.sha1(payload)
    fields = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    fields.append("WARC-Payload-Digest: sha1:" + base64.b32encode(sha1.digest()).decode())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(fields) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """(page_id, payload bytes, SHA-1 hex, type, refers_to); a response's figures are taken from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    own = lambda name: int(v) if name in fields and (v := fields[name].removeprefix("<urn:page:").rstrip(">")) else None
    if fields["WARC-Type"] == "revisit":
        length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
        return own("WARC-Record-ID"), length, base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), "revisit", own("WARC-Refers-To")
    sha1 = hashlib.sha1(payload)
    if fields["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(sha1.digest()).decode():
        raise ValueError(f"{fields['WARC-Record-ID']}: its payload has another digest")
    return own("WARC-Record-ID"), len(payload), sha1.hexdigest(), "response", None


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on every n-th record so that all parts of the archive count; raw content where there are too few."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = records[::step]
    if not sample:
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    trained = dictionary(records)
    inside = trained.as_bytes() if trained else b""
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True) if trained else zstandard.ZstdCompressor(level=LEVEL)
    return b"".join([struct.pack("<II", SKIPPABLE, len(inside)), inside, *map(pack.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its header and block headers."""
    (magic,) = struct.unpack_from("<I", data, at)
    if magic != FRAME:
        raise ValueError(f"no Zstandard frame at {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * (flags >> 2 & 1)


def records(data: bytes) -> Iterator[bytes]:
    view = memoryview(data)
    if not len(view):
        return
    magic, size = struct.unpack_from("<II", view, 0)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    inside = bytes(view[8 : 8 + size])
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(inside)) if inside else zstandard.ZstdDecompressor()
    at = 8 + size
    while at < len(view):
        end = frame_end(view, at)
        yield unpack.decompress(view[at:end])
        at = end


def write(pages: DataFrame, least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, data): the archives of all pages, in the shared folder.

    A null html is an empty payload; a null url has no target field; a null page_id is written without one and never
    revisits; repeated rows of one page_id are records each.  An empty table gives no archives.  Other columns are
    ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, first = [], 0, None

        def out():
            name = f"page-{first}-{hashlib.sha1(held[0]).hexdigest()[:8]}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive(held)], pa.binary())], ["name", "data"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for at in range(0, len(batch), 64):
                for x in zip(*(c.slice(at, 64).to_pylist() for c in columns)):
                    first = x[0] if not held else first
                    held.append(record(*x))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return materialise(rows.withColumn("digest", F.sha2("html", 256)).join(decisions(pages, least), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to").mapInArrow(run, "name string, data binary"), "warc")


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives; null and empty archives
    have none, and the records of an archive that is there twice are given twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                found = [parse(x) for x in records(data.as_py() or b"")]
                columns = zip(*found) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(archives: DataFrame, folder: str) -> list[str]:
    """Writes the archives as files of a folder that this machine sees; one at a time, so memory holds one archive."""
    os.makedirs(folder, exist_ok=True)
    paths = []
    for row in archives.toLocalIterator():
        paths.append(os.path.join(folder, row.name))
        with open(paths[-1], "wb") as f:
            f.write(row.data)
    return paths
