"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk`` characters is cut into chunks that overlap by ``overlap`` characters.  Chunks are
pre-tokenised in parallel.  A pre-token pattern without look-behind is memoryless: once two tokenisations share a
boundary, they agree from there on.  So in each overlap the first boundary that both neighbours have becomes the seam;
it must follow a character that is not white space, and lie far enough from the chunk's end that the cut can't have
changed it.  The pieces between two seams are then encoded by byte-pair merges, again in parallel, and ids are joined
in order.  Texts in which some overlap has no common boundary (for example one word of a million letters) are
encoded whole.  Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.runtime import text_or_empty, trimmed

CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Characters that a cut at a chunk's end can affect: the longest contraction, and the character looked at.
MARGIN = 4
#: A special token that is never allowed, so texts that hold it are ordinary. Without any, ``encode_to_numpy`` looks for the
#: empty one at every byte; one that begins with a rare ASCII byte is passed over by a search for its bytes.
NEVER = ("\x00|never|\x00", 0xFFFFFFFF)
#: Contractions as seven alternatives, and as one that matches the same; the fewer, the faster at every other token.
CONTRACTIONS = ("'s|'t|'re|'ve|'m|'ll|'d|", "'(?:[stmd]|re|ve|ll)|")
#: Pre-tokens that are passed over by one match on the way to a chunk's overlap.
STRIDE = 64


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file (lines of base64 bytes and rank); read once by each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=_grouped(pattern), mergeable_ranks=ranks, special_tokens=dict([NEVER]))


def _grouped(pattern: str) -> str:
    many, one = CONTRACTIONS
    return one + pattern.removeprefix(many) if pattern.startswith(many) else pattern


def ids_of(text: str, path: str, pattern: str) -> np.ndarray:
    """The ids of one whole text (uint32), special tokens being ordinary text."""
    return encoding(path, pattern).encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=4)
def pre_tokens(pattern: str) -> regex.Pattern:
    return regex.compile(_grouped(pattern))


@lru_cache(maxsize=4)
def _strides(pattern: str) -> regex.Pattern:
    return regex.compile(f"(?>(?>{_grouped(pattern)}){{{STRIDE}}})")


def boundaries(text: str, pattern: str, upto: int | None = None, since: int = 0) -> list[int]:
    """Ends of the pre-tokens of ``text``: all of them, or up to ``upto`` and from ``since`` on, the others passed over."""
    find, skip, out, at = pre_tokens(pattern), _strides(pattern), [], 0
    if upto is not None and upto < since:
        for m in find.finditer(text):
            if m.end() > upto:
                break
            at = m.end()
            out.append(at)
        while at < since and (m := skip.match(text, at)) and at < m.end() < since:
            at = m.end()
        return out + [p for m in find.finditer(text, at) if (p := m.end()) >= since]
    return [m.end() for m in find.finditer(text)]


def chunk_ranges(length: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of each chunk; each but the last reaches ``overlap`` characters into the next."""
    return [(a, min(length, a + chunk + overlap)) for a in range(0, max(length, 1), chunk)]


def candidate_seams(text: str, start: int, end: int, length: int, pattern: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of the chunk ``text`` = whole[start:end] that may be seams: in the overlap with the chunk before, after."""
    cuts = [p for p in boundaries(text, pattern, overlap, chunk) if (end == length or p <= len(text) - MARGIN) and not text[p - 1].isspace()]
    return [start + p for p in cuts if p <= overlap], [start + p for p in cuts if p >= chunk]


def seams(before: list[list[int]], after: list[list[int]]) -> list[int] | None:
    """The first common boundary in each overlap, or None where some overlap has none."""
    out = []
    for left, right in zip(after[:-1], before[1:], strict=True):
        common = set(left) & set(right)
        if not common:
            return None
        out.append(min(common))
    return out


def encode_chunked(text: str, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """One text by the chunked method on one machine; equals encoding it whole."""
    ranges = chunk_ranges(len(text), chunk, overlap)
    found = [candidate_seams(text[a:b], a, b, len(text), pattern, chunk, overlap) for a, b in ranges]
    at = seams([x for x, _ in found], [y for _, y in found])
    if at is None:
        return ids_of(text, path, pattern).tolist()
    cuts = [0, *at, len(text)]
    return [t for a, b in zip(cuts, cuts[1:]) for t in ids_of(text[a:b], path, pattern).tolist()]


def _ids_bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4", copy=False).tobytes()


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, then: tuple | None = None) -> DataFrame:
    """(doc_id, ids): every whole text's ids as little-endian uint32 bytes.  ``then`` (a function of such batches, the schema
    of what it gives) is applied where the ids are made, in the same Python worker and without another pass through the JVM.

    Nulls count as empty texts, which have no ids.  Repeated rows give a row each.  Texts of up to ``chunk`` characters
    are one chunk and never move between executors; only longer ones are dealt out by chunk.  Other columns take no
    part, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    more, schema = then or (None, "doc_id long, ids binary")

    def whole(own: DataFrame, at_once: int) -> DataFrame:
        ids = _encode_whole(path, pattern, at_once)
        return own.mapInArrow(trimmed((lambda batches: more(ids(batches))) if more else ids), schema)

    sewn, unsewn = _encode_long(rows.where(F.length("text") > chunk), path, pattern, chunk, overlap)
    short = rows.where(F.length("text") <= chunk).withColumn("copies", F.lit(1).cast("long"))
    return whole(short, 256).unionByName(sewn.mapInArrow(trimmed(more), schema) if more else sewn).unionByName(whole(unsewn, 1))


def _encode_whole(path: str, pattern: str, at_once: int):
    """Batches (doc_id, text, copies) to batches (doc_id, ids): each text encoded once, in as many rows as it has copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), at_once):
                own = batch.slice(at, at_once)
                ids = pa.array([_ids_bytes(ids_of(t, path, pattern)) for t in own.column("text").to_pylist()], pa.binary())
                left = own.column("copies").to_numpy()
                while (open_ := np.flatnonzero(left > 0)).size:  # a copy of each at a time, so that many copies of a long text need no more memory
                    yield pa.RecordBatch.from_arrays([own.column("doc_id").take(pa.array(open_)), ids.take(pa.array(open_))], ["doc_id", "ids"])
                    left = left - 1

    return run


def _encode_long(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, ids) of the texts whose chunks have seams, a row each row; (doc_id, text, copies) of the others, not yet encoded."""
    plain = pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("copies", pa.int64()), ("no", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("text", pa.string())])
    found_in = pa.schema([*plain, ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))])
    columns = "doc_id long, row string, copies long, no int, start long, length long, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x = batch.slice(i, 1).to_pylist()[0]
                for no, (a, b) in enumerate(chunk_ranges(len(x["text"]), chunk, overlap)):
                    yield pa.RecordBatch.from_pylist([x | {"no": no, "start": a, "length": len(x["text"]), "text": x["text"][a:b]}], schema=plain)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                a = x["start"]
                before, after = candidate_seams(x["text"], a, a + len(x["text"]), x["length"], pattern, chunk, overlap)
                yield pa.RecordBatch.from_pylist([x | {"before": before, "after": after}], schema=found_in)

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_ids_bytes(ids_of(x["text"][x["from_"] - x["start"] : x["to_"] - x["start"]], path, pattern)) for x in batch.select(["text", "start", "from_", "to_"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "copies", "no")), pa.array(ids, pa.binary())], ["doc_id", "row", "copies", "no", "ids"])

    # equal rows are encoded once and counted
    counted = rows.groupBy("doc_id", F.sha2("text", 256).alias("row")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    found = counted.mapInArrow(cut, columns).repartition("doc_id", "row", "no").mapInArrow(find, f"{columns}, before array<long>, after array<long>")
    of_text = Window.partitionBy("doc_id", "row")
    seam = F.array_min(F.array_intersect("after", F.lead("before").over(of_text.orderBy("no"))))
    last = F.col("start") + chunk >= F.col("length")
    sewn = found.withColumn("to_", F.when(last, F.col("length")).otherwise(seam)).drop("before", "after")
    sewn = sewn.withColumn("from_", F.coalesce(F.lag("to_").over(of_text.orderBy("no")), F.lit(0))).withColumn("open", F.max(F.col("to_").isNull()).over(of_text))
    parts = sewn.where("not open").mapInArrow(trimmed(encode_pieces), "doc_id long, row string, copies long, no int, ids binary")
    in_order = F.array_sort(F.collect_list(F.struct("no", "ids")))
    joined = parts.groupBy("doc_id", "row", "copies").agg(F.aggregate(in_order, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
    chunks = F.array_sort(F.collect_list(F.struct("no", F.substring("text", 1, chunk).alias("text"))))
    unsewn = sewn.where("open").groupBy("doc_id", "row", "copies").agg(F.array_join(chunks["text"], "").alias("text"))
    return joined.withColumn("_", F.explode(F.expr("sequence(1L, copies)"))).select("doc_id", "ids"), unsewn.select("doc_id", "text", "copies")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, data): adds the bytes that the ids stand for; null and empty ids give none; repeated rows are decoded each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            data = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, data binary")


def digester(path: str, pattern: str, carried: bool = False) -> tuple:
    """``digests`` (``decoded``, if ``carried``) as a function of batches (doc_id, ids), and the schema of what it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 256):
                piece = batch.slice(at, 256)
                counts, ids_sha, data_sha = [], [], []
                for raw in piece.column("ids"):
                    ids = np.frombuffer(raw.as_buffer() or b"", "<u4").tolist()
                    counts.append(len(ids))
                    ids_sha.append(None if carried else hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    data_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                first = piece.column("ids") if carried else pa.array(ids_sha, pa.string())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts, pa.int64()), first, pa.array(data_sha, pa.string())], ["doc_id", "n_tokens", "ids" if carried else "ids_sha256", "decoded_sha256"])

    return run, "doc_id long, n_tokens long, ids binary, decoded_sha256 string" if carried else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digested(encoded: DataFrame, path: str, pattern: str, carried: bool) -> DataFrame:
    run, schema = digester(path, pattern, carried)
    return encoded.mapInArrow(trimmed(run), schema)


def digests(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: count of ids, SHA-256 of the decimal ids joined by spaces, SHA-256 of the decoded bytes; null ids count as none."""
    return _digested(encoded, path, pattern, False)


def decoded(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the ids with the SHA-256 of the bytes that they decode to; a row each, null ids as none."""
    return _digested(encoded, path, pattern, True)
