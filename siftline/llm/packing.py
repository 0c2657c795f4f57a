"""Token-id output: best-fit-decreasing packing into fixed-length rows of ids, written as binary shards.

Texts are encoded and cut losslessly into segments of at most ``seq_len`` ids.  Segments are dealt by a hash of
(doc_id, segment number, ids) into groups of about ``group_segments``, so neither a hot source nor a very long text nor
rows without an id fill one group, and each group is packed by itself: longest segment first, each into the fullest row
that still holds it.  A segment tree over capacities 0..seq_len finds that row in O(log seq_len).

A packed group is a shard: the id matrix, the cumulative segment lengths and the position resets as raw little-endian
arrays.  Shards are rows of a Parquet table, so Spark's commit protocol covers them and a lost executor costs the tasks
that it ran; ``export`` writes them as plain files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import bpe
from siftline.llm.runtime import buckets_for, materialise, trimmed

SEQ_LEN, GROUP_SEGMENTS = 2048, 2048
#: Ids of padding; the position of padding is never read, as cu_seqlens ends before it.
PAD = 0
#: Columns of a shard. ``ids``: rows x seq_len ids of ``id_bytes`` bytes; ``cu_counts``: how many of the numbers in
#: ``cu_seqlens`` (0, then each segment's end) a row has; ``resets``: offsets at which positions begin again, row by
#: row; ``starts``: the position within its text of each segment's first id.
SHARD = "group long, n_rows int, seq_len int, id_bytes int, ids binary, cu_counts binary, cu_seqlens binary, resets binary, starts binary, doc_ids array<long>, segments binary"


class CapacityTree:
    """Multiset of open rows by free capacity; finds the least capacity that is large enough."""

    def __init__(self, largest: int):
        self.leaves = 1 << largest.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def best_fit(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, row) of the fullest row with at least ``need`` free, or None."""
        node, leaves, count = need + self.leaves, self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # climb until a right sibling holds rows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - leaves
        row = self.rows[capacity].pop()
        self._add(capacity, -1)
        return capacity, row


def best_fit_decreasing(lengths: list[int], seq_len: int) -> list[int]:
    """The row of each segment; segments must be sorted longest first."""
    tree, out, rows = CapacityTree(seq_len), [], 0
    for n in lengths:
        if (found := tree.best_fit(n)) is None:
            found, rows = (seq_len, rows), rows + 1
        capacity, row = found
        out.append(row)
        if capacity > n:
            tree.put(capacity - n, row)
    return out


def splitter(seq_len: int):
    """Cuts texts' ids into segments: batches (doc_id, ids as uint32) to batches (doc_id, segment, n, ids)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                doc, no, sizes, ids = [], [], [], []
                for doc_id, raw in zip(batch.column("doc_id").slice(first, 256).to_pylist(), batch.column("ids").slice(first, 256)):
                    whole = np.frombuffer(raw.as_buffer() if raw.is_valid else b"", "<u4")
                    small = len(whole) and whole.max() < 1 << 16  # two bytes an id halve the shuffle
                    whole = whole.astype("<u2") if small else whole
                    for k, at in enumerate(range(0, len(whole), seq_len)):
                        doc.append(doc_id)
                        no.append(k)
                        sizes.append(min(seq_len, len(whole) - at))
                        ids.append(whole[at : at + seq_len].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(sizes, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "segment", "n", "ids"])

    return split, "doc_id long, segment int, n int, ids binary"


def pack(segments: DataFrame, most: int, seq_len: int = SEQ_LEN, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """Shards (``SHARD``) of segments as ``splitter`` makes them; ``most`` bounds their number, which sets the groups.

    Null and empty texts have no ids and so no segment; equal rows are packed each; ties go by doc_id, segment, bytes.
    Ids take two bytes in a shard where all of its ids allow it.  An empty table gives no rows.  Other columns are ignored.
    """
    groups = buckets_for(most, group_segments)

    def pack_group(table: pa.Table) -> pa.Table:
        docs, segs, raw = (table.column(c).to_pylist() for c in ("doc_id", "segment", "ids"))
        ns = table.column("n").to_pylist()
        order = sorted(range(len(raw)), key=lambda i: (-ns[i], docs[i] is None, docs[i] or 0, segs[i], raw[i]))
        row_of = best_fit_decreasing([ns[i] for i in order], seq_len)
        members: list[list[int]] = [[] for _ in range(max(row_of, default=-1) + 1)]
        for i, row in zip(order, row_of):
            members[row].append(i)
        wide = any(len(raw[i]) > 2 * ns[i] for i in order)
        matrix = np.full((len(members), seq_len), PAD, "<u4" if wide else "<u2")
        ends = []
        for row, own in enumerate(members):
            ends.append(np.concatenate([[0], np.cumsum([ns[i] for i in own])]).astype("<i4"))
            matrix[row, : ends[-1][-1]] = np.concatenate([np.frombuffer(raw[i], "<u2" if len(raw[i]) == 2 * ns[i] else "<u4") for i in own])
        flat = [i for own in members for i in own]
        values = {
            "group": table.column("group")[0].as_py(), "n_rows": len(members), "seq_len": seq_len, "id_bytes": matrix.itemsize, "ids": matrix.tobytes(),
            "cu_counts": np.array([len(e) for e in ends], "<i4").tobytes(), "cu_seqlens": b"".join(e.tobytes() for e in ends), "resets": b"".join(e[:-1].tobytes() for e in ends),
            "starts": (np.array([segs[i] for i in flat], "<i8") * seq_len).tobytes(), "doc_ids": [docs[i] for i in flat], "segments": np.array([segs[i] for i in flat], "<i4").tobytes(),
        }
        kinds = {"group": pa.int64(), "n_rows": pa.int32(), "seq_len": pa.int32(), "id_bytes": pa.int32(), "doc_ids": pa.list_(pa.int64())}
        return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in values.items()})

    keyed = segments.withColumn("group", F.pmod(F.xxhash64("doc_id", "segment", "ids"), F.lit(groups)))
    return keyed.groupBy("group").applyInArrow(pack_group, SHARD)


def rows(shards: DataFrame) -> DataFrame:
    """One row a packed sequence: group, row, n_segments, n_tokens, id_bytes, ids, cu_seqlens, position_resets,
    position_starts, doc_ids, segments (number of the segment in its text)."""
    names = ("group", "row", "n_segments", "n_tokens", "id_bytes", "ids", "cu_seqlens", "position_resets", "position_starts", "doc_ids", "segments")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                x = {c: batch.column(c)[k] for c in batch.schema.names}
                raw = {c: np.frombuffer(x[c].as_buffer(), kind) for c, kind in (("cu_counts", "<i4"), ("cu_seqlens", "<i4"), ("resets", "<i4"), ("starts", "<i8"), ("segments", "<i4"))}
                docs, width, ids = x["doc_ids"].as_py(), x["seq_len"].as_py() * x["id_bytes"].as_py(), x["ids"].as_py()
                to = np.cumsum(raw["cu_counts"])
                own = to - np.arange(1, len(to) + 1)  # a row has one segment less than numbers in cu_seqlens
                out = []
                for row, (a, b, c, d) in enumerate(zip(to - raw["cu_counts"], to, own - raw["cu_counts"] + 1, own)):
                    cu = raw["cu_seqlens"][a:b]
                    out.append((x["group"].as_py(), row, int(d - c), int(cu[-1]), x["id_bytes"].as_py(), ids[row * width : (row + 1) * width], cu, raw["resets"][c:d], raw["starts"][c:d], docs[c:d], raw["segments"][c:d]))
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out), kinds)], list(names))

    schema = "group long, row int, n_segments int, n_tokens int, id_bytes int, ids binary, cu_seqlens array<int>, position_resets array<int>, position_starts array<long>, doc_ids array<long>, segments array<int>"
    return shards.mapInArrow(trimmed(run), schema)


def segments_at_most(docs: DataFrame, seq_len: int) -> int:
    """A bound of the number of segments: an id has a byte at least, and each text ends in one short segment at most."""
    found = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce(F.col("text"), F.lit("")))).alias("size")).first()
    return found.n + (found.size or 0) // seq_len


def write(docs: DataFrame, path: str, pattern: str, seq_len: int = SEQ_LEN, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """The shards of all texts of ``docs``, written to the shared folder.  Runs its jobs when it is called."""
    segments = bpe.encode(docs, path, pattern, then=splitter(seq_len))
    return materialise(pack(segments, segments_at_most(docs, seq_len), seq_len, group_segments), "shards")


def export(shards: DataFrame, folder: str) -> list[str]:
    """Writes each shard's arrays as files ``<group>.<array>.bin`` of a folder that this machine sees, one shard in memory at
    a time; a file gets its name when it is whole."""
    os.makedirs(folder, exist_ok=True)
    paths = []
    for shard in shards.toLocalIterator():
        for name in ("ids", "cu_counts", "cu_seqlens", "resets", "starts", "segments"):
            paths.append(os.path.join(folder, f"{shard.group:08d}.{name}.bin"))
            with open(f"{paths[-1]}.part", "wb") as f:
                f.write(shard[name])
            os.replace(f"{paths[-1]}.part", paths[-1])
    return paths


__all__ = ["best_fit_decreasing", "CapacityTree", "export", "pack", "rows", "segments_at_most", "splitter", "write"]
