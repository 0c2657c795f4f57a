"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set holds its distinct ``WORDS``-word shingles.  Two sets of sizes m and n link when their overlap reaches
T = ceil(t / (1 + t) (m + n)), which is at least ceil(t n).  DivideSkip sets aside the L longest inverted lists of a
query: a partner must occur T - L times in the remaining, short lists, and only such ids are probed in the long ones.

* Over all documents, L = ceil(t n) - ``COUNT``: the other, rarest shingles of each set are posted, and two sets become
  candidates when ``COUNT`` of their short lists meet, at places from which the rest of both sets can still reach T.
* Candidates are gathered by query in chunks of bounded size.  There ``divide_skip`` builds the inverted lists of the
  query's shingles, merges the short ones with a heap (skipping ahead by binary search), probes the long ones by binary
  search and keeps the members that reach their T: the exact overlap decides.

What keeps it in bounds:

* Equal sets are one class from the start; classes are what is joined.  A class is named by 64 bits of a 128-bit hash of
  its set, or by the other 64 where two classes have the first ones in common.
* "Rare" is a global order (level, hash): level is log2 of the shingle's count over all documents where that is at
  least ``LEAST`` (raised by doubling until at most ``LEVEL_KEYS`` shingles have one), else 0.  Levels travel as a
  table of fixed size; two shingles that share a cell only change the order, never the result.
* The list of a shingle that many documents hold is dealt out over several buckets by a hash of the class.
* A list is not turned into all its pairs.  Its sets are compared with one pivot per size step (sizes within 1/t link
  at all), those that link become components, and lists that still hold several components get further pivots while
  the pairs left outnumber the postings.  Only then are they joined, across components only.  A pair that is skipped
  lies within one component, so no component is lost.
* Size bounds and a 512-bit parity bitmap (its Hamming distance bounds the symmetric difference from below) drop
  candidates before any set is fetched.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.linking import BITMAP, cap, components, may_link, settle
from siftline.llm.runtime import BLOCK_BYTES, Texts, buckets_for, dropped, materialise, row_key, trimmed, unused

WORDS, THRESHOLD = 5, 0.8
#: Short lists that two sets must have in common, at most; weight of a list's length when lists are divided.
COUNT, MU = 2, 0.0085
#: Cells of the level table and bits of the filter of candidates (of fixed size, as the parity bitmap is).
LEVEL_BITS, FILTER_BITS = 24, 27
LEVEL_KEYS, LEAST = 1 << 20, 16
#: Level (log2 of the documents that hold a shingle) from which its list is dealt out over several buckets.
HOT_LEVEL = 10
#: Bytes of the members' sets that a query meets at once.
CHUNK_BYTES = 256 << 10
#: Rows of documents to a bucket of shingles; postings or counts that a task holds before it passes them on.
ROWS_PER_BUCKET, FLUSH = 1024, 1 << 20
#: Classes that share 64 bits of their hashes: none at all is likely below some 10**9 classes.
MOST_TWINS = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_TABLE = _BYTE[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts of a flat buffer, in order, and the number of words before each text's end."""
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = offsets[:-1] - base
    firsts = firsts[firsts < len(data)]
    start[firsts] |= inside[firsts]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(at, np.diff(np.append(at, len(data)))) if at[0] == 0 else np.concatenate([np.zeros(at[0], np.int64), np.repeat(at, np.diff(np.append(at, len(data))))])
    longest = int(place[inside].max()) + 1
    powers = np.resize(_PLACE, longest)
    if longest > len(_PLACE):  # long words: another multiplier each 64 bytes, 1 for the first
        powers = powers * np.repeat(mix(np.arange(-(-longest // 64), dtype=np.uint64)) | np.uint64(1), 64)[:longest]
    terms = _TABLE[data]
    terms *= powers[np.minimum(place, longest - 1)]
    terms[~inside] = 0
    ends = np.searchsorted(at, offsets[1:] - base)
    return mix(np.add.reduceat(terms, at)), ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a flat buffer."""
    hashed, ends = word_hashes(data, offsets)
    multiply = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    m = max(0, len(hashed) - words + 1)
    rolled = np.zeros(m, np.uint64)
    for j in range(words):
        rolled += hashed[j : j + m] * multiply[j]
    rolled = mix(rolled)
    out, begin = [], 0
    for end in ends.tolist():
        n = end - begin
        if n >= words:
            own = np.sort(rolled[begin : end - words + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:  # fewer words: the sequence is the one shingle, salted by its length
            own = mix((hashed[begin:end] * multiply[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        begin = end
    return out


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = Texts(batch.column("text"))
    for a, b in texts.blocks(BLOCK_BYTES):
        yield from zip(range(a, b), shingle_sets(texts.data, texts.offsets[a : b + 1], words))


def class_of(own: np.ndarray, twins: frozenset[int] = frozenset()) -> tuple[int, int]:
    """(class, check): the halves of a 128-bit hash of the set, signed; the check is the class where the first half is a twin."""
    both = xxhash.xxh3_128_intdigest(own.tobytes(), seed=len(own)).to_bytes(16, "little", signed=False)
    first, second = int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)
    return (second, first) if first in twins else (first, second)


def parity(own: np.ndarray) -> np.ndarray:
    bits = np.bincount((own & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _buckets(keys: np.ndarray, bits: int, total: int) -> np.ndarray:
    """Splits sorted keys of ``bits`` bits into ``total`` (a power of two) ranges: where each bucket begins."""
    shift = bits - total.bit_length() + 1
    edges = np.arange(total, dtype=np.uint64) << np.uint64(shift)
    return np.append(np.searchsorted(keys, edges.astype(keys.dtype)), len(keys))


def _sketch(words: int, total: int):
    """Per document: class, size, bitmap; and per flush and bucket the counts of the shingles' 32-bit keys."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        edges = _buckets(keys, 32, total)
        full = [b for b in range(total) if edges[b + 1] > edges[b]]
        lone = [keys[edges[b] : edges[b + 1]][counts[edges[b] : edges[b + 1]] == 1].tobytes() for b in full]
        more = [np.stack([keys[edges[b] : edges[b + 1]], counts[edges[b] : edges[b + 1]].astype(np.uint32)])[:, counts[edges[b] : edges[b + 1]] > 1].tobytes() for b in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(lone, pa.binary()), pa.array(more, pa.binary())], ["bucket", "lone", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, own in _sets(batch, words):
                held.append((own >> np.uint64(32)).astype(np.uint32))
                size += len(own)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return trimmed(run)


def _count(table: pa.Table) -> pa.Table:
    lone = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("lone")]
    more = [np.frombuffer(x.as_buffer(), np.uint32).reshape(2, -1) for x in table.column("more")]
    keys = np.concatenate([*lone, *(x[0] for x in more)])
    weight = np.concatenate([np.ones(sum(map(len, lone)), np.int64), *(x[1].astype(np.int64) for x in more)])
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.add.reduceat(weight, at) if len(at) else np.zeros(0, np.int64)
    keep = counts >= LEAST
    return pa.table({"key": pa.array(keys[at][keep].astype(np.int64)), "n": pa.array(counts[keep])})


def levels(rows: DataFrame, words: int, total: int) -> np.ndarray:
    """The level table: for each cell the highest level of the frequent shingles that fall into it, else 0."""
    counted = rows.select("text").mapInArrow(_sketch(words, total), "bucket int, lone binary, more binary").groupBy("bucket").applyInArrow(_count, "key long, n long")
    counted = materialise(counted.select("key", F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("level")), "frequent", shuffled=True)
    by_level = sorted(((r.level, r["count"]) for r in counted.groupBy("level").count().collect()), reverse=True)
    lowest, held = None, 0
    for level, n in by_level:
        held += n
        if held > LEVEL_KEYS:
            break
        lowest = level
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    if lowest is not None:
        found = counted.where(F.col("level") >= lowest).toArrow()
        np.maximum.at(out, found.column("key").to_numpy() >> (32 - LEVEL_BITS), found.column("level").to_numpy().astype(np.uint8))
    dropped(counted)
    return out


def short_lists(n: int, threshold: float, count: int) -> int:
    """How many shingles of a set of ``n`` are posted: all but the L that DivideSkip sets aside; 0 where no other set can link."""
    return 0 if n < fewest(threshold) else min(n, n - overlap_of_one(n, threshold) + count)


def fewest(threshold: float) -> int:
    """The least overlap of two different sets that link: t <= o / (o + 1)."""
    t = round(threshold * 100)
    return -(-t // (100 - t)) if t < 100 else 1 << 60


def _prefixes(words: int, threshold: float, count: int, total: int, twins: frozenset[int], sent):
    """Per flush and bucket: (shingle, class, reach) of the short lists; reach bounds the share of the set that follows.

    Buckets below ``total`` hold whole lists; a frequent shingle's list lies dealt out by class over those from there on.
    """

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        # short lists hold low hashes for the most part; mixed again, they spread over all buckets
        t, c, reach, rank = (np.concatenate(x) for x in zip(*held))
        t = mix(t)
        hot = rank >= HOT_LEVEL
        salt = mix(c.view(np.uint64)) & ((np.uint64(2) << (np.maximum(rank, HOT_LEVEL) - HOT_LEVEL).astype(np.uint64)) - np.uint64(1))
        place = np.where(hot, mix(t + salt * np.uint64(0x9E3779B97F4A7C15)), t)
        for first, own in ((0, np.flatnonzero(~hot)), (total, np.flatnonzero(hot))):
            own = own[np.argsort(place[own], kind="stable")]
            edges = _buckets(place[own], 64, total)
            full = [b for b in range(total) if edges[b + 1] > edges[b]]
            if full:
                yield pa.RecordBatch.from_arrays([pa.array([first + b for b in full], pa.int32()), *(pa.array([v[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()) for v in (t[own], c[own], reach[own]))], ["bucket", "tokens", "classes", "reach"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, held, size, seen = sent.value, [], 0, set()
        for batch in batches:
            for _, own in _sets(batch, words):
                n = len(own)
                short = short_lists(n, threshold, count)
                if not short or (name := class_of(own, twins)[0]) in seen:
                    continue
                seen.add(name)
                rank = level[(own >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]
                # the sets are sorted by hash, so a stable sort by level gives the order (level, hash)
                order = np.argsort(rank, kind="stable")[:short]
                rest = n - 1 - np.arange(short)
                held.append((own[order], np.full(short, name, np.int64), (-(-rest * 255 // n)).astype(np.uint8), rank[order]))
                size += short
                if size >= FLUSH:
                    yield from flush(held)
                    held, size, seen = [], 0, set()
        if size:
            yield from flush(held)

    return trimmed(run)


def _merge(total: int):
    """Joins the runs of a bucket to lists; of whole lists those of two classes or more stay."""

    def run(table: pa.Table) -> pa.Table:
        t, c, reach = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]) for name, kind in (("tokens", np.uint64), ("classes", np.int64), ("reach", np.uint8)))
        order = np.lexsort((c, t))
        t, c, reach = t[order], c[order], reach[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])]) if len(t) else np.zeros(0, bool)
        t, c, reach = t[new], c[new], reach[new]
        if table.column("bucket")[0].as_py() < total:
            first = np.concatenate([[True], t[1:] != t[:-1]]) if len(t) else np.zeros(0, bool)
            length = np.diff(np.append(np.flatnonzero(first), len(t)))
            keep = np.repeat(length > 1, length)
            t, c, reach = t[keep], c[keep], reach[keep]
        return pa.table({"token": pa.array(t.view(np.int64)), "class": pa.array(c), "reach": pa.array(reach.astype(np.int16))})

    return run


def overlap_of_one(n: int, threshold: float) -> int:
    """The least overlap that a set of n shares with any partner: ceil(threshold n), in whole numbers."""
    return -(-n * round(threshold * 100) // 100)


def overlap_of_two(m: int, n: int, threshold: float) -> int:
    """T: the least overlap at which sets of m and n link."""
    t = round(threshold * 100)
    return -(-t * (m + n) // (100 + t))


# -- the search at one query ----------------------------------------------------------------------------------------------


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(id, in how many lists) of the ids in ``least`` of the sorted lists or more, by a heap of their heads.

    An id in fewer lists lets ``least`` - 1 lists skip, by binary search, to the least head of the others.
    """
    heap = [(own[0], k, 0) for k, own in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield top, len(popped)
            to = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            to = heap[0][0]
        for _, k, j in popped:
            if (j := bisect_left(lists[k], to, j)) < len(lists[k]):
                heapq.heappush(heap, (lists[k][j], k, j))


def divide_skip(query: np.ndarray, members: list[np.ndarray], threshold: float) -> list[int]:
    """The places of the members (sorted sets, as the query is) that link with the query."""
    need = [overlap_of_two(len(query), len(m), threshold) for m in members]
    at = np.searchsorted(query, tokens := np.concatenate(members))
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    hit = query[np.minimum(at, len(query) - 1)] == tokens
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")  # the owners of a shingle stay in order
    owner = owner[order].tolist()
    edges = np.searchsorted(at[order], np.arange(len(query) + 1)).tolist()
    lists = sorted((owner[a:b] for a, b in zip(edges, edges[1:]) if b > a), key=len)
    least = min(need)
    if len(lists) < least:
        return []
    longest = min(int(least / (MU * math.log2(len(lists[-1])) + 1)), least - 1)
    short, long = lists[: len(lists) - longest], lists[len(lists) - longest :]
    found = []
    for i, count in merge_skip(short, least - longest):
        left = need[i] - count
        for k, own in enumerate(long):
            if left <= 0 or left > len(long) - k:
                break
            j = bisect_left(own, i)
            left -= j < len(own) and own[j] == i
        if left <= 0:
            found.append(i)
    return found


def _search(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that link, of pairs (query, member, m): each query meets its members in chunks of CHUNK_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, query, ids, held = None, None, [], []

        def out() -> pa.RecordBatch:
            kept = [ids[i] for i in divide_skip(query, held, threshold)] if held else []
            of = key[0] if key else 0
            return pa.RecordBatch.from_arrays([pa.array([min(of, i) for i in kept], pa.int64()), pa.array([max(of, i) for i in kept], pa.int64())], ["a", "b"])

        for batch in batches:
            for q, chunk, kind, name, own in zip(*(batch.column(c).to_pylist() for c in ("query", "chunk", "kind", "id")), batch.column("set")):
                if (q, chunk) != key:
                    if held:
                        yield out()
                    key, ids, held = (q, chunk), [], []
                own = np.frombuffer(own.as_buffer(), np.uint64)
                if kind == 0:
                    query = own
                elif not ids or ids[-1] != name:  # a set that several tasks made comes several times
                    ids.append(name)
                    held.append(own)
        if held:
            yield out()

    chunks = pairs.groupBy("query").agg(F.ceil(F.sum("m") * 8 / CHUNK_BYTES).alias("chunks"))
    named = sets.select(F.expr("class + 0").alias("id"), "set")
    dealt = pairs.select("query", "member").join(chunks.select(F.expr("query + 0").alias("of"), "chunks"), F.col("query") == F.col("of"))
    members = dealt.select("query", F.pmod(F.xxhash64("member"), F.col("chunks")).alias("chunk"), F.lit(1).alias("kind"), "member").join(named, F.col("member") == F.col("id")).select("query", "chunk", "kind", "id", "set")
    heads = chunks.join(named, F.col("query") == F.col("id")).select("query", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), "id", "set")
    rows = heads.unionByName(members).repartition("query", "chunk").sortWithinPartitions("query", "chunk", "kind", "id")
    return rows.mapInArrow(trimmed(run), "a long, b long")


def _prune(pairs: DataFrame, info: DataFrame, threshold: float) -> DataFrame:
    """(a, b, query, member, m): the pairs that size and bitmap leave; m is the member's size."""
    sides = [info.select(F.expr("class + 0").alias(f"of_{v}"), F.struct("n", *(f"b{i}" for i in range(BITMAP))).alias(v)) for v in ("x", "y")]
    x = pairs.join(sides[0], F.col("a") == F.col("of_x")).join(sides[1], F.col("b") == F.col("of_y")).where(may_link("x", "y", threshold))
    asks = F.col("query") == F.col("a")
    return x.select("a", "b", "query", F.when(asks, F.col("b")).otherwise(F.col("a")).alias("member"), F.when(asks, F.col("y.n")).otherwise(F.col("x.n")).alias("m"))


def _fetch(rows: DataFrame, pairs: DataFrame, owners: DataFrame, words: int, twins: frozenset[int]) -> DataFrame:
    """(class, set) of the classes of ``pairs``, made again from the text of each class's least row key.

    A filter of fixed size tells most of the other texts apart before they are shingled; those that pass it by chance
    find no partner in the joins that follow.  Where more texts are asked for than the filter can hold, texts and row
    keys are joined instead.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(owners, F.col("class") == F.col("of")).select("own")
    asked = materialise(asked, "asked", shuffled=True)
    cell = F.shiftrightunsigned(F.xxhash64("own"), 64 - FILTER_BITS)
    marks = asked.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    named = rows.select("text", F.col("key").alias("own"))
    crowded = int(np.bitwise_count(table).sum()) > 1 << (FILTER_BITS - 3)
    if crowded:
        named = named.join(asked.select(F.expr("own + 0").alias("of")), F.col("own") == F.col("of"), "left_semi")
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, ids, held, size = sent.value, set(), [], [], 0
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            batch = batch.filter(pa.array((table[cells >> 6] >> (cells & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            for _, own in _sets(batch, words):
                name = class_of(own, twins)[0]
                if len(own) and name not in seen:
                    seen.add(name)
                    ids.append(name)
                    held.append(own.tobytes())
                    size += len(held[-1])
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], ["class", "set"])
                    ids, held, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], ["class", "set"])

    cells = F.shiftrightunsigned(F.xxhash64("own"), 64 - FILTER_BITS)
    out = materialise(named.select("text", cells.alias("cell")).mapInArrow(trimmed(run), "class long, set binary"), "sets", shuffled=True)
    sent.destroy()
    dropped(asked)
    return out


# -- the join -------------------------------------------------------------------------------------------------------------


def _described(rows: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, key, class, check, size of the set, bitmap."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own for _, own in _sets(batch, words)]
            bits = np.stack([parity(own) for own in sets]) if sets else np.zeros((0, BITMAP), np.int64)
            names = [class_of(own) for own in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64()), pa.array([len(own) for own in sets], pa.int64()), *(pa.array(bits[:, i]) for i in range(BITMAP))], ["doc_id", "key", "class", "check", "n", *(f"b{i}" for i in range(BITMAP))])

    return rows.mapInArrow(trimmed(describe), "doc_id long, key long, class long, check long, n long, " + ", ".join(f"b{i} long" for i in range(BITMAP)))


def _twins(described: DataFrame) -> frozenset[int]:
    """The classes whose sets differ in the other half of their hashes."""
    twins = frozenset(r["class"] for r in described.groupBy("class").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").limit(MOST_TWINS + 1).collect())
    if len(twins) > MOST_TWINS:
        raise RuntimeError("too many sets share the first half of their hashes")
    return twins


def _linked(rows: DataFrame, described: DataFrame, twins: frozenset[int], words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b): links between classes, enough of them for the components; (class, root): the components of linked classes."""
    count = max(1, min(COUNT, fewest(threshold)))
    total = 1 << (buckets_for(rows.count(), ROWS_PER_BUCKET) - 1).bit_length()
    sent = rows.sparkSession.sparkContext.broadcast(levels(rows, words, total))
    merged = rows.select("text").mapInArrow(_prefixes(words, threshold, count, total, twins, sent), "bucket int, tokens binary, classes binary, reach binary").groupBy("bucket").applyInArrow(_merge(total), "token long, class long, reach short")
    lists = materialise(merged, "lists", shuffled=True)
    sent.destroy()

    # one row a class that shares a short list: its size, bitmap, and how many shared lists it is in
    weight = lists.groupBy("class").agg(F.count("*").alias("lists"))
    info = described.where("n > 0").groupBy("class").agg(F.min("key").alias("own"), F.first("n").alias("n"), *(F.first(f"b{i}").alias(f"b{i}") for i in range(BITMAP)))
    info = info.join(weight, "class").withColumn("weight", (F.col("lists") / F.col("n")).cast("float")).withColumn("step", F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold))).cast("int"))
    # the shingles of a short list that nobody shares are in no other set
    posted = F.least("n", F.col("n") - F.ceil(F.col("n") * round(threshold * 100) / 100) + count)
    info = info.withColumn("cap", cap(F.col("n"), F.col("n") - F.greatest(posted - F.col("lists"), F.lit(0)), threshold))
    info = materialise(info.drop("lists"), "classes", shuffled=True)
    owners = info.select(F.expr("class + 0").alias("of"), "own")
    of = info.select(F.expr("class + 0").alias("of"), "n", "cap", "step", "weight")
    postings = materialise(lists.join(of, lists["class"] == of["of"]).drop("of"), "posted", shuffled=True)
    dropped(lists)

    def linked(pairs: DataFrame) -> DataFrame | None:
        pairs = materialise(_prune(pairs, info, threshold), "pairs", shuffled=True)
        if not pairs.limit(1).count():
            return None
        sets = _fetch(rows, pairs, owners, words, twins)
        out = materialise(_search(pairs, sets, threshold), "links", shuffled=True)
        dropped(sets, pairs)
        return out

    out = settle(postings, linked, threshold, count, info.select("class", *(f"b{i}" for i in range(BITMAP))))
    dropped(info)
    return out


def _solved(docs: DataFrame, key: Column, words: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per row: doc_id, key, class, n; links between classes; (of, root): component of each linked class."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key"))
    described = materialise(_described(rows, words), "described", shuffled=True)
    if twins := _twins(described):
        described = described.withColumn("class", F.when(F.col("class").isin(*twins), F.col("check")).otherwise(F.col("class")))
    links, root = _linked(rows, described, twins, words, threshold)
    return described.select("doc_id", "key", "class", "n"), links, root.select(F.expr("class + 0").alias("of"), "root")


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_tree_links): one row per row of ``docs``.  Runs its jobs when it is called.

    component_id is the least doc_id that links reach, itself included (null if none of them has one).  n_tree_links
    counts the verified links of the document's class that the search needed to find the components: one at least where
    the class has any, but not all of them inside a component, whose number grows with the square of a group of near
    copies.  Null texts and texts without words are empty sets, linked with nothing; equal rows, and equal sets, share a
    component, whatever their ids; an empty table gives no rows; other columns take no part.  Shingles are 64-bit
    hashes, classes 128-bit ones.
    """
    described, links, root = _solved(docs, F.xxhash64("doc_id", "text"), words, threshold)
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_tree_links"))
    owner = described.groupBy("class").agg(F.min("doc_id").alias("own"))
    labels = owner.join(root, F.col("class") == F.col("of"), "left").drop("of").withColumn("root", F.coalesce("root", "class"))
    least = materialise(labels.groupBy("root").agg(F.min("own").alias("component_id")), "least", shuffled=True)  # so the join can split a hot component
    labels = labels.join(least.select(F.expr("root + 0").alias("of"), "component_id"), F.col("root") == F.col("of")).join(degree, "class", "left")
    labels = labels.select(F.expr("class + 0").alias("of"), "component_id", F.coalesce("n_tree_links", F.lit(0)).alias("n_tree_links"))
    out = described.select("doc_id", "class", "n").join(labels, F.col("class") == F.col("of"))
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, 0).otherwise(F.col("n_tree_links")).cast("long").alias("n_tree_links"))


def keep_first(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, one of each component: the one of the least doc_id (rows without an id last; ties: the least
    hash of the whole row).  Decisions go by row, not by doc_id: rows of one id whose texts do not link all stay, of
    wholly equal rows one stays.  Rows with empty sets all stay.  Columns and their order stay, whatever their names; an
    empty table gives no rows.  Runs its jobs when it is called.
    """
    described, _, root = _solved(docs, row_key(docs), words, threshold)
    x = described.where("n > 0").join(root, F.col("class") == F.col("of"), "left").select("doc_id", "key", F.coalesce("root", "class").alias("root"))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")
    groups = x.groupBy("root").agg(F.count("*").alias("size"), F.min(place).alias("first")).where("size > 1").select(F.expr("root + 0").alias("of"), "first")
    groups = materialise(groups, "groups", shuffled=True)  # a table beside the rows: the join can then split a hot component
    rows = x.groupBy("root", "doc_id", "key").agg(F.count("*").alias("copies")).join(groups, F.col("root") == F.col("of"))
    stays = F.col("key").eqNullSafe(F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    marks = materialise(rows.select("key", "doc_id", stays.alias("stays"), "copies").where("NOT stays OR copies > 1"), "marks", shuffled=True)

    key, of_key, of_id = (unused(docs.columns, x) for x in ("key", "of_key", "of_id"))
    keyed = docs.withColumn(key, row_key(docs))
    marked = marks.select(F.col("key").alias(of_key), F.col("doc_id").alias(of_id), "stays")
    on = (F.col(key) == F.col(of_key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(of_id))
    kept = keyed.join(marked.drop("stays"), on, "left_anti")
    once = keyed.join(marked.where("stays").drop("stays"), on, "left_semi").dropDuplicates([key, "doc_id"])
    return kept.unionByName(once).select(*(f"`{c}`" for c in docs.columns))


__all__ = ["components", "divide_skip", "join", "keep_first", "levels", "merge_skip", "shingle_sets", "word_hashes"]
