"""Suffix-array deduplication: removes every byte of a ``WINDOW``-byte string that also starts elsewhere.

A suffix array of a corpus can't be made in one place, so texts are first cut so that equal windows meet in one task:

* Each window has a key, the least hash of its ``GRAM``-byte substrings.  Equal windows have equal keys.  Neighbouring
  windows mostly share theirs; a piece is such a stretch (at most ``PIECE`` windows, each in exactly one piece).
* A key whose substring occurs once holds nothing that repeats; only the pieces of the other keys are cut from the
  texts, equal pieces once with their number of copies (named by the key and a 64-bit digest: 128 bits).
* The pieces of a task's keys, about ``UNIT`` bytes, are joined to one string, and its suffixes are sorted to the depth
  of a window by two-stage sorting (``suffix_order``): suffixes smaller than their successors are sorted directly, the
  others are induced by scanning the buckets of first bytes.  Common prefixes of neighbours then tell equal windows.
* A key with more bytes than a unit (passages that very many texts share, in different surroundings) is dealt out to
  several units; each sorts its share and sends the distinct windows that it found, by SHA-256, and windows that two
  units found repeat as well.  So no group is larger than a unit, and nothing is capped.

Spans go back to the rows of the texts by the piece's name.  Rows are told apart by a number that is written with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.runtime import Texts, buckets_for, dropped, materialise, trimmed, unused

WINDOW, GRAM, PIECE = 200, 50, 4096
#: Bytes of pieces that are sorted together, about.
UNIT = 1 << 20
#: An odd multiplier, its inverse modulo 2^64, and one to mix with.
ODD, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INVERSE = pow(ODD, -1, 1 << 64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: prefix minima of blocks, from the left and from the right."""
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(right[:count], left[width - 1 : width - 1 + count])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of each ``gram`` bytes of ``data``."""
    n = len(data)
    with np.errstate(over="ignore"):
        down, up = np.full(n, INVERSE, np.uint64), np.full(n - gram + 1, ODD, np.uint64)
        down[0] = up[0] = 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(down), out=sums[1:])
        hashes = (sums[gram:] - sums[: n - gram + 1]) * np.multiply.accumulate(up)
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(MIX)
        hashes ^= hashes >> np.uint64(29)
    return hashes


def key_places(hashes: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """Places of the substrings that are the key of a window: their hash is the largest key of the windows around."""
    edge = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
    return np.flatnonzero(~sliding_least(np.concatenate([edge, ~keys, edge]), width) == hashes)


def hits(places: np.ndarray, hashes: np.ndarray, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """How often the key of each piece occurs in it: equal windows inside of a piece need two."""
    first, last = np.searchsorted(places, starts), np.searchsorted(places, starts + counts + width - 1)
    n = last - first
    at = places[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
    piece = np.repeat(np.arange(len(starts)), n)
    return np.bincount(piece[hashes[at] == keys[starts][piece]], minlength=len(starts))


def cut_pieces(keys: np.ndarray, fresh: np.ndarray, longest: int) -> np.ndarray:
    """Starts of the pieces among windows: where the key changes, a text begins (``fresh``), or a piece gets too long."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]) | fresh)
    lengths = np.diff(np.append(starts, len(keys)))
    if (lengths > longest).any():
        parts = -(-lengths // longest)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + inner * longest
    return starts


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``data`` in order of their first ``depth`` bytes, or deeper, by two-stage sorting."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    # a suffix is smaller than its successor if the next byte that differs is larger; at the end it is larger
    change = np.flatnonzero(np.concatenate([data[1:] != data[:-1], [True]]))
    rises = np.append(data[change[:-1] + 1] > data[change[:-1]], False)
    small = np.repeat(rises, np.diff(change, prepend=-1))
    direct = np.flatnonzero(small)
    # 8 bytes first, by numpy; the full depth by comparing byte strings, which are nearly in order then
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | padded[j : j + n].astype(np.uint64)
    direct = direct[np.argsort(words[direct], kind="stable")]
    raw = data.tobytes()
    direct = np.fromiter(sorted(direct.tolist(), key=lambda i: raw[i : i + depth]), np.int64, len(direct))

    sizes = np.bincount(data, minlength=256)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    order = np.zeros(n, np.int64)
    ends = np.bincount(data[direct], minlength=256)
    split = np.concatenate([[0], np.cumsum(ends)])
    filled = begins[:-1].copy()  # where the next larger-than-successor suffix of a byte goes
    order[filled[data[-1]]] = n - 1
    filled[data[-1]] += 1
    for byte in np.flatnonzero(sizes):
        at = begins[byte]
        while at < filled[byte]:  # stretches of the byte itself
            new = order[at : filled[byte]] - 1
            new = new[new >= 0]
            new = new[data[new] == byte]
            at = filled[byte]
            order[at : at + len(new)] = new
            filled[byte] += len(new)
        order[filled[byte] : begins[byte + 1]] = direct[split[byte] : split[byte + 1]]
        before = order[begins[byte] : begins[byte + 1]] - 1
        before = before[before >= 0]
        before = before[data[before] > byte]
        if not len(before):
            continue
        firsts = data[before]
        by = np.argsort(firsts, kind="stable")
        firsts, counts = firsts[by], np.bincount(firsts, minlength=256)
        inner = np.arange(len(by)) - np.repeat(np.cumsum(counts) - counts, counts)
        order[filled[firsts] + inner] = before[by]
        filled += counts
    return order


def same_prefix(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix but the first in ``order`` whether it has ``depth`` bytes in common with the one before it."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(b), bool)
    if len(data) < depth:
        return out
    long = (a <= len(data) - depth) & (b <= len(data) - depth)
    for probe in (depth - 1, depth // 2, 0, depth // 4):  # bytes that tell most pairs apart
        some = np.flatnonzero(long)
        long[some[data[a[some] + probe] != data[b[some] + probe]]] = False
    rows = np.lib.stride_tricks.sliding_window_view(data, depth)
    some = np.flatnonzero(long)
    for at in range(0, len(some), 1 << 14):
        these = some[at : at + (1 << 14)]
        out[these] = (rows[a[these]] == rows[b[these]]).all(axis=1)
    return out


def window_groups(pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of all pieces, ordered: their place in the joined pieces, their piece, and the group of equal ones."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(x) for x in pieces], np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    piece = np.repeat(np.arange(len(pieces)), lengths)
    order = suffix_order(data, window)
    group = np.concatenate([[0], np.cumsum(~same_prefix(data, order, window))]) if len(order) else order
    inside = order + window <= ends[order]
    return order[inside], piece[order[inside]], group[inside]


def stretches(flags: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the stretches of True within one piece."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.concatenate([[True], (np.diff(at) > 1) | (piece[at[1:]] != piece[at[:-1]])])
    return at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]


def _pieces(docs: DataFrame, window: int, gram: int, longest: int) -> DataFrame:
    """(row, start, windows, hits, key, digest) of every piece; texts under a window have none."""
    names, width = ["row", "start", "windows", "hits", "key", "digest"], window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = Texts(batch.column("text")), batch.column("row").to_numpy()
            for first, last in texts.blocks():
                offsets = texts.offsets[first : last + 1] - texts.offsets[first]
                data = texts.data[texts.offsets[first] : texts.offsets[last]]
                if len(data) < window:
                    continue
                hashes = gram_hashes(data, gram)
                keys = sliding_least(hashes, width)
                of = np.repeat(np.arange(last - first), np.diff(offsets))
                whole = of[: len(keys)] == of[window - 1 : window - 1 + len(keys)]  # windows in one text
                fresh = np.concatenate([[True], whole[1:] != whole[:-1]]) | np.concatenate([[True], of[1 : len(keys)] != of[: len(keys) - 1]])
                starts = cut_pieces(keys, fresh, longest)
                counts = np.diff(np.append(starts, len(keys)))
                good = whole[starts]
                starts, counts = starts[good], counts[good]
                often = hits(key_places(hashes, keys, width), hashes, keys, starts, counts, width)
                raw = memoryview(data)
                digests = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + m + window - 1]) for a, m in zip(starts.tolist(), counts.tolist())), np.uint64, len(starts))
                text = of[starts]
                yield pa.RecordBatch.from_arrays([pa.array(rows[first + text]), pa.array(starts - offsets[text]), pa.array(counts), pa.array(often), pa.array(keys[starts].view(np.int64)), pa.array(digests.view(np.int64))], names)

    return docs.select("row", "text").mapInArrow(trimmed(run), ", ".join(f"{x} long" for x in names))


def _cut(chosen: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(key, digest, copies, bytes): the chosen pieces' bytes, from the rows that they are first in."""
    lists = chosen.groupBy(F.col("at.row").alias("of")).agg(F.collect_list(F.struct("at.start", "at.windows", "key", "digest", "copies")).alias("pieces"))
    both = docs.select("row", "text").join(lists, F.col("row") == F.col("of")).select("text", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, pieces in zip(batch.column("text").cast(pa.large_binary()), batch.column("pieces")):
                raw, fields = text.as_py(), pieces.values.flatten()
                starts, counts = fields[0].to_pylist(), fields[1].to_pylist()
                cut = [raw[a : a + m + window - 1] for a, m in zip(starts, counts)]
                yield pa.RecordBatch.from_arrays([*fields[2:], pa.array(cut, pa.binary())], ["key", "digest", "copies", "bytes"])

    return both.mapInArrow(trimmed(run), "key long, digest long, copies long, bytes binary")


def _sorted(units: DataFrame, window: int) -> DataFrame:
    """(key, digest, first, last, window, part): the windows first .. last of a piece repeat; or, of a piece that shares its
    key with other units, a distinct window (its SHA-256, ``part`` of the unit) at the places first .. last where it is alone."""
    names = ["key", "digest", "first", "last", "window", "part"]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pieces, key, digest = table.column("bytes").to_pylist(), table.column("key").to_numpy(), table.column("digest").to_numpy()
        copies, dealt, part = table.column("copies").to_numpy(), table.column("dealt").to_numpy(), table.column("part").to_numpy()
        places, piece, group = window_groups(pieces, window)
        first = np.concatenate([[True], group[1:] != group[:-1]])
        dense = np.cumsum(first) - 1
        repeats = (np.bincount(dense, copies[piece]) > 1)[dense] if len(dense) else np.zeros(0, bool)
        begins = np.cumsum([0, *map(len, pieces)])
        flags, owner = np.zeros(begins[-1], bool), np.repeat(np.arange(len(pieces)), np.diff(begins))
        flags[places[repeats]] = True
        a, b = stretches(flags, owner)
        of = owner[a] if len(a) else a
        columns = [key[of], digest[of], a - begins[of], b - begins[of]]
        out = [pa.Table.from_arrays([*map(pa.array, columns), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int64())], names)]
        sent = np.flatnonzero(first & (dealt[piece] > 1)) if len(first) else first
        if len(sent):
            of, at = piece[sent], places[sent] - begins[piece[sent]]
            shas = [hashlib.sha256(pieces[p][x : x + window]).digest() for p, x in zip(of.tolist(), at.tolist())]
            alone = np.where(repeats[sent], -1, at)  # a window that repeats here is known to repeat already
            out.append(pa.Table.from_arrays([pa.array(key[of]), pa.array(digest[of]), pa.array(alone), pa.array(alone), pa.array(shas, pa.binary()), pa.array(part[of])], names))
        return pa.concat_tables(out)

    return units.groupBy("unit").applyInArrow(run, "key long, digest long, first long, last long, window binary, part long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, unit: int = UNIT, longest: int = PIECE) -> DataFrame:
    """(of, spans): for the rows of ``docs`` (row long, text binary; a written table) with repeated windows, the maximal
    stretches [start, end) of covered bytes.  Runs jobs and writes tables when it is called."""
    pieces = materialise(_pieces(docs, window, gram, longest), "pieces")
    twice = pieces.groupBy("key").agg(F.sum("hits").alias("n")).where("n > 1").select(F.expr("key + 0").alias("k"))
    found = materialise(pieces.join(twice, F.col("key") == F.col("k"), "left_semi"), "repeated")
    dropped(pieces)

    # of equal pieces one, with their number; keys with more bytes than a unit are dealt out
    single = materialise(found.groupBy("key", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("row", "start", "windows")).alias("at")), "single")
    size = F.col("at.windows") + F.lit(window - 1)
    total = single.agg(F.sum(size)).first()[0] or 0
    hot = single.groupBy("key").agg(F.sum(size).alias("size")).where(F.col("size") > unit).select(F.expr("key + 0").alias("k"), F.expr(f"(size + {unit - 1}) div {unit}").alias("dealt"))
    cut = _cut(single, docs, window).join(hot, F.col("key") == F.col("k"), "left").withColumn("dealt", F.coalesce("dealt", F.lit(1).cast("long")))
    part = F.when(F.col("dealt") > 1, F.pmod(F.xxhash64("digest"), F.col("dealt"))).otherwise(F.lit(0).cast("long"))
    units = cut.withColumn("part", part).withColumn("unit", F.when(F.col("dealt") > 1, F.xxhash64("key", "part")).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets_for(total, unit)))))
    raw = materialise(_sorted(units.select("unit", "key", "digest", "copies", "bytes", "dealt", "part"), window), "spans")
    dropped(single)

    sent = raw.where("window IS NOT NULL")
    across = sent.groupBy("key", "window").agg(F.count("*").alias("units")).where("units > 1").select(F.expr("key + 0").alias("k"), F.concat("window").alias("w"))
    more = sent.where("first >= 0").join(across, (F.col("key") == F.col("k")) & (F.col("window") == F.col("w")), "left_semi")
    of_piece = raw.where("window IS NULL").unionByName(more).select(F.expr("key + 0").alias("k"), F.col("digest").alias("d"), "first", "last")
    rows = found.join(of_piece, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("d"))).select("row", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + window).alias("end"))
    spans = materialise(rows.groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "merged")
    dropped(found, raw)
    return spans


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans, joined where they overlap or touch."""
    out: list[list[int]] = []
    for x in spans:
        if out and x["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["end"])
        else:
            out.append([x["start"], x["end"]])
    return [(a, b) for a, b in out]


def deduplicate(docs: DataFrame, column: str = "text", window: int = WINDOW, **sizes: int) -> DataFrame:
    """``docs`` with spans (start, end: maximal stretches of bytes of ``column`` that were removed) and kept (the other bytes).

    A byte goes if a ``window``-byte string that covers it starts anywhere else, in the same text or another; matches
    don't cross texts and are judged on the whole input.  Null and empty texts, and texts under a window, keep all they
    have; repeated rows remove each other; an empty table gives no rows; other columns pass through (of those named like
    the new ones, the new ones stay).  Kept bytes may cut a character.  Runs its jobs when it is called.
    """
    docs = docs.drop("spans", "kept")
    row = unused(docs.columns, "row_number")
    whole = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "texts")
    plain = whole.select(F.col(row).alias("row"), F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    spans = repeated_spans(plain, window, **sizes).withColumnRenamed("of", unused([*docs.columns, row], "of")).withColumnRenamed("spans", unused([*docs.columns, row], "spans"))
    of, name = spans.columns
    joined = whole.join(spans, F.col(row) == F.col(of), "left").drop(row, of)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, kept = [], []
            for text, spans in zip(batch.column(column).cast(pa.large_binary()), batch.column(name)):
                raw, cut = text.as_py() or b"", merged(spans.as_py() or [])
                found.append([{"start": a, "end": b} for a, b in cut])
                edges = [0, *(x for span in cut for x in span), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            columns = [x for n, x in zip(batch.schema.names, batch.columns) if n != name]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind), pa.array(kept, pa.binary())], [*(n for n in batch.schema.names if n != name), "spans", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(trimmed(run), f"{fields}, spans array<struct<start:long,end:long>>, kept binary")
