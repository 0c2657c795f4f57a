"""Periodic runs of words, found by heavy/light lag counting.

A run is a maximal stretch of words with smallest period q and at least ``LEAST`` words and ``TURNS`` periods.  Such a
stretch has max(LEAST - q, q) matches in a row at lag q (word i equals word i + q), so only lags with that many matches
in the whole text need an island scan.  The matches of all lags are counted at once:

* frequent words by autocorrelation: the power spectra of their 0/1 indicators are summed, and one inverse FFT gives
  the counts of all lags (whole numbers of at most n, so rounding is exact);
* rare words by the differences of their pairs of places.

Lags ascend.  A run of period p has L - q matches at each multiple q of p below its length L; they are taken off the
counts, so a text of one repeated word costs one scan and not n / 2.  Where a run of period q >= ``GRID`` is looked
for, every (q / GRID)-th place is tried first: it holds GRID matches in a row there.

A text is one row and is worked on by itself: O(n sqrt(n log n)) operations and a few arrays of n words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.runtime import trimmed

#: Words and periods that a run has at least.
LEAST, TURNS = 12, 2
#: Places of a long period that are tried before its lag is scanned.
GRID = 16
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """How many places i have ids[i] == ids[i + q], for q = 0 .. most (0 for lag 0); ids are 0 .. k - 1."""
    n, out = len(ids), np.zeros(most + 1, np.int64)
    if n < 2 or most < 1:
        return out
    size = 1 << (2 * n - 1).bit_length()
    counts = np.bincount(ids)
    heavy = counts > np.sqrt(size * np.log2(size) / 2)
    if heavy.any():
        power = np.zeros(size // 2 + 1)
        for word in np.flatnonzero(heavy):
            spectrum = np.fft.rfft(ids == word, size)
            power += spectrum.real**2 + spectrum.imag**2
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
        out[0] = 0
    light = np.flatnonzero(~heavy[ids])
    order = light[np.argsort(ids[light], kind="stable")]
    words, at = ids[order], np.arange(len(order))
    for step in range(1, len(order)):  # the step-th later place of the same word; words with fewer places drop out
        at = at[: np.searchsorted(at, len(order) - step)]
        at = at[words[at] == words[at + step]]
        if not len(at):
            break
        lags = order[at + step] - order[at]
        near = lags <= most
        out += np.bincount(lags[near], minlength=most + 1)
        at = at[near]  # later places are farther still
    return out


def islands(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of True with ``least`` members or more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    return starts[lengths >= least], lengths[lengths >= least]


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(ids)
    most = n // TURNS
    if n < LEAST or most < 1:
        return []
    counts = lag_counts(ids, most)
    lags = np.arange(most + 1)
    need = np.maximum(LEAST - lags, (TURNS - 1) * lags)
    found: dict[tuple[int, int], int] = {}
    q = 0
    while len(ahead := np.flatnonzero(counts[q + 1 :] >= need[q + 1 :])[:1]):
        q += 1 + int(ahead[0])
        least = int(need[q])
        if (step := q // GRID) > 1 and not len(islands(ids[: n - q : step] == ids[q::step], least // step)[0]):
            continue
        for start, length in zip(*islands(ids[: n - q] == ids[q:], least)):
            span = (int(start), int(length) + q)
            if span not in found:
                found[span] = q
                multiples = np.arange(2 * q, min(span[1], most + 1), q)
                counts[multiples] -= span[1] - multiples
    return sorted((start, length, period) for (start, length), period in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def find(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; by start, then period) and collapsed (the words outside
    repetitions, joined by one space) of the whole text of ``column``.

    Words are what lies between ASCII white space.  Null and empty texts have no word, no run and an empty collapsed
    text; repeated rows are worked on each; an empty table gives no rows; other columns pass through (of those that are
    named like the new ones, the new ones stay).
    """
    schema = docs.drop("n_words", "runs", "collapsed")
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, texts = [], [], []
            for value in batch.column(column).cast(pa.large_binary()):
                words = np.array((value.as_py() or b"").split() + [None], object)[:-1]  # the None keeps numpy from reading bytes as numbers
                runs = find_runs(pd.factorize(words)[0]) if len(words) >= LEAST else []
                sizes.append(len(words))
                found.append([dict(zip(("start", "length", "period"), x)) for x in runs])
                texts.append(b" ".join(words[kept_words(len(words), runs)] if runs else words))
            added = [pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "n_words", "runs", "collapsed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    out = schema.mapInArrow(trimmed(run), f"{fields}, {SCHEMA.replace('collapsed string', 'collapsed binary')}")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with periods planted: h = crc32 of the decimal doc_id, g = floor(h / 10); where h % 10 = 0, word i >= a of the
    text becomes word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).  Texts without doc_id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = docs.withColumn("_h", h).withColumn("_g", F.expr("_h div 10"))
    chosen = (F.col("_h") % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    cut = cut.withColumn("_w", words).withColumn("_n", F.size("_w").cast("long"))
    cut = cut.withColumn("_a", F.when(F.col("_n") > 0, F.expr("_g % _n"))).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    made = F.expr("array_join(transform(sequence(0L, _n - 1), i -> element_at(_w, int(1 + if(i < _a, i, _a + (i - _a) % _p)))), ' ')")
    return cut.withColumn("text", F.when(chosen, made).otherwise(F.col("text"))).drop("_h", "_g", "_w", "_n", "_a", "_p")


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, the greatest run's start, length, period and exponent_milli, digests of the runs and of the collapsed text)."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"), F.expr("1000 * b.length div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
