"""Language ID by language-bitmask n-gram filters.

A bit-sliced Bloom filter is one table of bit masks, one bit per language and as many 64-bit words a slot as the
languages need.  An n-gram's ``HASHES`` slots are and-ed, which gives all languages that contain it at once.  Per
language the masks' bits are counted over a text's n-grams and corrected for the false positives that the filter's fill
lets through; the highest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.runtime import Texts, trimmed

#: Documents of each language that the filters learn from, at most (about; chosen by a hash of doc_id).
SAMPLE_DOCS = 400
#: Bytes of a text to learn from, at most; a language whose texts are all longer is learned from LONG_DOCS of them (about).
SAMPLE_BYTES, LONG_DOCS = 1 << 18, 4
#: Bytes of all texts to learn from, at most (about), however many languages there are: each gets its part of them.
TOTAL_BYTES = 256 << 20
#: N-gram sizes in bytes; slots of the table; hashes; share of a language's documents that an n-gram of it is in.
SIZES, SLOT_BITS, HASHES, LEAST_SHARE = (3, 5), 20, 2, 0.02
#: A document is rejected by the filter ``accepted`` where fewer of its n-grams belong to the language.
LEAST_COVER = 0.2
UNKNOWN = "und"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: ASCII letters lower-cased, bytes of longer code points kept, all else a space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def held_out(modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder


def ngrams(folded: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The value of the n-gram at each byte, and whether it has at most one space."""
    m = max(0, len(folded) - n + 1)
    value, spaces = np.zeros(m, np.uint64), np.zeros(m, np.uint8)
    for j in range(n):
        part = folded[j : j + m]
        value = (value << np.uint64(8)) | part
        spaces += part == 32
    return value | np.uint64(n << 56), spaces <= 1


def slots(value: np.ndarray, k: int) -> np.ndarray:
    x = (value ^ (value >> np.uint64(23))) * _MULTIPLIERS[k]
    return ((x ^ (x >> np.uint64(31))) * _MULTIPLIERS[k] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Filters:
    """languages in code point order; ``table`` of masks, one array of slots for every 64 languages; ``false``: share of
    foreign n-grams that each filter lets through."""

    def __init__(self, languages: list[str], table: list[np.ndarray]):
        self.languages, self.table = languages, table
        self.false = np.array([float((table[i >> 6] >> np.uint64(i & 63) & np.uint64(1)).mean()) ** HASHES for i in range(len(languages))])

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text of the flat buffer: n-grams per language after correction (texts x languages), all n-grams."""
        n_texts, start = len(offsets) - 1, int(offsets[0])
        folded = _FOLD[data[start : int(offsets[-1])]]
        bounds = offsets - start
        hits, total = np.zeros((n_texts, len(self.languages))), np.zeros(n_texts)
        for n in SIZES:
            value, valid = ngrams(folded, n)
            if not len(value):
                continue
            for end in bounds[1:-1]:  # n-grams that run into the next text
                valid[max(0, end - n + 1) : end] = False
            at = np.flatnonzero(valid)
            places = [slots(value[at], k) for k in range(HASHES)]
            edges = np.searchsorted(at, bounds)
            for first, words in enumerate(self.table):
                masks = words[places[0]]
                for place in places[1:]:
                    masks &= words[place]
                for i in range(64 * first, min(64 * first + 64, len(self.languages))):
                    up = np.concatenate([[0], np.cumsum(masks >> np.uint64(i & 63) & np.uint64(1), dtype=np.int64)])
                    hits[:, i] += np.diff(up[edges])
            total += np.diff(edges)
        corrected = (hits - total[:, None] * self.false) / np.maximum(1e-9, 1 - self.false)
        return np.clip(corrected, 0, None), total

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language (ties: first), score (its share of all languages' counts), share of n-grams it has."""
        counts, total = self.counts(data, offsets)
        if not len(self.languages):
            return np.full(len(total), -1), np.zeros(len(total)), np.zeros(len(total))
        best = counts.argmax(axis=1)
        top = counts[np.arange(len(best)), best]
        return best, np.divide(top, counts.sum(axis=1), out=np.zeros(len(top)), where=top > 0), np.divide(top, total, out=np.zeros(len(top)), where=total > 0).clip(0, 1)


def build(texts: list[tuple[str, bytes]]) -> Filters:
    """Filters from (language, text): the n-grams of at least ``LEAST_SHARE`` of a language's texts, and of two if it has two."""
    by: dict[str, list[bytes]] = {}
    for lang, text in texts:
        by.setdefault(lang, []).append(text)
    table = [np.zeros(1 << SLOT_BITS, np.uint64) for _ in range(-(-len(by) // 64))]
    for i, lang in enumerate(sorted(by)):
        for n in SIZES:
            seen = []
            for text in by[lang]:
                value, valid = ngrams(_FOLD[np.frombuffer(text, np.uint8)], n)
                seen.append(np.unique(value[valid]))
            value, found = np.unique(np.concatenate(seen), return_counts=True)
            value = value[found >= max(min(2, len(by[lang])), LEAST_SHARE * len(by[lang]))]
            for k in range(HASHES):
                table[i >> 6][slots(value, k)] |= np.uint64(1 << (i & 63))
    return Filters(sorted(by), table)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Filters:
    """From text and lang of the rows of ``docs`` that have both; about ``sample_docs`` of each language, of texts of up to
    ``sample_bytes``, and fewer where all languages' would pass TOTAL_BYTES.  Rows are chosen by a hash of doc_id and length, so
    repeated rows are chosen together, and rows without a doc_id by their length.  Runs its jobs when it is called."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", (F.octet_length("text") <= sample_bytes).alias("short"))
    counts = known.groupBy("lang").agg(F.count_if("short").alias("short"), F.count("*").alias("n"), F.avg(F.when(F.col("short"), F.octet_length("text"))).alias("bytes")).collect()
    if not counts:
        return build([])
    expected = sum(min(sample_docs, r.short) * r.bytes for r in counts if r.short)
    fewer = min(1.0, TOTAL_BYTES / max(1, expected))
    limit = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(1.0, (sample_docs * fewer / r.short) if r.short else LONG_DOCS / r.n))))
    only_long = [r.lang for r in counts if not r.short]
    chosen = known.where((F.col("short") | F.col("lang").isin(*only_long)) & (F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < F.element_at(limit, F.col("lang")) * (1 << 30)))
    rows = chosen.select("lang", "text").toArrow()
    return build([(lang, text.encode()) for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist())])


def _judged(batch: pa.RecordBatch, filters: Filters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: language (index), whether it has one, score, cover."""
    texts = Texts(batch.column("text"))
    lettered = pa.compute.match_substring_regex(batch.column("text").cast(pa.large_string()), r"\pL").fill_null(False).to_numpy(zero_copy_only=False)
    best, score, cover = (np.concatenate(x) for x in zip(*(filters.decide(texts.data, texts.offsets[a : b + 1]) for a, b in texts.blocks()))) if len(texts) else (np.zeros(0, int), np.zeros(0), np.zeros(0))
    known = lettered & (best >= 0)
    return best, known, np.where(known, score, 0.0), np.where(known, cover, 0.0)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with lang_pred, lang_score, lang_cover added.

    ``und`` with score 0 where the text is null or has no letter (or nothing was learned); texts of letters that no
    filter knows get the first language with score 0; ties go to the first language in code point order.  Rows are
    judged each for itself, repeated ones too, whatever other columns they have; columns of these three names are
    replaced; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.table))
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_cover")]
    rows = docs.select(*(f"`{c}`" for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(*sent.value)
        for batch in batches:
            best, known, score, cover = _judged(batch, filters)
            pred = [filters.languages[i] if k else UNKNOWN for i, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(cover)], [*names, "lang_pred", "lang_score", "lang_cover"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, lang_score double, lang_cover double"
    return rows.mapInArrow(trimmed(run), schema)


def accept(docs: DataFrame, filters: Filters, least_cover: float = LEAST_COVER) -> DataFrame:
    """The rows of ``docs`` that have a language, of which at least ``least_cover`` of their n-grams are.

    Null texts and texts without letters go; repeated rows are judged each for itself; columns stay as they are,
    whatever their names; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.table))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(*sent.value)
        for batch in batches:
            _, known, _, cover = _judged(pa.RecordBatch.from_arrays([batch.column(at)], ["text"]), filters)
            yield batch.filter(pa.array(known & (cover >= least_cover)))

    return docs.mapInArrow(trimmed(run), docs.schema)
