"""Source divergence audit: how a source's words differ from those of its language's other sources.

Each group (lang, source) gives every kept term the rate p = 1 + floor(SCALE (count + 2) / (N + 2 V)); two rates differ by
f(p, q) = floor((p - q)^2 / (p + q)).  A pair of groups is worth the sum of f over all V kept terms, most of which occur
in neither.  So each pair starts at its baseline, V times f of the rates of count zero (p0), and the inverted index only
emits what differs from it.  With Z = f(p0_a, p0_b), the correction of a term is

* f(p_a, p0_b) - Z for each of its postings a against every other group b.  This depends on the posting's count alone,
  so postings are summed to (group, count, terms) first, and it is those that meet the other groups;
* f(p_a, p_b) - f(p_a, p0_b) - f(p0_a, p_b) + Z more where a and b both have the term, nonzero only.

Terms are counted in the tasks that read the texts; rows (lang, source, term) are what is shuffled, once, by language and
term: a hot source or word is a row a task.  A term's sources are then one list, no longer than its language's sources.
The pairs of a language are the result itself (every rank is asked for), and no other table is larger than they or the
postings are.  Everything is integer arithmetic: decimals where counts meet SCALE, longs after.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.runtime import dropped, materialise, trimmed

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 10, 10
#: Bytes that make up terms: ASCII letters, lower-cased, and whatever isn't ASCII; all others part them.
TERM_BYTES = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() and b < 128 else 32 for b in range(256))
#: Distinct (lang, source, term) that a task holds before it sends their counts, and bytes of terms.
HELD, HELD_BYTES = 400_000, 32 << 20


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): partial sums, a row a task for each term, or more where it has many terms.

    Null text, lang and source count as ''.
    """
    names = ["lang", "source", "term", "count", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        terms = size = 0

        def sent() -> pa.RecordBatch:
            rows = [(*group, t, n, docs[t]) for group, (counts, docs) in held.items() for t, n in counts.items()]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), [pa.binary()] * 3 + [pa.int64()] * 2)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            columns = [batch.column(x).cast(pa.large_binary()) for x in ("lang", "source", "text")]
            for lang, source, text in zip(*columns):
                words = (text.as_py() or b"").translate(TERM_BYTES).split()
                if not words:
                    continue
                counts, docs = held.setdefault((lang.as_py() or b"", source.as_py() or b""), (Counter(), Counter()))
                had, distinct = len(counts), set(words)
                counts.update(words)
                docs.update(distinct)
                if len(counts) > had:
                    terms += len(counts) - had
                    size += sum(map(len, distinct))
                if terms >= HELD or size >= HELD_BYTES:
                    yield sent()
                    held, terms, size = {}, 0, 0
        if held:
            yield sent()

    plain = docs.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    out = plain.mapInArrow(trimmed(run), "lang binary, source binary, term binary, count long, docs long")
    return out.withColumns({x: F.col(x).cast("string") for x in ("lang", "source", "term")})


def rate(count: str | int, total: str = "n", kept: str = "v") -> Column:
    """p of a count; a decimal, so that a count of any size is exact, then a long (at most SCALE + 1)."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0))) div CAST({total} + 2 * {kept} AS DECIMAL(21,0))")


def differ(p: str, q: str) -> str:
    """f as SQL: p and q are at most SCALE + 1, so the square is a long."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language, ranked by the divergence
    of the whole vocabulary; part `term` the ``top`` terms that a source uses more than its language does.

    A language keeps the terms that ``least_docs`` of its rows hold (a repeated row counts each time).  Null lang, source
    and text are ''; a group without kept terms, or a language without any, has its pairs (of value 0 where V = 0) and no
    terms; ties go by the item's bytes; an empty table gives no rows; other columns take no part.  Writes the postings
    when it is called, and deletes the tables it no longer needs.
    """
    # dealt out by (lang, term), which serves both sums: by source, and over all sources of a term
    counted = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all"), F.collect_list(F.struct("source", "count")).alias("sources")).where(F.col("docs") >= least_docs)
    postings = kept.select("lang", "term", "all", F.posexplode("sources").alias("no", "s"))
    postings = materialise(postings.select("lang", "s.source", "term", "s.count", "all", "no"), "postings")

    names = docs.select(*(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source"))).distinct()
    sums = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = postings.where("no = 0").groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
    groups = names.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    groups = materialise(groups.withColumn("p0", F.when(F.col("v") > 0, rate(0)).otherwise(F.lit(1).cast("long"))), "groups")

    about = groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), "n", "v", "lang_n", "p0")
    rated = postings.join(about, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s"))).withColumn("p", rate("count"))
    rated = materialise(rated.select("lang", "source", "term", "count", "p", "p0", rate("all", "lang_n").alias("q")), "rated")
    dropped(postings)

    # a list of co-occurring sources meets itself term by term; sums are taken before they are shuffled
    x, y = rated.select("lang", "term", "source", "p", "p0").alias("x"), rated.select(F.concat("lang").alias("lang"), F.concat("term").alias("term"), "source", "p", "p0").alias("y")
    shared = x.join(y, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.term") == F.col("y.term")) & (F.col("x.source") < F.col("y.source")))
    both = f"{differ('x.p', 'y.p')} - {differ('x.p', 'y.p0')} - {differ('x.p0', 'y.p')} + {differ('x.p0', 'y.p0')}"
    shared = shared.select(F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.expr(both).alias("value")).where("value <> 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    others = groups.select(F.concat("lang").alias("l"), F.col("source").alias("b"), F.col("p0").alias("b0"))
    alone = rated.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    alone = alone.join(others, (F.col("lang") == F.col("l")) & (F.col("source") != F.col("b"))).select("lang", F.col("source").alias("a"), "b", F.expr(f"terms * ({differ('p', 'b0')} - {differ('p0', 'b0')})").alias("value")).where("value <> 0")

    base = groups.join(others, (F.col("lang") == F.col("l")) & (F.col("source") < F.col("b"))).select("lang", F.col("source").alias("a"), "b", F.expr(f"v * {differ('p0', 'b0')}").alias("value"))
    ordered = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    pairs = base.unionByName(ordered).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", sides.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    terms = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(differ("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
