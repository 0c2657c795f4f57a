"""Document fingerprints: SpotSigs.

A spot is the beginning of a text, each place after an anchor (a common word of several languages), and each place that
``GAP`` words without an anchor follow, so that a passage without anchors has spots of its own, whatever stands beside
it.  At every spot the chains of the next 1 and the next ``CHAIN`` content words are signatures, anchors in between being
skipped (at a text's end a chain may be shorter).  A text's fingerprint is the set of its signatures, by one rule for
texts of every length, and is printed whole.

Sets are partitioned by length: partition p holds the lengths of which the logarithm to base 1/threshold lies between p
and p + 1.  Sets of partitions further apart than one can't reach the threshold, and within them the lengths decide
again before any intersection is made.  Only DataFrame functions on every path.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.linking import cap, settle
from siftline.llm.runtime import dropped, materialise, text_or_empty

#: Common words of English, French, German and Spanish.
ANCHORS = ("the", "a", "an", "and", "of", "in", "to", "is", "that", "this", "with", "for", "was", "by", "on", "le", "la", "les", "des", "du", "un", "une", "et", "en", "de", "que", "der", "die", "das", "und", "ein", "eine", "ist", "mit", "el", "los", "las", "del", "y", "por", "es")
CHAIN = 2
#: Words without an anchor that make a place a spot; bits of a signature.
GAP, BITS = 8, 40
#: Likeness of near documents.
NEAR = 0.8
#: Documents to a block of neighbours in doc_id order.
BLOCK = 2048
#: Quantile ranges of doc_id; each holds blocks by the length of its texts.
RANGES = 64


def _either(words: tuple[str, ...]) -> str:
    """A pattern of the words that shares their common beginnings."""
    rest: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        if word:
            rest.setdefault(word[0], []).append(word[1:])
    found = "|".join(first + _either(tuple(more)) for first, more in rest.items())
    return f"(?:{found})" + "?" * ("" in words) if found else ""


_ANY = _either(ANCHORS)
#: Stands before a content word that begins the text or follows anchors, which it replaces; no word has it.
_MARK = "|"
_ANCHORED = rf"[ {_MARK}](?:{_ANY} )++"
#: In a marked text: the chain at a mark (it may go on behind the next one), and a run of words that has spots without one.
_FIRST = rf"(?=(\{_MARK}[^ {_MARK}]++(?:[ {_MARK}][^ {_MARK}]++){{0,{CHAIN - 1}}}))\{_MARK}"
_RUN = rf"\{_MARK}([^ {_MARK}]++(?: [^ {_MARK}]++){{{GAP},}}+)"


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _chains(marked: Column) -> Column:
    """The chains of CHAIN content words at a marked text's spots.

    A run of content words has one spot at its mark, and one at each later word that GAP - 1 words of the run follow: so
    runs are cut into words once, and no place looks at the words after it.
    """
    first = F.transform(F.regexp_extract_all(marked, F.lit(_FIRST), F.lit(1)), lambda s: F.translate(s, _MARK, " "))

    def later(words: Column) -> Column:
        n = F.size(words) - GAP
        out = F.slice(words, 2, n)
        for k in range(1, CHAIN):
            out = F.zip_with(out, F.slice(words, 2 + k, n), lambda a, b: F.concat_ws(" ", a, b))
        return F.transform(out, lambda s: F.concat(F.lit(" "), s))

    runs = F.transform(F.regexp_extract_all(marked, F.lit(_RUN), F.lit(1)), lambda run: _once(F.split(run, " "), later))
    return F.concat(first, F.flatten(runs))


def signatures(text: Column) -> Column:
    """Sorted distinct signatures (hashes of BITS bits) of a text; null counts as empty, which has none."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    marked = F.regexp_replace(F.concat(F.lit(_MARK), words, F.lit(" ")), _ANCHORED, _MARK)
    short = lambda s: F.substring_index(s, " ", 2)
    chains = _once(_once(marked, _chains), lambda found: F.concat(found, F.transform(found, short)))
    return F.sort_array(F.array_distinct(F.transform(chains, lambda s: F.shiftrightunsigned(F.xxhash64(s), 64 - BITS))))


def printed(sigs: Column) -> Column:
    """The fingerprint as text: set length and every signature; equal sets, and so equal texts, have equal ones."""
    digits = BITS // 4
    return F.concat_ws("-", F.size(sigs).cast("string"), F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h)), digits, "0")), ""))


def partition(length: Column, threshold: float) -> Column:
    """The length partition of a set: 0 for empty ones, which lie apart from all others."""
    return F.when(length > 0, F.floor(F.log(length.cast("double")) / -math.log(threshold)).cast("int") + 2).otherwise(0)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def near(a: Column, b: Column, threshold: float) -> Column:
    """Whether the likeness is ``threshold`` or more; not looked at where partitions or lengths rule that out."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    apart = (F.abs(partition(F.size(a), threshold) - partition(F.size(b), threshold)) > 1) | (small < F.lit(threshold) * large)
    return F.when(apart, False).otherwise(likeness(a, b) >= threshold)


def with_next(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): the next text by ascending doc_id, after the last one the first.

    Null texts count as empty.  Rows without a doc_id come first; rows of equal doc_id follow each other by a hash of
    the text, so that a frequent doc_id is dealt out as well.  Documents are dealt out in blocks of neighbours, about
    ``block`` of middling length each, so no window sees all rows; the blocks' first rows close the gaps.  A text's
    signatures are computed once, where its block is, and the row before it takes them over.  The blocks' bounds are
    found when this is called.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("block", _block_of(rows, block))
    by = [F.asc_nulls_first("doc_id"), F.col("tie"), F.col("text")]
    order = Window.partitionBy("block").orderBy(*by)
    inside = rows.repartition("block").withColumn("sigs", signatures(F.col("text")))
    inside = inside.withColumns({"following": F.lead("text").over(order), "following_sigs": F.lead("sigs").over(order), "last": F.lead(F.lit(1)).over(order).isNull()})
    firsts = rows.groupBy("block").agg(F.min_by("text", F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie", "text")).alias("first_text"))
    ring = Window.partitionBy(F.lit(0)).orderBy("block")  # over block numbers alone, one to every ``block`` documents
    follows = firsts.select("block").withColumn("next_block", F.coalesce(F.lead("block").over(ring), F.first("block").over(ring)))
    seam = follows.join(firsts.select(F.col("block").alias("next_block"), F.col("first_text").alias("seam")), "next_block").select("block", "seam")
    x = inside.join(seam.withColumn("last", F.lit(True)), ["block", "last"], "left")
    return x.select("doc_id", "text", "sigs", F.coalesce("following", "seam").alias("next_text"), F.coalesce("following_sigs", signatures(F.col("seam"))).alias("next_sigs"))


def _block_of(rows: DataFrame, block: int) -> Column:
    """Rising block number: quantile ranges of the ids, an id that fills a whole one and the missing ids being ranges of
    their own; each is cut evenly, by id or (a single id) by ``tie``, into blocks in proportion to its texts' length."""
    found = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.percentile_approx("doc_id", [k / RANGES for k in range(1, RANGES)], 20000).alias("cuts")).first()
    cuts = sorted(found.cuts or ())
    heavy = {a for a, b in zip(cuts, cuts[1:]) if a == b}
    edges = sorted({found.lo, found.hi + 1, *cuts, *(x + 1 for x in heavy)} - {None}) if found.lo is not None else []
    span = _tree(edges, lambda k: f"{k + 1}L")
    stats = rows.groupBy(F.coalesce(F.expr(span), F.lit(0)).alias("span")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    count, chars = sum(r.n for r in stats), sum(r.chars for r in stats)
    cut = {r.span: max(1, math.ceil((r.n / count + r.chars / max(1, chars)) / 2 * count / block)) for r in stats}
    first, at = {}, 0
    for k in range(len(edges) + 1):
        first[k], at = at, at + cut.get(k, 1)
    by_tie = lambda k: f"{first[k]}L + CAST(floor((tie / 18446744073709551616D + 0.5D) * {cut.get(k, 1)}D * 0.999999D) AS BIGINT)"

    def of(k: int) -> str:
        lo, width = edges[k], edges[k + 1] - edges[k]
        return by_tie(k + 1) if width == 1 else f"{first[k + 1]}L + CAST(floor((doc_id - {lo}L) * {cut.get(k + 1, 1)}D / {width}D * 0.999999D) AS BIGINT)"

    return F.coalesce(F.expr(_tree(edges, of)), F.expr(by_tie(0)))


def _tree(edges: list[int], leaf: Callable[[int], str]) -> str:
    """SQL of ``leaf(k)`` for the ids from edges[k] to edges[k + 1]: log2(ranges) comparisons a row; null without an id."""

    def at(lo: int, hi: int) -> str:
        if lo >= hi:
            return leaf(lo)
        mid = (lo + hi + 1) // 2
        return f"IF(doc_id < {edges[mid]}L, {at(lo, mid - 1)}, {at(mid, hi)})"

    return f"CASE WHEN doc_id IS NOT NULL THEN {at(0, len(edges) - 2)} END" if len(edges) > 1 else "CAST(NULL AS BIGINT)"


def edited(text: Column, other: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures.

    Null texts count as empty (fingerprint of 0 signatures); repeated rows and ties are kept, each row once; an empty
    table gives no rows; other columns are ignored.  Both likenesses are the exact Jaccard of the printed sets.
    """
    x = with_next(docs, block).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    x = x.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("sigs").alias("own"), signatures(F.col("edited")).alias("other"), F.col("next_sigs").alias("next"))
    return x.select("doc_id", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"), F.size("own").alias("n_signatures"))


def _may_be_near(rows: DataFrame, threshold: float) -> DataFrame:
    """(class, sigs) of the rows (class, n, sigs) whose class has enough signatures that other classes have as well.

    A set that is near to another shares at least ``threshold`` of its own signatures.  A signature of one class alone
    names its class, so those are counted without bringing the sets of a signature together: frequent ones are
    aggregated where they are read, and only sets that remain are joined by signature.
    """
    tokens = rows.select("class", F.explode("sigs").alias("token")).groupBy("token").agg(F.min("class").alias("own"), F.max("class").alias("other"))
    alone = tokens.where("own = other").groupBy(F.expr("own + 0").alias("of")).agg(F.count("*").alias("alone"))
    x = rows.where("n > 0").select("class", "n", "sigs").join(alone, F.col("class") == F.col("of"), "left")
    return x.where(F.col("n") - F.coalesce("alone", F.lit(0)) >= F.ceil(F.lit(threshold) * F.col("n") - 1e-9)).select("class", "sigs")


def near_documents(docs: DataFrame, threshold: float = NEAR) -> DataFrame:
    """(doc_id, n_signatures, component_id): documents of fingerprints with a likeness of ``threshold`` or more, and their closure.

    component_id is the least doc_id of the component, null only where none of it has a doc_id.  Documents without
    signatures (null texts among them) are near to nothing; equal fingerprints are one class, and so repeated rows are; a
    class is named by 64 bits of a 128-bit hash, or by the other 64 where two classes share the first; other columns take
    no part; an empty table gives no rows.  Sets with too few signatures that any other has are left out first; candidates share one of the
    signatures that the threshold forces them to (the rarest ones of each set) and lie in the same or neighbouring
    length partitions; pivots keep a list of many sets from meeting itself whole.  Runs jobs when it is called.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text")).alias("sigs"))
    rows = materialise(rows.select("doc_id", F.xxhash64("sigs").alias("class"), F.xxhash64(F.lit(1), "sigs").alias("check"), F.size("sigs").alias("n"), "sigs"), "spots")
    twins = rows.groupBy("class").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").select(F.expr("class + 0").alias("twin"))
    if not twins.isEmpty():
        renamed = rows.join(twins, F.col("class") == F.col("twin"), "left").withColumn("class", F.when(F.col("twin").isNull(), F.col("class")).otherwise(F.col("check"))).drop("twin")
        first, rows = rows, materialise(renamed, "spots")
        dropped(first)
    sets = materialise(_may_be_near(rows, threshold).groupBy("class").agg(F.first("sigs").alias("sigs")), "sets")
    each = sets.select("class", F.size("sigs").alias("n"), F.explode("sigs").alias("token"))
    df = each.groupBy(F.expr("token + 0").alias("of")).agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(df, F.col("token") == F.col("of")).groupBy("class").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    # signatures in one set only never match: they take the first places, so only their number matters
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("shared"))
    heads = shared.where(keep > 0).select("class", "n", cap(F.col("n"), F.size("shared"), threshold).alias("cap"), partition(F.col("n"), threshold).alias("step"), (F.size("shared") / F.col("n")).cast("float").alias("weight"), F.explode(F.slice("shared", F.lit(1), F.greatest(keep, F.lit(1)).cast("int"))).alias("head"))
    postings = materialise(heads.select(F.col("head.token").alias("token"), "class", F.col("n").cast("long").alias("n"), "cap", "step", "weight", F.lit(255).cast("short").alias("reach")), "heads")

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.expr("class + 0").alias(f"of_{x}"), F.col("sigs").alias(f"sigs_{x}")) for x in "ab")
        x = pairs.join(a, F.col("a") == F.col("of_a")).join(b, F.col("b") == F.col("of_b"))
        return materialise(x.where(near(F.col("sigs_a"), F.col("sigs_b"), threshold)).select("a", "b"), "links")

    _, root = settle(postings, linked, threshold, 1)
    dropped(sets)
    x = rows.select("doc_id", "class", "n").join(root.select(F.expr("class + 0").alias("of"), "root"), F.col("class") == F.col("of"), "left").withColumn("root", F.coalesce("root", "class"))
    least = x.groupBy(F.expr("root + 0").alias("of_root")).agg(F.min("doc_id").alias("least"))
    out = x.join(least, F.col("root") == F.col("of_root"))
    return out.select("doc_id", F.col("n").alias("n_signatures"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
