"""Links between sets that share postings, and their components, without all pairs of a list.  Only DataFrame functions.

Postings are rows (token, class, n, cap, step, weight, reach): a set of ``n`` parts, the largest size that a set linked
with it may have, its size step, the share of its lists that others share, and a bound of the share of the set that
follows the token in the common order (255 for all).

``cap`` goes by the parts that no other set has, which can't be in common.  A set is stuck if its cap is below its own
size: it only links with smaller ones.  Two stuck sets never link, as each would have to be smaller than the other.  So a
list of sets that share some parts but each have enough of their own, as short texts from one template do, is not
looked at, and stuck sets meet only those that aren't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.runtime import dropped, materialise

#: Longs of the parity bitmap.
BITMAP = 8
#: Sets from which a list is long: its pairs are bounded by bitmaps inside the join, those of shorter ones after it.
LONG_LIST = 32
#: Pairs for each posting that are joined without a further round of pivots; share of the pairs that a round must save.
PAIRS_PER_POSTING, SAVED = 64, 0.5


def _kept(view: DataFrame, table: DataFrame) -> DataFrame:
    """``view`` of a written table, which goes with it."""
    view._written_to = getattr(table, "_written_to", None)
    return view


def _links(m: Column, n: Column, both: Column, threshold: float) -> Column:
    return F.lit(100) * both >= F.lit(round(threshold * 100)) * (m + n - both)


def _sizes_fit(m: Column, n: Column, threshold: float) -> Column:
    return F.least(m, n) * 100 >= F.greatest(m, n) * round(threshold * 100)


def may_link(a: str, b: str, threshold: float) -> Column:
    """Bounds by size and bitmap: the overlap can't be above (m + n - Hamming distance) / 2."""
    m, n = F.col(f"{a}.n"), F.col(f"{b}.n")
    distance = sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(BITMAP)), F.lit(0))
    return _sizes_fit(m, n, threshold) & _links(m, n, F.least(F.floor((m + n - distance) / 2), m, n), threshold)


def cap(n: Column, shared: Column, threshold: float) -> Column:
    """The largest size of a set that may link with one of ``n`` parts, of which at most ``shared`` are in other sets."""
    share = round(threshold * 100)
    return F.floor((shared * (100 + share) - n * share) / share).cast("long")


def _meet(m: Column, n: Column, x: Column, y: Column, threshold: float, count: int) -> Column:
    """Whether sets of sizes m and n may still reach T from places with the reaches x and y, the ``count``-th in common at most."""
    rest = F.least(F.floor(m * x / 255), F.floor(n * y / 255))
    return _sizes_fit(m, n, threshold) & _links(m, n, rest + count, threshold)


def _pairs(met: DataFrame, count: int) -> DataFrame:
    """(a, b, query) of the pairs (class, other, of query) that met in ``count`` lists or more."""
    return met.groupBy(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).agg(F.count("*").alias("met"), F.min("asks").alias("query")).where(F.col("met") >= count).drop("met")


def _by_pivots(posted: DataFrame, threshold: float, count: int) -> DataFrame:
    """Every set against the pivots of its lists: for each size step the set that shares most of its lists, as an original does."""
    steps = posted.where("root <> largest").groupBy("token", "step").agg(F.max(F.struct("weight", "class", "n", "cap", "reach", "root")).alias("p"))
    near = steps.select(F.expr("token + 0").alias("of"), F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("at"), F.col("p.class").alias("other"), F.col("p.n").alias("o_n"), F.col("p.cap").alias("o_cap"), F.col("p.reach").alias("o_reach"), F.col("p.root").alias("o_root"))
    on = (F.col("token") == F.col("of")) & (F.col("step") == F.col("at")) & (F.col("root") != F.col("o_root")) & (F.col("n") <= F.col("o_cap")) & (F.col("o_n") <= F.col("cap")) & _meet(F.col("n"), F.col("o_n"), F.col("reach"), F.col("o_reach"), threshold, count)
    return _pairs(posted.join(near, on).select("class", "other", F.col("other").alias("asks")), count)


def _by_lists(posted: DataFrame, bitmaps: DataFrame | None, threshold: float, count: int) -> DataFrame:
    """The sets outside a list's largest component against all of its other components; of stuck ones only against others."""
    y_columns = ["class", "n", "cap", "reach", "root"]
    same = (F.col("x.token") == F.col("y.of")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.n") <= F.col("y.cap")) & (F.col("y.n") <= F.col("x.cap")) & _meet(F.col("x.n"), F.col("y.n"), F.col("x.reach"), F.col("y.reach"), threshold, count)
    once = (F.col("y.root") == F.col("x.largest")) | (F.col("x.class") < F.col("y.class"))
    both = [F.col("x.class").alias("class"), F.col("y.class").alias("other"), F.least("x.class", "y.class").alias("asks")]

    def met(rows: DataFrame, more: list[str], may: Column) -> DataFrame:
        free, stuck = rows.where("cap >= n"), rows.where("cap < n")
        against = lambda df: df.select(F.expr("token + 0").alias("of"), *y_columns, *more).alias("y")
        first = free.where("root <> largest").alias("x").join(against(free), same & once & may).select(*both)
        return first.unionByName(free.alias("x").join(against(stuck), same & may).select(*both))

    if bitmaps is None:
        return _pairs(met(posted, [], F.lit(True)), count)
    # long lists carry the bitmaps, so that the join itself drops what can't link
    bits = [f"b{i}" for i in range(BITMAP)]
    rows = posted.where("long").join(bitmaps.select(F.expr("class + 0").alias("named"), *bits), F.col("class") == F.col("named")).drop("named")
    return _pairs(met(posted.where("not long"), [], F.lit(True)).unionByName(met(rows, bits, may_link("x", "y", threshold))), count)


def components(edges: DataFrame) -> DataFrame:
    """(class, root): the least class that each node of ``edges`` (a, b) reaches; alternating star contraction.

    Each round links every node's larger neighbours to the least of its neighbourhood, then its smaller ones; rounds
    grow as the logarithm of the nodes.  Written tables cut the lineage, so this runs jobs when it is called.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", shuffled=True)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least.select(F.expr("u + 0").alias("w"), "m"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least.select(F.expr("u + 0").alias("w"), "m"), F.col("u") == F.col("w"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        then = materialise(small, "edges", shuffled=True)
        dropped(now)
        # a forest of stars: no node has two smaller ends, or is one itself
        ends = then.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("over")), F.struct(F.col("v").alias("x"), F.lit(0).alias("over")))).alias("e")).groupBy("e.x").agg(F.sum("e.over").alias("over"), F.min("e.over").alias("least"))
        done = not ends.where("over > 1 OR (over = 1 AND least = 0)").limit(1).count()
        now = then
        if done:
            return _kept(now.select(F.col("u").alias("class"), F.col("v").alias("root")), now)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def settle(postings: DataFrame, linked: Callable[[DataFrame], DataFrame | None], threshold: float, count: int, bitmaps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b): links between classes, enough of them for the components; (class, root): the components of linked classes.

    ``linked`` takes candidate pairs (a, b, query) and returns those (a, b) that link, written, or None where no pair is
    left; ``bitmaps`` (class, b0 ...) bound the pairs of long lists.  ``postings`` is a written table and is deleted.
    Runs jobs when it is called.
    """
    links: list[DataFrame] = []
    tested: list[DataFrame] = []

    def judge(pairs: DataFrame) -> bool:
        for done in tested:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        tested.append(materialise(pairs, "candidates", shuffled=True))
        if (found := linked(tested[-1])) is None:
            return False
        links.append(found)
        tested[-1] = _kept(tested[-1].select("a", "b"), tested[-1])
        return True

    # at first every set is a component of its own, and no list has a largest one
    judge(_by_pivots(postings.withColumns({"root": F.col("class"), "largest": F.col("class").bitwiseXOR(F.lit(1).cast("long"))}), threshold, count))
    root, before = None, None
    while True:
        dropped(root)
        root = components(_union(links)) if links else None
        # lists whose sets still lie in several components
        own = root.select(F.expr("class + 0").alias("of"), "root") if links else postings.select(F.col("class").alias("of"), F.col("class").alias("root")).where(F.lit(False))
        labelled = postings.join(own, F.col("class") == F.col("of"), "left").drop("of").withColumn("root", F.coalesce("root", "class"))
        labelled = materialise(labelled, "labelled", shuffled=True)
        dropped(postings)
        per = labelled.groupBy("token", "root").agg(F.count("*").alias("k"), F.bool_or(F.col("cap") >= F.col("n")).alias("free"))
        still = per.groupBy("token").agg(F.count("*").alias("roots"), F.sum("k").alias("length"), F.bool_or("free").alias("free"), F.max(F.struct("k", "root")).alias("most")).where("roots > 1 AND free")
        still = still.select(F.expr("token + 0").alias("of"), F.col("most.root").alias("largest"), "length")
        opened = materialise(labelled.join(still, F.col("token") == F.col("of")).drop("of"), "open", shuffled=True)
        dropped(labelled)
        left = opened.agg(F.count("*").alias("n"), F.sum(F.when(F.col("root") != F.col("largest"), F.col("length"))).alias("pairs")).first()
        postings = _kept(opened.drop("root", "largest", "length"), opened)
        if not left.n:
            break
        if left.pairs <= PAIRS_PER_POSTING * left.n or (before is not None and left.pairs > SAVED * before):
            if judge(_by_lists(opened.withColumn("long", F.col("length") > LONG_LIST), bitmaps, threshold, count)):
                dropped(root)
                root = components(_union(links))
            break
        before = left.pairs if judge(_by_pivots(opened, threshold, count)) else 0
    spark = postings.sparkSession
    dropped(postings, *tested)
    return _union(links) if links else spark.createDataFrame([], "a long, b long"), root if links else spark.createDataFrame([], "class long, root long")
