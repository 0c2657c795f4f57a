"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh ``weights`` in turn and share ``budget`` times all words; a
target stops at ``ceiling`` times its source's words, and the excess is shared again by weight (water filling).

Rates: within a source the rates r of documents of size s minimise sum r (log r - 1) subject to 0 <= r <= ceiling and
sum r s = target.  The convex dual has one variable per source, and its solution tilts exponentially in the size:
r = min(ceiling, exp(lambda s / mean size)).  All sources' Newton steps run together, as joins and aggregates over the
counts by (source, size), which hold the same sums in far fewer rows; a step that leaves the bracket is a bisection.

Copies: rates are rounded by systematic sampling inside blocks of about ``block`` documents of one source, ordered by
size, so that a block's words differ from the rates' by less than its largest open document; of ``STARTS`` offsets
each block takes the one that comes nearest.  Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.runtime import WORD, dropped, materialise, row_key, text_or_empty, unused

WEIGHTS, BUDGET, CEILING, BLOCK, STEPS, STARTS = (3, 1, 2), 1.5, 2.0, 512, 80, 16
#: Distance from the targets, as a share of them, at which the steps may end at the latest, and that they try to reach.
LOOSE, TIGHT = 1e-6, 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, row, source, size): row hash and words of each text; null texts have none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), F.col("source").cast("string").alias("source"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))


def targets(by_source: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING) -> DataFrame:
    """Adds ``target`` to (source, source_size); one row per source, so the windows hold sources only."""
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(every.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(ceiling)
    x = by_source.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(every) * F.lit(budget)
    # Sources fill up in the order of cap / weight. With those before this one full, the rest share what is left.
    order = every.orderBy("level", F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    x = x.withColumn("share", (total - before) / open_weight)
    # The first source that its share doesn't fill sets the level for all from there on.
    x = x.withColumn("water", F.min(F.when(F.col("share") < F.col("level"), F.struct("level", "share"))).over(every)["share"])
    return x.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("water"))).alias("target"))


def _total(x):
    """A sum in fixed point: the same in whatever order the rows arrive, so that reruns agree."""
    return F.sum(F.round(x * 1e6).cast("decimal(38,0)")).cast("double") / 1e6


def balance(counts: DataFrame, goal: DataFrame, ceiling: float = CEILING, steps: int = STEPS) -> DataFrame:
    """(key, target, lam, mean): the dual's solution per source, from (key, size, n) and (key, target, source_size).

    Ends when every open source is within TIGHT of its target, or after ``steps``; an error if one is then not within LOOSE.
    """
    stats = counts.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    state = goal.join(stats, "key").select("key", "target", (F.col("target") >= F.col("source_size") * ceiling).alias("full"), "mean", F.lit(0.0).alias("lam"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"))
    state, off = materialise(state, "mix-state"), 0.0
    hist = counts.where("size > 0")
    for _ in range(steps):
        x = hist.join(state.where("not full"), "key").withColumn("z", F.col("size") / F.col("mean"))
        rate = F.exp(F.least(F.col("lam") * F.col("z"), F.log(F.lit(ceiling))))
        free = F.col("lam") * F.col("z") < F.log(F.lit(ceiling))
        sums = x.groupBy("key").agg(_total(F.col("n") * F.col("size") * rate).alias("made"), _total(F.when(free, F.col("n") * F.col("size") * F.col("z") * rate).otherwise(0.0)).alias("slope"))
        y = state.join(sums, "key", "left").withColumn("gap", F.col("target") - F.coalesce("made", F.lit(0.0)))
        y = y.withColumn("low", F.when(F.col("gap") >= 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") <= 0, F.col("lam")).otherwise(F.col("high")))
        newton = F.col("lam") + F.try_divide(F.col("gap"), F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        y = y.withColumn("next", F.when(F.col("full") | (F.col("made").isNull()), F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2))
        y = materialise(y.select("key", "target", "full", "mean", F.col("next").alias("lam"), "low", "high", (F.abs("gap") / F.greatest("target", F.lit(1.0))).alias("off")), "mix-state")
        dropped(state)
        state = y
        off = y.agg(F.max(F.when(~F.col("full") & (F.col("target") > 0), F.col("off"))).alias("off")).first().off or 0.0
        if off <= TIGHT:
            return state
    if off > LOOSE:
        raise RuntimeError(f"the rates stayed {off:.3g} of a target away from it after {steps} steps")
    return state


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING, block: int = BLOCK) -> DataFrame:
    """(doc_id, row, size, source, source_size, target, rate, copies, taken), one row per row of ``docs``.

    Null texts have size 0 and are not taken; a null source is a source of its own; ties are broken by doc_id, then by a
    hash of the row.  Wholly equal rows are rounded as one row of their number, however many they are: some of them get
    the rate rounded up, the others rounded down.  An empty table gives no rows.  Extra columns only count in the row's hash.  Runs its jobs when it is called.
    """
    own = materialise(sizes(docs).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mix-sizes")
    counts = materialise(own.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-counts")
    by_source = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    by_source = by_source.withColumn("source", F.when(F.col("key") != "n", F.expr("substring(key, 2)")))
    goal = materialise(targets(by_source, weights, budget, ceiling).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).join(by_source.select("key", "docs"), "key"), "mix-goal")
    tilt = balance(counts, goal.select("key", "target", "source_size"), ceiling)
    of = goal.join(tilt.select("key", "full", "mean", "lam"), "key").select(F.concat("key").alias("of"), "source_size", "target", "docs", "full", "mean", "lam")
    # concat() makes the key a new expression, so the join deals out both sides itself and can split a hot source
    equal = own.groupBy("doc_id", "row", "source", "size", "key").agg(F.count("*").alias("equal"))
    x = equal.join(of, equal["key"] == of["of"])
    z = F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("full"), F.lit(ceiling)).otherwise(F.exp(F.least(F.col("lam") * z, F.log(F.lit(ceiling)))))
    # dealt out by block: else the windows would keep the join's partitions, one for each source however large
    x = x.withColumn("rate", rate).withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.ceil(F.col("docs") / block))).repartition("key", "block")
    of_block = Window.partitionBy("key", "block").orderBy(F.desc("size"), "doc_id", "row")
    part = (F.col("rate") - F.floor("rate")) * F.col("equal")
    x = x.withColumn("part", part).withColumn("upto", F.sum("part").over(of_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy("key", "block")
    extra = lambda k: F.floor(F.col("upto") + (k + 0.5) / STARTS + 1e-9) - F.floor(F.col("upto") - F.col("part") + (k + 0.5) / STARTS + 1e-9)
    off = [F.struct(F.abs(F.sum(F.round((extra(k) - F.col("part")) * F.col("size") * 1e6).cast("long")).over(whole)).alias("off"), F.lit(k).alias("start")) for k in range(STARTS)]
    x = x.withColumn("start", F.array_min(F.array(*off))["start"])
    chosen = F.element_at(F.array(*(extra(k) for k in range(STARTS))), F.col("start") + 1)
    x = x.withColumn("chosen", chosen).withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), "equal")))
    x = x.withColumn("copies", F.least(F.floor("rate") + (F.col("no") <= F.col("chosen")).cast("int"), F.lit(int(ceiling))).cast("int"))
    return x.select("doc_id", "row", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def take(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows that it doesn't take go.

    Copies go by row, not by doc_id; of wholly equal rows the sum is taken.  Columns and their order stay, whatever
    their names; rows without words go; an empty table gives no rows.  Runs its jobs when it is called.
    """
    mixed = mix(docs, weights, budget, ceiling, block)
    by_row = mixed.groupBy("row", "doc_id").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    by_row = materialise(by_row, "mix-copies")
    row, of, of_id, times = (unused(docs.columns, x) for x in ("row", "of", "of_id", "times"))
    keyed = docs.withColumn(row, row_key(docs))
    on = (F.col(row) == F.col(of)) & F.col("doc_id").cast("long").eqNullSafe(F.col(of_id))
    named = by_row.select(F.col("row").alias(of), F.col("doc_id").alias(of_id), F.col("copies").alias(times), F.col("rows"))
    single = keyed.join(named.where("rows = 1").drop("rows"), on)
    equal = keyed.join(named.where("rows > 1").drop("rows"), on).dropDuplicates([row, of_id])
    every = single.unionByName(equal)
    return every.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*(f"`{c}`" for c in docs.columns))
