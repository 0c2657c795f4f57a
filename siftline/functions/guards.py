"""Guards on text: directives to reviewers, secrets, evidence windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import fixed
from siftline.functions.folding import nfkd
from siftline.functions.scalar import entropy, strip

#: Line ends as a text reader sees them; CR LF is one.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def lines(text: Column) -> Column:
    """Array of lines; a line end at the very end adds none."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def fold(line: Column, unicode: bool = False) -> Column:
    """Look-alike letters as Latin, runs of blanks as one; with ``unicode``, decomposed first."""
    return F.regexp_replace(F.translate(nfkd(line) if unicode else line, *fixed.LOOKALIKES), r"[ \t]+", " ")


def directive(line: Column) -> Column:
    """Number of the reason why a folded line is suspicious, or null."""
    named = line.rlike("(?iU)" + fixed.ADDRESSEE)
    return F.when(line.rlike(fixed.SUPPRESSION), None).when(line.rlike(fixed.ADDRESSED) | line.rlike(fixed.REVERSED), 0).when(line.rlike(fixed.AUTHORITY) & named, 1).when(line.rlike(fixed.JAILBREAK), 2)


def scan_directives(texts: DataFrame, key: str, text: str, start: str | None = None, unicode: bool = True) -> DataFrame:
    """(key, line, excerpt, reason) of every suspicious line."""
    first = F.col(start) if start else F.lit(1)
    x = texts.select(key, first.alias("start"), F.posexplode(lines(F.col(text))).alias("at", "raw"))
    x = x.withColumn("why", directive(fold(F.col("raw"), unicode))).where(F.col("why").isNotNull())
    return x.select(key, (F.col("start") + F.col("at")).alias("line"), F.substring(strip(F.col("raw")), 1, 200).alias("excerpt"), F.element_at(F.array(*map(F.lit, fixed.REASONS)), F.col("why") + 1).alias("reason"))


def is_suspicious(text: Column, unicode: bool = True) -> Column:
    """Whether any line of a text addresses an automated reviewer."""
    folded = fold(F.regexp_replace(text, LINE_END, "\n"), unicode)
    return F.exists(F.split(folded, "\n", -1), lambda line: directive(line).isNotNull())


def first_signal(text: Column, start: Column, unicode: bool = True) -> Column:
    """struct(line, excerpt, reason) of the first suspicious line of a text that begins at line ``start``; null for none."""
    raw = lines(text)
    folded = F.split(fold(F.array_join(raw, "\n"), unicode), "\n", -1)
    every = F.filter(F.transform(folded, lambda line, i: F.struct(i.alias("at"), directive(line).alias("why"))), lambda x: x["why"].isNotNull())
    found = F.get(every, F.lit(0))
    reason = F.element_at(F.array(*map(F.lit, fixed.REASONS)), found["why"] + 1)
    return F.when(found.isNotNull(), F.struct((start + found["at"]).alias("line"), F.substring(strip(F.get(raw, found["at"])), 1, 200).alias("excerpt"), reason.alias("reason")))


def redact_line(line: Column, least: float = fixed.TOKEN_ENTROPY) -> Column:
    """Provider keys by pattern, then every long token of high entropy; a line without either is only looked at once."""
    whole, found = line, line.rlike("|".join((fixed.TOKEN, *fixed.PROVIDER_KEYS.values())))
    for kind, pattern in fixed.PROVIDER_KEYS.items():
        line = F.regexp_replace(line, pattern, f"<REDACTED:{kind}>")
    tokens = F.regexp_extract_all(line, F.lit(fixed.TOKEN), F.lit(0))
    masked = F.transform(tokens, lambda t: F.when(entropy(t) >= least, "<REDACTED:high-entropy>").otherwise(t))
    between = F.split(line, fixed.TOKEN, -1)
    woven = F.array_join(F.transform(F.arrays_zip(between.alias("b"), masked.alias("m")), lambda x: F.concat(x["b"], F.coalesce(x["m"], F.lit("")))), "")
    return F.when(~found, whole).when(F.size(tokens) == 0, line).otherwise(woven)


#: Levels of the dyadic intervals of line numbers: level k has intervals of 2^k lines.
LEVELS = 62


def intervals(first: Column, last: Column) -> Column:
    """Array of struct(level, place): the fewest dyadic intervals that make up the lines ``first`` .. ``last``, at most two a
    level, so fewer than 2 log2 of the range; empty where ``last`` is before ``first``, null where either is."""
    begin, end = first.cast("long"), last.cast("long") + 1

    def of(level: Column) -> Column:
        # the whole intervals of this level are low .. high - 1; those whose parent is not whole stand alone
        low, high = F.call_function("shiftright", begin + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level), F.call_function("shiftright", end, level)
        left, right = F.when((low < high) & (low % 2 != 0), low), F.when((low < high) & (high % 2 != 0), high - 1)
        return F.filter(F.array(left, F.when(~(left.eqNullSafe(right)), right)), lambda x: x.isNotNull())

    # no interval of a range is longer than the range
    levels = F.sequence(F.lit(0), F.when(end > begin, F.least(F.floor(F.log2((end - begin).cast("double"))).cast("int"), F.lit(LEVELS))).otherwise(0))
    parts = F.flatten(F.transform(levels, lambda k: F.transform(of(k), lambda x: F.struct(k.alias("level"), x.alias("place")))))
    return F.when(end > begin, parts).when(end <= begin, F.slice(parts, 1, 0))


def redact_blocks(blocks: DataFrame, secrets: DataFrame, key: list[str], text: str, start: str, least: float = fixed.TOKEN_ENTROPY) -> DataFrame:
    """``blocks`` (key, file_path, text, start) with the text redacted.

    A line that a secret of the file covers (file_path, line_start, line_end, kind, ord) is masked whole, by the first
    such secret; other lines by ``redact_line``.
    """
    x = blocks.select(*key, "file_path", F.posexplode(F.split(text, "\n", -1)).alias("at", "line"), F.col(start).alias("first")).withColumn("no", F.col("first") + F.col("at"))
    cover = covered(x.select(*key, "at", "file_path", "no"), secrets, [*key, "at"])
    y = x.join(cover, [*key, "at"], "left").withColumn("line", F.when(F.col("kind").isNotNull(), F.concat(F.lit("<REDACTED:"), "kind", F.lit(">"))).otherwise(redact_line(F.col("line"), least)))
    return y.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda v: v["line"]), "\n").alias(text))


def covered(rows: DataFrame, secrets: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind, by): kind and ord of the first secret that covers each of the lines (key, file_path, no); others are left out.

    A secret's range is cut into dyadic intervals, of which each keeps its first secret; a line looks up the interval that
    holds it at each level that its file's secrets use.  So a range of any length is a few rows, a line meets one row a
    level, and a file with many ranges is dealt out by interval.  Null paths and numbers cover nothing.
    """
    cut = secrets.select("file_path", "kind", "ord", F.explode(intervals(F.col("line_start"), F.col("line_end"))).alias("i"))
    parts = cut.groupBy(F.col("file_path").alias("s_path"), F.col("i.level").alias("s_level"), F.col("i.place").alias("s_place")).agg(F.min_by("kind", "ord").alias("kind"), F.min("ord").alias("s_ord"))
    used = parts.groupBy(F.concat("s_path").alias("u_path")).agg(F.collect_set("s_level").alias("levels"))
    x = rows.join(used, F.col("file_path") == F.col("u_path")).withColumn("_level", F.explode("levels")).withColumn("_place", F.expr("shiftright(CAST(no AS BIGINT), _level)"))
    hits = x.join(parts, (F.col("file_path") == F.col("s_path")) & (F.col("_level") == F.col("s_level")) & (F.col("_place") == F.col("s_place")))
    return hits.groupBy(*key).agg(F.min_by("kind", "s_ord").alias("kind"), F.min("s_ord").alias("by"))


def within_window(evidence: Column, context: Column, context_start: Column) -> Column:
    """Whether every piece of evidence (array of structs with line_start) lies in the shown context; no evidence passes."""
    last = context_start + F.size(lines(context)) - 1
    return F.forall(evidence, lambda e: (e["line_start"] >= context_start) & (e["line_start"] <= last))
