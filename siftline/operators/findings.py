"""Operators on findings: validation, fingerprints, risk, deduplication, reconciliation, snippets, summaries, evaluation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import fixed
from siftline.functions import scalar as S
from siftline.functions.guards import lines
from siftline.operators.graph import components, discard, written
from siftline.operators.scans import policy_hash

LINE_PROXIMITY = 3
CONTEXT_LINES, MATCHED_CHARS, CONTEXT_CHARS, SNIPPET_BYTES = 8, 4000, 8000, 2 << 20


def validate(findings: DataFrame) -> DataFrame:
    """Adds ``violations``: the names of the row constraints that a finding breaks."""
    rules = {
        "path": S.relative_path(F.col("file_path")).isNull(),
        "lines": F.coalesce((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")), F.lit(True)),
        "cwe": ~F.forall(F.coalesce("cwe_ids", F.array().cast("array<string>")), lambda c: c.rlike(r"^CWE-\d+$")),
        "severity": ~F.coalesce(F.col("severity").isin(*fixed.SEVERITIES), F.lit(False)),
        "domain": ~F.coalesce(F.col("domain").isin(*fixed.DOMAINS), F.lit(False)),
        "package": (F.col("domain") == "sca") & F.col("package").isNull(),
        "secret": (F.col("domain") == "secret") & F.col("secret").isNull(),
    }
    found = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()))
    return findings.withColumn("violations", F.filter(found, lambda v: v.isNotNull()))


def readable(files: DataFrame, max_bytes: int = SNIPPET_BYTES) -> DataFrame:
    """(file_path, content as text) of files (file_path, content: text or bytes): none that is too large or has a NUL in its
    first 8192 bytes; bytes that are no UTF-8 become replacement characters; a path that leaves its root is an error."""
    raw = F.col("content").cast("binary")
    path = F.when(S.relative_path(F.col("file_path")).isNull(), F.raise_error(F.concat(F.lit("snippet path is outside the scan root: "), "file_path")).cast("string")).otherwise(F.col("file_path"))
    return files.where((F.octet_length(raw) <= max_bytes) & ~S.looks_binary(raw)).select(path.alias("file_path"), F.make_valid_utf8(raw.cast("string")).alias("content"))


#: Places of one file that are cut together, about.
PLACES = 1 << 14


def snippets(keys: DataFrame, files: DataFrame) -> DataFrame:
    """``keys`` (file_path, line_start, line_end) with matched, context, context_start, truncated from ``files``
    (file_path, content), as ``readable`` gives them; a missing file or a start beyond its end gives empty text.

    Each distinct place is cut once.  The places of a file come to its text in blocks of about PLACES, sorted, and a block
    splits the text into one array of lines, from which places take slices.  So neither the text nor its lines travel
    with every key; what is shuffled is the keys, a text for each block, and the snippets.
    """
    place = ["file_path", "line_start", "line_end"]
    places = keys.select(*place).distinct()
    many = places.groupBy(F.col("file_path").alias("m_path")).agg(F.count("*").alias("n")).where(F.col("n") > PLACES)
    dealt = places.join(many, F.col("file_path") == F.col("m_path"), "left").withColumn("block", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("line_start", "line_end"), F.ceil(F.col("n") / PLACES))))
    blocks = dealt.groupBy("file_path", "block").agg(F.array_sort(F.collect_list(F.struct("line_start", "line_end"))).alias("places"))
    # concat() makes the path a new expression: the join deals out both sides itself and can split a hot file
    x = blocks.join(files.select(F.concat("file_path").alias("f_path"), "content"), F.col("file_path") == F.col("f_path")).select("file_path", "places", lines(F.col("content")).alias("all"))
    x = x.select("file_path", "all", F.explode("places").alias("p")).select("file_path", "p.line_start", "p.line_end", "all")
    total = F.size("all")
    ok = F.col("line_start") <= total
    last, start = F.least("line_end", total), F.greatest(F.col("line_start") - CONTEXT_LINES, F.lit(1))
    end = F.least(last + CONTEXT_LINES, total)
    matched = F.array_join(F.slice("all", F.col("line_start"), F.greatest(last - F.col("line_start") + 1, F.lit(0))), "\n")
    context = F.array_join(F.slice("all", start, end - start + 1), "\n")
    x = x.where(ok).select(*(F.col(k).alias(f"c_{k}") for k in place), matched.alias("matched"), context.alias("context"), start.alias("context_start"))
    cut = x.select(*(f"c_{k}" for k in place), F.substring("matched", 1, MATCHED_CHARS).alias("matched"), F.substring("context", 1, CONTEXT_CHARS).alias("context"), "context_start", ((F.length("matched") > MATCHED_CHARS) | (F.length("context") > CONTEXT_CHARS)).alias("truncated"))
    on = (F.col("file_path") == F.col("c_file_path")) & (F.col("line_start") == F.col("c_line_start")) & F.col("line_end").eqNullSafe(F.col("c_line_end"))
    out = keys.join(cut, on, "left").drop(*(f"c_{k}" for k in place))
    return out.fillna({"matched": "", "context": "", "context_start": 1, "truncated": True})


def fingerprint(findings: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Adds instance_id, issue_id, content_signature; ``found`` are snippets keyed by place."""
    place = ["file_path", "line_start", "line_end"]
    x = findings.join(found.select(*place, F.col("matched").alias("snippet")).dropDuplicates(place), place, "left") if found is not None else findings.withColumn("snippet", F.lit(None).cast("string"))
    c = F.col
    return x.withColumns({
        "instance_id": S.instance_id(c("tool"), c("rule_id"), c("file_path"), c("line_start"), c("snippet")),
        "issue_id": S.issue_id(c("domain"), c("file_path"), c("cwe_ids"), c("rule_id"), c("package.name"), c("cve_id"), c("secret.kind"), c("secret.last_four")),
        "content_signature": S.content_signature(c("tool"), c("rule_id"), c("snippet")),
    })


def risk(findings: DataFrame, policy: dict = fixed.POLICY) -> DataFrame:
    """Adds score (0 to 100) and contributions, rounded to two places, held_by_policy and policy_hash.

    Needs severity, domain, file_path, verdict (null: no analysis), confidence, package.  No analysis weighs as
    needs_human without blending; a critical finding dismissed below the floor is lifted to it and held.
    """
    c = F.col
    base = S.lookup(policy["severity_base"], c("severity"))
    path = S.lookup(policy["path_multiplier"], S.path_role(c("file_path")))
    factors = policy["verdict_multiplier"]
    verdict = F.when(c("verdict").isNull(), F.lit(factors["needs_human"])).otherwise(S.blend(S.lookup(factors, c("verdict")), c("confidence"), policy["confidence_pull"]))
    x = findings.withColumns({"_base": base, "_path": path, "_verdict": verdict})
    x = x.withColumn("_placed", c("_base") * c("_path")).withColumn("_judged", c("_placed") * c("_verdict"))
    bonus = F.when(S.fix_availability(c("package.name"), c("package.fixed_version")) == 1, policy["sca_fix_bonus"]).otherwise(0.0) + F.when(S.dependency_depth(c("package.name"), c("package.is_direct")) == 1, policy["sca_direct_bonus"]).otherwise(0.0)
    x = x.withColumn("_bonus", F.when(c("domain") == "sca", bonus).otherwise(0.0)).withColumn("_raw", c("_judged") + c("_bonus"))
    floor = policy["critical_floor"]
    floored = F.coalesce((c("severity") == "critical") & (c("verdict") == "false_positive") & (c("_raw") < floor), F.lit(False))
    x = x.withColumn("held_by_policy", floored).withColumn("_lifted", F.when(c("held_by_policy"), F.lit(floor)).otherwise(c("_raw")))
    parts = {"severity": c("_base"), "path_role": c("_base") * (c("_path") - 1), "verdict": c("_placed") * (c("_verdict") - 1), "dependency": F.when(c("domain") == "sca", c("_bonus")), "policy_floor": F.when(c("held_by_policy"), c("_lifted") - c("_raw"))}
    x = x.withColumns({f"_{k}_part": v for k, v in parts.items()} | {"_clamped": F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("_lifted")))})
    x = x.withColumns({f"_{k}_part": S.round2(c(f"_{k}_part")) for k in parts})
    of = lambda *names: F.create_map(*(v for k in names for v in (F.lit(k), c(f"_{k}_part"))))
    three, more, held = ("severity", "path_role", "verdict"), c("_dependency_part").isNotNull(), c("_policy_floor_part").isNotNull()
    named = F.when(more & held, of(*parts)).when(more, of(*three, "dependency")).when(held, of(*three, "policy_floor")).otherwise(of(*three))
    x = x.withColumns({"contributions": named, "score": S.round2(c("_clamped")), "policy_hash": F.lit(policy_hash(policy))})
    return x.drop("_base", "_path", "_verdict", "_placed", "_judged", "_bonus", "_raw", "_lifted", "_clamped", *(f"_{k}_part" for k in parts))


def placed(findings: DataFrame) -> DataFrame:
    """Adds ``ord``, a struct that sorts as (score descending, path, arrival) does: for what only compares places, as ``reconcile``
    does, this is enough, and nothing is sorted or written."""
    return findings.withColumn("ord", F.struct((-F.col("score")).alias("score"), "file_path", "arrival"))


def ranked(findings: DataFrame) -> DataFrame:
    """Adds ``ord``, the place in (score descending, path, arrival) order, within each ``scan`` where there is that column.

    One task never sorts a whole scan: rows are dealt into ranges of that order, sorted and written with their number in the
    range, and a small table of the ranges' sizes tells how many rows of the scan come before.  So a use of the result is
    a scan of what was written, without a sort or a shuffle of its own.  Whole rows are written, so filter them and drop
    what isn't needed first.  Runs its jobs when it is called.
    """
    by = ["scan"] if "scan" in findings.columns else []
    order = [F.desc("score"), F.col("file_path"), F.col("arrival")]
    slices = int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(findings, "scored")  # else the ranges' sample would make every row once more
    # the upper bits of that id are the partition's number, the lower ones count its rows
    x = written(rows.repartitionByRange(slices, *by, *order).sortWithinPartitions(*by, *order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    discard(rows)
    x = x.withColumns({"_slice": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = x.groupBy("_slice", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("_slice").alias("_of"), *(F.col(k).alias(f"_{k}") for k in by), (F.coalesce(before, F.lit(0)) - F.col("_from") + 1).alias("_before"))
    on = F.col("_slice") == F.col("_of")
    for k in by:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    x = x.join(F.broadcast(sizes), on)  # a row for each range and scan
    return x.withColumn("ord", (F.col("_at") + F.col("_before")).cast("long")).select(*findings.columns, "ord")


def correlated(findings: DataFrame) -> DataFrame:
    """(a, b, group_a, group_b, reason): pairs of code findings of two tools in one file, at most LINE_PROXIMITY lines
    apart, with related weaknesses.  Bands of LINE_PROXIMITY + 1 lines keep a hot file from meeting itself whole."""
    band = F.floor(F.col("line_start") / (LINE_PROXIMITY + 1))
    x = findings.where("domain = 'sast'").select("ord", "tool", "issue_id", "file_path", "line_start", "cwe_ids", band.alias("band"))
    y = x.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    l, r = x.alias("l"), y.alias("r")
    gap = F.abs(F.col("l.line_start") - F.col("r.line_start"))
    on = (F.col("l.file_path") == F.col("r.file_path")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.tool") != F.col("r.tool")) & (F.col("l.issue_id") != F.col("r.issue_id")) & (gap <= LINE_PROXIMITY) & S.related(F.col("l.cwe_ids"), F.col("r.cwe_ids"))
    reason = F.concat(F.lit("cwe-related findings from "), "l.tool", F.lit(" and "), "r.tool", F.lit(" within "), gap.cast("string"), F.lit(" line(s)"))
    return l.join(r, on).select(F.col("l.ord").alias("a"), F.col("r.ord").alias("b"), F.col("l.issue_id").alias("group_a"), F.col("r.issue_id").alias("group_b"), reason.alias("reason"))


def dedupe_members(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with ``component``; (component, correlation_reason)): exact groups of one issue_id, and correlated groups
    merged as connected components.  ``component`` is the least ord of a component.  Runs its jobs when it is called."""
    groups = findings.groupBy("issue_id").agg(F.min("ord").alias("g"))
    # findings alike in all that correlation reads stand for each other; the earliest has the least place
    alike = findings.where("domain = 'sast'").groupBy("domain", "tool", "issue_id", "file_path", "line_start", "cwe_ids").agg(F.min("ord").alias("ord"))
    edges = written(correlated(alike), "correlated")
    first, second = (groups.select(F.col("issue_id").alias(f"group_{x}"), F.col("g").alias(f"g_{x}")) for x in "ab")
    edges = edges.join(first, "group_a").join(second, "group_b")
    root = components(edges.select(F.col("g_a").alias("a"), F.col("g_b").alias("b")))
    why = edges.join(root, edges["g_a"] == root["root"], "left_semi").groupBy("g_a").agg(F.min_by("reason", F.struct("g_b", "a", "b")).alias("correlation_reason"))
    labelled = groups.join(root, groups["g"] == root["node"], "left").select("issue_id", F.coalesce("root", "g").alias("component"))
    members = findings.join(labelled.withColumnRenamed("issue_id", "_issue"), F.col("issue_id").eqNullSafe(F.col("_issue"))).drop("_issue")
    return members, why.withColumnRenamed("g_a", "component")


def dedupe(findings: DataFrame, duplicates: bool = True) -> DataFrame:
    """One row per issue: issue_id, primary, duplicates, tools, occurrences, confirmed_by_multiple_tools, correlation_reason.

    Without ``duplicates`` that column is left out and nothing grows with an issue's findings: the primary is a partial
    aggregate.  With it, an issue's findings are one array of its row; ``dedupe_members`` and ``reports.json_duplicates``
    give them as rows.

    Findings (with ord, issue_id, instance_id, tool, score) of one issue_id are a group; correlated groups merge, as
    connected components; the primary is first by (score descending, tool, instance_id).  The reason is that of the
    edge from the component's earliest group to the earliest other group, by the findings' order.  Runs jobs when it is
    called.
    """
    return issues_of(*dedupe_members(findings), duplicates)


def issues_of(members: DataFrame, why: DataFrame, duplicates: bool = True) -> DataFrame:
    """The issues of ``dedupe_members``."""
    own = [c for c in ("title", "cwe_ids") if c in members.columns]
    member = F.struct(F.negative("score").alias("order"), "tool", "instance_id", "issue_id", "rule_id", "severity", "score", "file_path", "line_start", "ord", *own)
    more = [F.array_sort(F.collect_list(member)).alias("m")] if duplicates else []
    out = members.groupBy("component").agg(F.min(member).alias("primary"), F.count("*").cast("int").alias("occurrences"), F.array_sort(F.collect_set("tool")).alias("tools"), *more)
    out = out.join(why, "component", "left")
    rest = [F.slice("m", 2, 1 << 30).alias("duplicates")] if duplicates else []
    return out.select("primary.issue_id", "primary", *rest, "tools", "occurrences", (F.size("tools") > 1).alias("confirmed_by_multiple_tools"), F.coalesce("correlation_reason", F.lit("")).alias("correlation_reason"), "component")


def reconcile(current: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """(issue_id, status, previous_id): new, persisting, renamed or fixed.

    ``current`` has (ord, issue_id, content_signature), ``baseline`` the same.  An id in both persists.  A new id whose
    signature is that of a vanished id is a rename: of twins the last vanished id and the first new finding match.
    """
    now = current.groupBy("issue_id").agg(F.min("ord").alias("ord"))
    if baseline is None:
        return now.select("issue_id", F.lit("new").alias("status"), F.lit(None).cast("string").alias("previous_id"))
    base = baseline.where("issue_id IS NOT NULL").groupBy("issue_id").agg(F.min("ord").alias("ord"), F.max_by("content_signature", F.when(F.col("content_signature").isNotNull(), F.col("ord"))).alias("signature"))
    kept = now.join(base.select("issue_id"), "issue_id", "left_semi")
    fresh = current.join(base.select("issue_id"), "issue_id", "left_anti")
    gone = base.join(now.select("issue_id"), "issue_id", "left_anti")
    lost = gone.where("signature IS NOT NULL").groupBy("signature").agg(F.max_by("issue_id", "ord").alias("previous_id"))
    found = fresh.where("content_signature IS NOT NULL").groupBy(F.col("content_signature").alias("signature")).agg(F.min_by("issue_id", "ord").alias("issue_id"))
    renamed = found.join(lost, "signature").groupBy("issue_id").agg(F.min("previous_id").alias("previous_id"))
    new = fresh.select("issue_id").distinct().join(renamed, "issue_id", "left_anti")
    fixed_ids = gone.select("issue_id").join(renamed.select(F.col("previous_id").alias("issue_id")), "issue_id", "left_anti")
    as_row = lambda df, status, previous=None: df.select("issue_id", F.lit(status).alias("status"), (F.col(previous) if previous else F.lit(None).cast("string")).alias("previous_id"))
    return as_row(kept, "persisting").unionByName(as_row(renamed, "renamed", "previous_id")).unionByName(as_row(new, "new")).unionByName(as_row(fixed_ids, "fixed"))


def changed_files(findings: DataFrame, paths: DataFrame) -> DataFrame:
    return findings.join(paths.select("file_path"), "file_path", "left_semi")


def actionable(verdict: Column) -> Column:
    return F.coalesce(verdict, F.lit("needs_human")) != "false_positive"


def facets(findings: DataFrame, verdict: str | None = None, severities: list[str] | None = None, domain: str | None = None, query: str = "") -> DataFrame:
    """The rows that a view's filters leave: verdict tab, severities, domain, and text in title, path, rule or weakness."""
    x = findings
    if verdict:
        x = x.where(actionable(F.col("verdict")) if verdict == "actionable" else F.coalesce("verdict", F.lit("needs_human")) == verdict)
    if severities:
        x = x.where(F.col("severity").isin(*severities))
    if domain:
        x = x.where(F.col("domain") == domain)
    if query:
        fields = F.concat(F.array("title", "file_path", "rule_id", "cve_id", "package.name"), F.coalesce("cwe_ids", F.array().cast("array<string>")))
        x = x.where(F.exists(fields, lambda f: F.coalesce(F.lower(f).contains(query.lower()), F.lit(False))))
    return x


def summary(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of a scan: rows, actionable, dismissed, needing a human, and actionable ones by severity (zeros kept)."""
    verdict = F.coalesce("verdict", F.lit("needs_human"))
    counts = {"n": F.count("*"), "actionable": F.count_if(verdict != "false_positive"), "dismissed": F.count_if(verdict == "false_positive"), "needs_human": F.count_if(verdict == "needs_human")}
    counts |= {s: F.count_if((F.col("severity") == s) & (verdict != "false_positive")) for s in reversed(fixed.SEVERITIES)}
    return findings.groupBy(*(by or [])).agg(*(v.alias(k) for k, v in counts.items()))


def facet_counts(issues: DataFrame) -> DataFrame:
    """(actionable, true_positive, needs_human, false_positive, all): what each tab of a view holds; no verdict: needs_human."""
    verdict = F.coalesce("verdict", F.lit("needs_human"))
    counts = {"actionable": F.count_if(verdict != "false_positive")} | {v: F.count_if(verdict == v) for v in ("true_positive", "needs_human", "false_positive")} | {"all": F.count("*")}
    return issues.agg(*(v.alias(k) for k, v in counts.items()))


def groups(findings: DataFrame, key: str) -> DataFrame:
    """(key, n, members): the instance ids of each key in the findings' order.  A member list is one array; for counts use
    ``summary`` or ``facet_counts``, which keep partial aggregates only."""
    member = F.struct("ord", "instance_id")
    return findings.groupBy(key).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(member)), lambda m: m["instance_id"]).alias("members"))


def confusion(rows: DataFrame, truth: str, verdict: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, held, held_positive of predictions against a 0/1 truth; no prediction counts as held."""
    t, v = F.col(truth) == 1, F.coalesce(verdict, F.lit("needs_human"))
    says = lambda w, true: F.count_if((v == w) & (t if true else ~t))
    return rows.groupBy(*(by or [])).agg(says("true_positive", True).alias("tp"), says("true_positive", False).alias("fp"), says("false_positive", False).alias("tn"), says("false_positive", True).alias("fn"), F.count_if(v == "needs_human").alias("held"), says("needs_human", True).alias("held_positive"))


def metrics(counts: DataFrame) -> DataFrame:
    """Adds recall, precision, f1, mcc, hold_rate, noise_reduction and whether the gates pass; zero for empty divisors."""
    c = {k: F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn", "held", "held_positive")}
    total = c["tp"] + c["fp"] + c["tn"] + c["fn"] + c["held"]
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    x = counts.withColumns({"recall": over(c["tp"], c["tp"] + c["fn"] + c["held_positive"]), "precision": over(c["tp"], c["tp"] + c["fp"]), "hold_rate": over(c["held"], total), "noise_reduction": over(c["tn"], total)})
    x = x.withColumn("f1", over(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    spread = F.sqrt((c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"]))
    x = x.withColumn("mcc", over(c["tp"] * c["tn"] - c["fp"] * c["fn"], spread))
    return x.withColumn("gates_pass", (F.col("recall") >= 0.95) & (F.col("hold_rate") <= 0.40) & (F.col("noise_reduction") >= 0.15))


def match_labels(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """``findings`` with the first label (by label_ord) of the same case, file and weakness at most 3 lines away.

    Labels lie in bands of LINE_PROXIMITY + 1 lines and their neighbours, so a file of many labels isn't met whole."""
    width = LINE_PROXIMITY + 1
    l = labels.select(F.col("case").alias("l_case"), F.col("file_path").alias("l_path"), F.col("line").alias("l_line"), F.col("cwe").alias("l_cwe"), "vulnerable", "label_ord")
    l = l.withColumn("l_band", F.explode(F.array(*(F.floor(F.col("l_line") / width) + k for k in (-1, 0, 1)))))
    x = findings.select("ord", "case", "file_path", "line_start", F.explode("cwe_ids").alias("one"), F.floor(F.col("line_start") / width).alias("band"))
    on = (F.col("case") == F.col("l_case")) & (F.col("file_path") == F.col("l_path")) & (F.col("one") == F.col("l_cwe")) & (F.col("band") == F.col("l_band")) & (F.abs(F.col("line_start") - F.col("l_line")) <= LINE_PROXIMITY)
    best = x.join(l, on).groupBy("ord").agg(F.min_by(F.struct("label_ord", "vulnerable"), "label_ord").alias("label"))
    return findings.join(best, "ord", "left")


def evaluate(findings: DataFrame, labels: DataFrame, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(confusion and metrics, one row; unmatched findings) of findings against labels.

    A finding without a label is unmatched: (case, place, rule_id).  Labelled findings are scored once an instance, by
    the last (by ord) label and verdict; ``verdicts`` (instance_id, verdict, ord) may lack some (held), and without the
    table everything is kept, as true_positive.
    """
    x = match_labels(findings, labels)
    place = F.concat("file_path", F.lit(":"), F.col("line_start").cast("string"))
    unmatched = x.where("label IS NULL").select("case", place.alias("place"), "rule_id", "ord")
    truth = x.where("label IS NOT NULL").groupBy("instance_id").agg(F.max_by("label.vulnerable", "ord").alias("vulnerable"))
    if verdicts is None:
        truth = truth.withColumn("verdict", F.lit("true_positive"))
    else:
        last = verdicts.groupBy("instance_id").agg(F.max_by("verdict", "ord").alias("verdict"))
        truth = truth.join(last, "instance_id", "left")
    return metrics(confusion(truth.withColumn("truth", F.col("vulnerable").cast("int")), "truth", "verdict")), unmatched


def judged(findings: DataFrame, judge: Callable[[dict, dict | None], str | None], files: DataFrame | None = None) -> DataFrame:
    """(instance_id, verdict, ord) of findings (case, file_path, line_start, line_end, instance_id, ord, ...) by a callable,
    for ``evaluate``: the tasks that hold the findings call ``judge(finding, snippet)`` for each.

    ``files`` (case, file_path, content) give the snippets (matched, context, context_start, truncated); without them, or
    without the file, the snippet is None.  A verdict of None holds the finding.  ``judge`` must be picklable.
    """
    x = findings.withColumn("_path", F.concat_ws("/", "case", "file_path"))
    cut = ("matched", "context", "context_start", "truncated")
    if files is None:
        x = x.withColumn("_snippet", F.lit(None).cast("string"))
    else:
        sources = readable(files.select(F.concat_ws("/", "case", "file_path").alias("file_path"), "content"))
        found = snippets(x.select(F.col("_path").alias("file_path"), "line_start", "line_end").distinct(), sources).where("context <> ''")
        found = found.select(F.col("file_path").alias("_of"), F.col("line_start").alias("_first"), F.col("line_end").alias("_last"), F.to_json(F.struct(*cut)).alias("_snippet"))
        x = x.join(found, (F.col("_path") == F.col("_of")) & (F.col("line_start") == F.col("_first")) & F.col("line_end").eqNullSafe(F.col("_last")), "left")
    own = x.select("instance_id", "ord", F.to_json(F.struct(*findings.columns), {"ignoreNullFields": "false"}).alias("finding"), "_snippet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("finding").to_pylist(), batch.column("_snippet").to_pylist())
            verdicts = [judge(json.loads(finding), json.loads(snippet) if snippet else None) for finding, snippet in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("instance_id"), pa.array(verdicts, pa.string()), batch.column("ord")], ["instance_id", "verdict", "ord"])

    return own.mapInArrow(run, f"instance_id string, verdict string, ord {findings.schema['ord'].dataType.simpleString()}")


def excluded(path: Column) -> Column:
    """Whether a file lies under a directory that profiles leave out."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, fixed.EXCLUDED_DIRS)))


def file_counts(files: DataFrame, max_bytes: int = 5 << 20) -> DataFrame:
    """(total_files, scanned_files, skipped_files, total_bytes) of a table (path, size): files under excluded directories,
    larger ones and those without a size (unreadable) are skipped; the total leaves out the excluded directories."""
    out = excluded(F.col("path"))
    kept = ~out & F.coalesce(F.col("size") <= max_bytes, F.lit(False))
    return files.agg(F.count_if(~out).alias("total_files"), F.count_if(kept).alias("scanned_files"), F.count_if(~kept).alias("skipped_files"), F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("total_bytes"))


def top_languages(languages: DataFrame, limit: int = 5) -> DataFrame:
    """The first languages by bytes, each with its share of all."""
    return languages.orderBy(F.desc("bytes"), "language").limit(limit)


def profile(files: DataFrame, max_bytes: int = 5 << 20) -> DataFrame:
    """(language, files, bytes, share, supported) of a table (path, size), without excluded directories and oversize files."""
    kept = files.where(~excluded(F.col("path")) & (F.col("size") <= max_bytes))
    x = kept.withColumn("language", S.language_of(F.col("path"))).where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy(F.lit(0)))
    return x.select("language", "files", "bytes", F.try_divide("bytes", total).alias("share"), F.col("language").isin(*fixed.SAST_LANGUAGES).alias("supported"))


def ecosystems(files: DataFrame) -> DataFrame:
    """(ecosystem, manifests, locks, coverage): ecosystems that have a manifest."""
    name = F.element_at(F.split("path", "/"), -1)
    x = files.select(name.alias("name"), S.lookup(fixed.MANIFESTS, name).alias("m"), S.lookup(fixed.LOCKS, name).alias("l")).withColumn("ecosystem", F.coalesce("m", "l")).where("ecosystem IS NOT NULL")
    x = x.groupBy("ecosystem").agg(F.array_sort(F.collect_set(F.when(F.col("m").isNotNull(), F.col("name")))).alias("manifests"), F.array_sort(F.collect_set(F.when(F.col("l").isNotNull(), F.col("name")))).alias("locks"))
    return x.where(F.size("manifests") > 0).withColumn("coverage", F.when(F.size("locks") > 0, "full").otherwise("partial"))
