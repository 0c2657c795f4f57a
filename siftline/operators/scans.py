"""What surrounds the findings of a scan: coverage, rule packs, policies, prompts, steps, provenance, quality gates.

Columns and DataFrames throughout; the plain-Python functions work on one small value that the driver holds (a policy,
a template, a list of names).
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import fixed
from siftline.functions import scalar as S

# Gates on a run's metrics; the stages of a scan and their names; archive suffixes, longest first.
GATES = {"recall": (">=", 0.95), "hold_rate": ("<=", 0.40), "noise_reduction": (">=", 0.15)}
STAGES = {
    "fetch": "Fetch source", "profile": "Profile repository", "scan": "Run scanners", "fingerprint": "Fingerprint & context",
    "redact": "Redact secrets", "triage": "AI triage", "score": "Risk scoring", "report": "Dedupe & report",
}
ARCHIVE_SUFFIX = r"(?i)(\.tar\.gz|\.tar\.bz2|\.tar\.xz|\.tgz|\.zip|\.tar)$"
DETAIL_CHARS = 400


def gate_failures(runs: DataFrame) -> DataFrame:
    """(gate, value, limit) for each gate that the newest run (greatest ``run``) fails; no rows: all pass."""
    newest = runs.agg(*(F.max_by(k, "run").alias(k) for k in GATES)).where(" OR ".join(f"{k} IS NOT NULL" for k in GATES))
    rows = [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(limit).alias("limit"), (F.col(k) < limit if sign == ">=" else F.col(k) > limit).alias("failed")) for k, (sign, limit) in GATES.items()]
    return newest.select(F.inline(F.array(*rows))).where("failed").drop("failed")


def metrics_text(metrics: DataFrame) -> DataFrame:
    """(report): a run's metrics as the lines that people read."""
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") + F.col("held")
    counts = F.format_string("n=%d  tp=%d fp=%d tn=%d fn=%d held=%d", total, "tp", "fp", "tn", "fn", "held")
    rates = F.format_string("recall=%.3f  precision=%.3f  f1=%.3f  mcc=%.3f", "recall", "precision", "f1", "mcc")
    return metrics.select(F.concat_ws("\n", counts, rates, F.format_string("hold_rate=%.3f  noise_reduction=%.3f", "hold_rate", "noise_reduction")).alias("report"))


def coverage(languages: DataFrame, ecosystems: DataFrame) -> DataFrame:
    """(domain, coverage, reason) for dependencies and for code, from ``findings.profile`` and ``findings.ecosystems``."""
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("name")))), ", ")
    e = ecosystems.select(F.col("ecosystem").alias("name"), (F.col("coverage") == "full").alias("locked"))
    e = e.agg(F.count("*").alias("n"), names(F.lit(True)).alias("all"), names(~F.col("locked")).alias("open"))
    level = F.when(F.col("n") == 0, "none").when(F.col("open") == "", "full").otherwise("partial")
    reason = F.when(F.col("n") == 0, fixed.NO_MANIFEST).when(F.col("open") == "", F.concat(F.lit(fixed.LOCKED), "all"))
    reason = reason.otherwise(F.concat(F.lit(fixed.UNLOCKED), "open", F.lit(fixed.UNRESOLVED)))
    l = languages.select(F.col("language").alias("name"), "supported").agg(names(F.col("supported")).alias("all"))
    code = F.when(F.col("all") == "", fixed.NO_LANGUAGE).otherwise(F.concat(F.lit(fixed.LANGUAGES_FOUND), "all"))
    sast = l.select(F.lit("sast").alias("domain"), F.when(F.col("all") == "", "none").otherwise("full").alias("coverage"), code.alias("reason"))
    return e.select(F.lit("sca").alias("domain"), level.alias("coverage"), reason.alias("reason")).unionByName(sast)


def rule_packs(languages: Column) -> Column:
    """The rule packs for an array of languages: the base packs, then the languages' own, sorted; null: the base packs."""
    base = F.array(*map(F.lit, fixed.BASE_PACKS))
    own = F.array_sort(F.array_distinct(F.filter(F.transform(languages, lambda x: S.lookup(fixed.RULE_PACK, x)), lambda x: x.isNotNull())))
    return F.concat(base, F.coalesce(own, F.array().cast("array<string>")))


def extractor(language: Column) -> Column:
    return S.lookup(fixed.EXTRACTOR, language)


def database_status(metadata: Column, now: Column) -> Column:
    """(present, stale, updated_at, next_update) of a vulnerability database's metadata JSON; null: absent, malformed: stale."""
    stamp = lambda key: F.try_to_timestamp(F.get_json_object(metadata, f"$.{key}"))
    whole = stamp("UpdatedAt").isNotNull() & stamp("NextUpdate").isNotNull()
    return F.struct(
        metadata.isNotNull().alias("present"), F.when(whole, now > stamp("NextUpdate")).otherwise(True).alias("stale"),
        F.when(whole, stamp("UpdatedAt")).alias("updated_at"), F.when(whole, stamp("NextUpdate")).alias("next_update"),
    )


def error_detail(output: Column, errors: Column) -> Column:
    """A failed scanner's own message, from the JSON it wrote, else what it wrote to the error stream."""
    first = F.get_json_object(output, "$.errors[0]")
    own = F.when(first.isNotNull(), F.coalesce(F.get_json_object(output, "$.errors[0].message"), F.lit("")))
    return F.substring(S.strip(F.coalesce(own, errors)), 1, DETAIL_CHARS)


def upload_label(name: Column) -> Column:
    """An archive's name without its suffix; no name: upload."""
    return F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit("upload")), ARCHIVE_SUFFIX, "")


def unknown_scanners(asked: Column, known: list[str]) -> Column:
    """The names asked for that no adapter has."""
    return F.array_except(asked, F.array(*map(F.lit, known)))


def policy_hash(policy: dict) -> str:
    """A risk policy's identity: the first 16 hex digits of SHA-256 over its compact JSON, keys in their own order."""
    return hashlib.sha256(json.dumps(policy, separators=(",", ":")).encode()).hexdigest()[:16]


def prompt_hash(template: str) -> str:
    return hashlib.sha256(template.encode()).hexdigest()[:16]


def render(template: str, values: dict[str, Column]) -> Column:
    """A prompt per row: ``{name}`` becomes the column's text, ``{{`` and ``}}`` braces; a name without a column is an error."""
    parts = re.split(r"(\{\{|\}\}|\{\w+\})", template)
    names = {p[1:-1] for p in parts if re.fullmatch(r"\{\w+\}", p)}
    if missing := sorted(names - set(values)):
        raise KeyError(f"prompt lacks values: {missing}")
    one = lambda p: F.lit({"{{": "{", "}}": "}"}.get(p, p)) if p[1:-1] not in names or not p.startswith("{") else F.coalesce(values[p[1:-1]].cast("string"), F.lit("None"))
    return F.concat(*(one(p) for p in parts if p)) if any(parts) else F.lit("")


def provenance(analyses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(model_id, prompt_versions): the model of the first analysis (by ord), the distinct prompt versions, sorted."""
    return analyses.groupBy(*(by or [])).agg(F.min_by("model_id", "ord").alias("model_id"), F.array_sort(F.collect_set("prompt_version")).alias("prompt_versions"))


def degraded(steps: DataFrame) -> DataFrame:
    """(scan_id, degraded): whether any step of a scan did less than its whole work."""
    return steps.groupBy("scan_id").agg(F.coalesce(F.bool_or(F.col("status") != "ok"), F.lit(False)).alias("degraded"))


def timings(steps: DataFrame) -> DataFrame:
    """``steps`` (scan_id, ord, step, duration_ms) with offset_ms, total_ms and share: where each step lies in its scan."""
    own = Window.partitionBy("scan_id")
    ms = F.coalesce(F.col("duration_ms"), F.lit(0)).cast("long")
    before = F.coalesce(F.sum(ms).over(own.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = steps.withColumns({"offset_ms": before, "total_ms": F.sum(ms).over(own)})
    return x.withColumn("share", F.coalesce(F.try_divide(ms, "total_ms"), F.lit(0.0)))


def trace(scans: DataFrame, steps: DataFrame) -> DataFrame:
    """(scan_id, stage_no, ord, step, label, status, detail, duration_ms): every stage of each scan, run or not.

    The stage "scan" holds the steps "scan:<scanner>".  A stage without steps is pending, or running when it is the
    current one of a scan in flight; a failed scan shows no pending stages.  ``scans``: scan_id, status, current_step,
    progress; ``steps``: scan_id, ord, step, status, detail, duration_ms.
    """
    names = F.array(*map(F.lit, STAGES))
    every = scans.select("scan_id", F.col("status").alias("scan_status"), "current_step", "progress", F.posexplode(names).alias("no", "stage"))
    part = F.when(F.col("step").startswith("scan:"), "scan").otherwise(F.col("step"))
    done = steps.where("step <> 'scan'").select(F.col("scan_id").alias("of"), part.alias("part"), "ord", "step", F.col("status").alias("done"), "detail", "duration_ms")
    first = done.groupBy("of", "part").agg(F.count("*").alias("n"))
    label = lambda key: F.when(key.startswith("scan:"), F.concat(F.lit("Scan · "), F.substr(key, F.lit(6)))).otherwise(F.coalesce(S.lookup(STAGES, key), key))
    ran = every.join(done, (F.col("scan_id") == F.col("of")) & (F.col("stage") == F.col("part")))
    ran = ran.select("scan_id", F.col("no").alias("stage_no"), "ord", "step", label(F.col("step")).alias("label"), F.col("done").alias("status"), "detail", F.col("duration_ms").cast("long").alias("duration_ms"))
    live = F.col("scan_status").isin("running", "queued") & F.coalesce(F.col("current_step") == F.col("stage"), F.lit(False))
    left = every.join(first, (F.col("scan_id") == F.col("of")) & (F.col("stage") == F.col("part")), "left").withColumn("live", live).where("n IS NULL OR (live AND stage = 'scan')")
    left = left.where("live OR scan_status <> 'failed'")
    left = left.select(
        "scan_id", F.col("no").alias("stage_no"), F.lit(None).cast(ran.schema["ord"].dataType).alias("ord"), F.col("stage").alias("step"), label(F.col("stage")).alias("label"),
        F.when(F.col("live"), "running").otherwise("pending").alias("status"), F.when(F.col("live"), F.coalesce("progress", F.lit("in progress…"))).otherwise("").alias("detail"), F.lit(None).cast("long").alias("duration_ms"),
    )
    return ran.unionByName(left)


def issue_summary(issues: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A scan's summary over issues: raw_findings, issues, actionable, dismissed, needs_review, multi_tool, and the
    actionable ones by severity.  ``verdicts`` (instance_id, verdict) tell the primary's verdict; none: needs_human."""
    own = verdicts.groupBy("instance_id").agg(F.max("verdict").alias("verdict"))
    x = issues.select("occurrences", "confirmed_by_multiple_tools", F.col("primary.severity").alias("severity"), F.col("primary.instance_id").alias("instance_id")).join(own, "instance_id", "left")
    verdict = F.coalesce("verdict", F.lit("needs_human"))
    act = verdict != "false_positive"
    counts = {"raw_findings": F.coalesce(F.sum("occurrences"), F.lit(0)), "issues": F.count("*"), "actionable": F.count_if(act), "dismissed": F.count_if(~act), "needs_review": F.count_if(verdict == "needs_human"), "multi_tool": F.count_if("confirmed_by_multiple_tools")}
    counts |= {s: F.count_if(act & (F.col("severity") == s)) for s in reversed(fixed.SEVERITIES)}
    return x.agg(*(v.cast("long").alias(k) for k, v in counts.items()))


def contribution_bars(contributions: Column) -> Column:
    """The contributions that are not zero, scaled by the largest magnitude (1 at least)."""
    kept = F.map_filter(contributions, lambda k, v: v != 0)
    most = F.greatest(F.coalesce(F.array_max(F.transform(F.map_values(kept), F.abs)), F.lit(1.0)), F.lit(1.0))
    return F.transform_values(kept, lambda k, v: v / most)


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long").cast("string")


def time_ago(at: Column, now: Column) -> Column:
    """How long ago, in words; a date from 30 days on."""
    s = F.greatest(now.cast("timestamp").cast("double") - at.cast("timestamp").cast("double"), F.lit(0.0))
    words = F.when(s < 45, "just now").when(s < 3600, F.concat(_half_up(s / 60), F.lit("m ago"))).when(s < 86400, F.concat(_half_up(s / 3600), F.lit("h ago")))
    return words.when(s < 30 * 86400, F.concat(_half_up(s / 86400), F.lit("d ago"))).otherwise(F.date_format(at, "yyyy-MM-dd"))


def duration(ms: Column) -> Column:
    """Milliseconds as ``12ms``, ``1.5s``, ``34s``, ``2m 5s``; tenths go by the double's exact value, ties up."""
    s = ms / 1000
    # ms / 1000 against the middle between two tenths: both differences are exact
    up = (ms % 100 > 50) | ((ms % 100 == 50) & ((16 * s - ms / 50) + 4 * s >= 0))
    tenths = F.floor(ms / 100) + F.when(up, 1).otherwise(0)
    short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
    return F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms"))).when(s < 10, short).when(s < 60, F.concat(_half_up(s), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), _half_up(s % 60), F.lit("s")))


def percent(x: Column) -> Column:
    return F.concat(_half_up(x * 100), F.lit("%"))


MEMBERS, MEMBER_BYTES, TOTAL_BYTES = 50_000, 100 << 20, 2 << 30


def accounted(members: DataFrame, most: int = MEMBERS, each: int = MEMBER_BYTES, total: int = TOTAL_BYTES) -> DataFrame:
    """``members`` (archive, ord, path, size) with total_bytes up to each one and ``problem``: why the archive can't be
    extracted from there on (an unsafe path, too many files, a file or a total too large), or null."""
    upto = Window.partitionBy("archive").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = members.withColumns({"total_bytes": F.sum("size").over(upto), "_n": F.count("*").over(upto)})
    problem = F.coalesce(S.unsafe_member(F.col("path")), F.when(F.col("_n") > most, "too many files").when(F.col("size") > each, "file too large").when(F.col("total_bytes") > total, "archive too large"))
    return x.withColumn("problem", problem).drop("_n")


def settings(path: str) -> dict:
    """A policy or label file as a dict: JSON, or YAML where a reader for it is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def policy(values: dict) -> dict:
    """A risk policy with the keys and types that ``risk`` and ``policy_hash`` rely on; KeyError or ValueError for a bad one."""
    if extra := sorted(set(values) - set(fixed.POLICY)):
        raise ValueError(f"unknown keys: {extra}")
    out = {k: ({n: float(v) for n, v in values[k].items()} if isinstance(kind, dict) else type(kind)(values[k])) for k, kind in fixed.POLICY.items()}
    if not 0 <= out["confidence_pull"] <= 1:
        raise ValueError("confidence_pull lies between 0 and 1")
    return out
