"""A whole scan as one plan: reports in, scored and deduplicated issues out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import guards
from siftline.operators import findings as ops
from siftline.sources import adapters

PLACE = ["file_path", "line_start", "line_end"]


@dataclass(frozen=True)
class Scan:
    """The tables of a scan: findings with scores, issues, redacted snippets by place, rows that no adapter could read, analyses;
    and the steps that were taken: (step, status, detail, duration_ms), as ``scans.trace`` and ``scans.degraded`` read them."""

    findings: DataFrame
    issues: DataFrame
    snippets: DataFrame | None
    rejected: DataFrame
    analyses: DataFrame | None = None
    members: DataFrame | None = None
    steps: tuple[tuple[str, str, str, int], ...] = ()


@dataclass(frozen=True)
class Outcome:
    """What a scanner returned: its reports (arrival, report), or why it couldn't run; ``partial`` says what it left out."""

    reports: DataFrame | None = None
    unavailable: str | None = None
    partial: str | None = None
    version: str = "unknown"


def gathered(reports: dict[str, DataFrame | Outcome]) -> DataFrame:
    """The findings of all reports, scanners in the given order, each scanner's rows in its own: ``arrival`` is that place.

    A DataFrame of reports has (arrival, report); its scanner's adapter is looked up by name.  Scanners that couldn't run
    add nothing; at least one must have reports.
    """
    found = {name: Outcome(x) if isinstance(x, DataFrame) else x for name, x in reports.items()}
    parts = [adapters.REGISTRY[name](x.reports, version=x.version).withColumn("_scanner", F.lit(no)) for no, (name, x) in enumerate(found.items()) if x.reports is not None]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    own = [c for c in ("arrival", "result", "kind", "at") if c in every.columns]
    return every.withColumn("arrival", F.struct("_scanner", *own)).drop("_scanner", *(c for c in own if c != "arrival"))


def redacted(findings: DataFrame, snippets: DataFrame) -> DataFrame:
    """``snippets`` with secrets masked in context and matched; a line inside a secret finding goes whole."""
    ranges = findings.where("domain = 'secret'").select(*PLACE, F.col("secret.kind").alias("kind"), F.col("arrival").alias("ord"))
    blocks = snippets.withColumn("place", F.struct(*PLACE))
    for text, start in (("context", "context_start"), ("matched", "line_start")):
        blocks = blocks.drop(text).join(guards.redact_blocks(blocks, ranges, ["place"], text, start), "place")
    return blocks.select(*snippets.columns)


def scan(
    reports: dict[str, DataFrame], files: DataFrame | None = None, triage: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None,
    min_score: float = 0.0, changed: DataFrame | None = None, duplicates: bool = True, on_step: Callable[[str], None] | None = None,
) -> Scan:
    """Adapts, cuts snippets, fingerprints, triages, scores, deduplicates.

    ``files`` (file_path, content) give snippets; ``triage`` takes the findings and the snippets and returns
    (instance_id, verdict, confidence, ord), the last by ord counting; without it no finding has a verdict.
    ``changed`` (file_path) keeps findings in those files only.  Issues below ``min_score`` are left out.  ``on_step`` is
    told each step as it begins; plans are lazy, so a step's time is that of planning and of the jobs it runs itself.
    """
    steps: list[tuple[str, str, str, int]] = []

    def step(name: str, status: str = "ok", detail: str = "") -> None:
        steps.append((name, status, detail, round((time.monotonic() - began[0]) * 1000)))
        began[0] = time.monotonic()

    began = [time.monotonic()]
    tell = on_step or (lambda name: None)
    tell("scan")
    for name, x in reports.items():
        if isinstance(x, Outcome) and (x.unavailable or x.partial):
            step(f"scan:{name}", "failed" if x.unavailable else "degraded", x.unavailable or x.partial)
        else:
            step(f"scan:{name}")
    every = gathered(reports)
    rejected, found = every.where("error IS NOT NULL"), every.where("error IS NULL").drop("error")
    if changed is not None:
        found = ops.changed_files(found, changed)
    tell("fingerprint")
    cut = ops.snippets(found.select(*PLACE).distinct(), files) if files is not None else None
    found = ops.fingerprint(found, cut)
    step("fingerprint")
    analyses = None
    if triage is not None:
        tell("triage")
        analyses = triage(found, cut)
        last = analyses.groupBy("instance_id").agg(F.max_by(F.struct("verdict", "confidence"), "ord").alias("_a"))
        found = found.join(last, "instance_id", "left").withColumns({"verdict": F.col("_a.verdict"), "confidence": F.col("_a.confidence")}).drop("_a")
    else:
        found = found.withColumns({"verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    step("triage", "ok" if triage is not None else "skipped")
    tell("score")
    found = ops.ranked(ops.risk(found))
    step("score")
    tell("report")
    members, why = ops.dedupe_members(found)
    issues = ops.issues_of(members, why, duplicates).where(F.col("primary.score") >= min_score)
    step("report")
    return Scan(found, issues, redacted(found, cut) if cut is not None else None, rejected, analyses, members, tuple(steps))


def primary_snippets(result: Scan) -> DataFrame:
    """(instance_id, context, context_start, truncated): the redacted context of each issue's primary finding, where there is any."""
    if result.snippets is None:
        raise ValueError("the scan had no files")
    first = Window.partitionBy("instance_id").orderBy("ord")
    places = result.findings.join(result.issues.select("primary.instance_id").distinct(), "instance_id", "left_semi")
    places = places.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("instance_id", *PLACE)
    return places.join(result.snippets, PLACE).where("context <> ''").select("instance_id", "context", "context_start", "truncated")


def exit_code(result: Scan) -> int:
    """1 if an issue needs action, else 0."""
    verdicts = result.findings.where(~ops.actionable(F.col("verdict"))).select("instance_id").distinct()
    left = result.issues.select("primary.instance_id").join(verdicts, "instance_id", "left_anti")
    return int(bool(left.limit(1).count()))
