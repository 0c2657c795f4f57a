"""Reports of deduplicated issues: JSON, SARIF, HTML, PDF, a terminal table; every writer fails by itself.

What grows with a scan is written by partition: as one valid file (``json_file``, ``sarif_file``) or as a folder of parts
(``write_json``, ``write_sarif``); the documents that people read are made on the driver and take a limit.
"""

from __future__ import annotations

import html
import json
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import fixed
from siftline.functions.scalar import report_level
from siftline.plans.onefile import write_document

DUPLICATE = ("instance_id", "tool", "rule_id", "title", "severity", "cwe_ids", "score", "location")


@dataclass(frozen=True)
class Header:
    """What a report says of its scan: ids, time, provenance, the profile's figures, coverage notes, steps that did less."""

    scan_id: str = ""
    org_id: str = ""
    project_id: str = ""
    generated_at: str = ""
    scanned_files: int = 0
    primary_language: str | None = None
    provenance: dict = field(default_factory=dict)
    coverage: tuple[dict, ...] = ()
    degraded: tuple[dict, ...] = ()

    def notes(self) -> list[str]:
        return [f"coverage {c['domain']}: {c['reason']}" for c in self.coverage if c["coverage"] != "full"]


def _location(x: Column) -> Column:
    return F.concat(x["file_path"], F.lit(":"), x["line_start"].cast("string"))


def _duplicate(d: Column) -> Column:
    return F.struct(*(_location(d).alias(k) if k == "location" else d[k].alias(k) for k in DUPLICATE))


def with_details(issues: DataFrame, findings: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """``issues`` with ``finding`` (the primary's whole row, as a struct), ``analysis`` (by instance; the last by ord) and ``holds``."""
    own = findings.select(F.col("ord").alias("_ord"), F.struct(*(c for c in findings.columns if c not in ("ord", "contributions", "score", "held_by_policy", "policy_hash"))).alias("finding"), "contributions", "held_by_policy")
    x = issues.join(own, F.col("primary.ord") == F.col("_ord")).drop("_ord")
    if analyses is None:
        x = x.withColumn("analysis", F.lit(None).cast("struct<verdict:string,holds:array<string>>"))
    else:
        last = analyses.groupBy(F.col("instance_id").alias("_of")).agg(F.max_by(F.struct(*(c for c in analyses.columns if c not in ("ord", "instance_id"))), "ord").alias("analysis"))
        x = x.join(last, F.col("primary.instance_id") == F.col("_of"), "left").drop("_of")
    policy = F.when(F.col("held_by_policy"), F.array(F.lit("policy"))).otherwise(F.array().cast("array<string>"))
    return x.withColumn("holds", F.array_union(F.coalesce("analysis.holds", F.array().cast("array<string>")), policy)).withColumn("verdict", F.coalesce("analysis.verdict", "finding.verdict", F.lit("needs_human")) if "verdict" in findings.columns else F.coalesce("analysis.verdict", F.lit("needs_human")))


def json_issues(issues: DataFrame) -> DataFrame:
    """(issue_id, report): one JSON object an issue; duplicates keep their own identity and place.

    With ``with_details`` the object has the whole finding, analysis, contributions and holds; otherwise the primary.
    Issues of ``dedupe(duplicates=False)`` have no list, however many findings they have: ``json_duplicates`` has those.
    """
    detailed = "finding" in issues.columns
    more = [F.col("finding"), F.col("analysis"), F.col("primary.score").alias("score"), "contributions", "holds"] if detailed else [F.col("primary").alias("finding"), F.col("primary.score").alias("score")]
    dups = [F.transform("duplicates", _duplicate).alias("duplicates")] if "duplicates" in issues.columns else []
    body = F.struct("issue_id", "occurrences", "tools", "confirmed_by_multiple_tools", *more, "correlation_reason", *dups)
    return issues.select("issue_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def json_duplicates(issues: DataFrame, members: DataFrame) -> DataFrame:
    """(issue_id, ord, duplicate): one JSON object a finding that is no primary, one row each, so a hot issue is no large row.

    ``members``: findings with ``component``, as ``dedupe_members`` gives them.
    """
    of = issues.select(F.col("component").alias("_c"), F.col("issue_id").alias("_issue"), F.col("primary.ord").alias("_first"))
    x = members.join(of, F.col("component") == F.col("_c")).where("ord <> _first")
    row = F.struct(*x.columns)
    return x.select(F.col("_issue").alias("issue_id"), "ord", F.to_json(_duplicate(row), {"ignoreNullFields": "false"}).alias("duplicate"))


def json_document(header: Header, issues: DataFrame, limit: int = 10_000) -> str:
    """The whole JSON report of the first ``limit`` issues, for people; ``write_json`` has no limit."""
    rows = json_issues(issues.orderBy(F.desc("primary.score"), "issue_id").limit(limit))
    order = issues.select("issue_id", "primary.score").orderBy(F.desc("score"), "issue_id").limit(limit)
    found = rows.join(order, "issue_id").orderBy(F.desc("score"), "issue_id").select("report").toLocalIterator()
    return json.dumps(_head(header) | {"issues": [json.loads(r.report) for r in found]}, indent=2)


def _head(header: Header) -> dict:
    return {k: getattr(header, k) for k in ("scan_id", "org_id", "project_id", "generated_at", "provenance")} | {"coverage": list(header.coverage)}


def _object(known: dict, **rest: list) -> list:
    """The sections of a JSON object: ``known`` members, then arrays whose sections are given."""
    sections = [json.dumps(known)[:-1]]
    for i, (name, rows) in enumerate(rest.items()):
        sections += [(", " if known or i else "") + json.dumps(name) + ": [\n", *rows, "]"]
    return [*sections, "}\n"]


def json_file(header: Header, issues: DataFrame, path: str, members: DataFrame | None = None) -> int:
    """The whole JSON report as one valid file at ``path``, issues by score, then issue_id; returns its bytes.

    ``issues`` of ``dedupe(duplicates=False)`` and ``members`` give the other findings of all issues as a second array,
    ``duplicates``, so that an issue with very many of them is no large row.
    """
    score = issues.select(F.col("issue_id").alias("_issue"), F.col("primary.score").alias("_score"))
    rows = json_issues(issues).join(score, F.col("issue_id") == F.col("_issue")).select("report", "_score", "issue_id")
    arrays = {"issues": [(rows, [F.desc("_score"), F.col("issue_id")])]}
    if members is not None:
        each = json_duplicates(issues, members).select(F.concat(F.lit('{"issue_id":'), F.to_json(F.array("issue_id")).substr(F.lit(2), F.length(F.to_json(F.array("issue_id"))) - 2), F.lit(',"duplicate":'), "duplicate", F.lit("}")).alias("value"), "issue_id", "ord")
        arrays["duplicates"] = [(each, [F.col("issue_id"), F.col("ord")])]
    return write_document(issues.sparkSession, path, _object(_head(header), **arrays))


def sarif_file(findings: DataFrame, path: str, tool: str = "siftline", version: str = "1") -> int:
    """All findings, by ord, as one valid SARIF 2.1.0 file at ``path``; returns its bytes.  Rules are rows as well."""
    rules = sarif_rules(findings).select(F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct("tags").alias("properties"))).alias("rule"), "rule_id")
    driver = _object({"name": tool, "version": version}, rules=[(rules, [F.col("rule_id")])])
    results = sarif_results(findings).select("result", "ord")
    top = json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"})[:-1]
    sections = [top + ', "runs": [{"tool": {"driver": ', *driver, '}, "results": [\n', (results, [F.col("ord")]), "]}]}\n"]
    return write_document(findings.sparkSession, path, sections)


def write_json(header: Header, issues: DataFrame, folder: str, members: DataFrame | None = None) -> None:
    """``folder``/header (one line), /issues and, with ``members``, /duplicates: JSON lines, written by partition."""
    spark = issues.sparkSession
    spark.createDataFrame([(json.dumps(_head(header)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/header")
    json_issues(issues).select("report").write.mode("overwrite").text(f"{folder}/issues")
    if members is not None:
        json_duplicates(issues, members).select(F.to_json(F.struct("issue_id", "ord", F.col("duplicate"))).alias("value")).write.mode("overwrite").text(f"{folder}/duplicates")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_id, title, tags): each rule once, as its first finding (by ord) has it."""
    tags = F.transform("cwe_ids", lambda c: F.concat(F.lit("external/cwe/"), F.lower(c)))
    return findings.groupBy("rule_id").agg(F.min_by(F.struct("title", tags.alias("tags")), "ord").alias("r")).select("rule_id", "r.title", "r.tags")


def sarif_results(findings: DataFrame) -> DataFrame:
    """(ord, result): one SARIF result object a finding."""
    region = F.struct(F.col("line_start").alias("startLine"), F.col("line_end").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select("ord", F.to_json(F.struct(F.col("rule_id").alias("ruleId"), report_level(F.col("severity")).alias("level"), F.struct(F.coalesce(F.nullif("description", F.lit("")), "title").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("issue_id").alias("issueId")).alias("partialFingerprints"))).alias("result"))


def _sarif(tool: str, version: str, rules: Iterable, results: list) -> dict:
    listed = [{"id": r.rule_id, "shortDescription": {"text": r.title}, "properties": {"tags": r.tags}} for r in rules]
    return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": listed}}, "results": results}]}


def sarif_document(findings: DataFrame, tool: str = "siftline", version: str = "1", limit: int = 100_000) -> str:
    """A whole SARIF 2.1.0 document of the first ``limit`` findings by ord; ``write_sarif`` has no limit."""
    some = findings.where(F.col("ord") <= limit)
    return json.dumps(_sarif(tool, version, sarif_rules(some).orderBy("rule_id").toLocalIterator(), [json.loads(r.result) for r in sarif_results(some).orderBy("ord").toLocalIterator()]), indent=2)


def write_sarif(findings: DataFrame, folder: str, tool: str = "siftline", version: str = "1") -> None:
    """``folder``/run: the document without its results; /results: one result a line, in ranges of ord, by partition."""
    head = json.dumps(_sarif(tool, version, sarif_rules(findings).orderBy("rule_id").toLocalIterator(), []))
    findings.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/run")
    sarif_results(findings).repartitionByRange("ord").sortWithinPartitions("ord").select("result").write.mode("overwrite").text(f"{folder}/results")


def totals(issues: DataFrame) -> DataFrame:
    """(issues, actionable, dismissed) of issues with a verdict."""
    gone = F.coalesce("verdict", F.lit("needs_human")) == "false_positive"
    return issues.agg(F.count("*").alias("issues"), F.count_if(~gone).alias("actionable"), F.count_if(gone).alias("dismissed"))


def terminal(issues: DataFrame, limit: int = 40) -> DataFrame:
    """The table a terminal shows: the first issues by score; where issues have ``holds``, ``shown`` marks the held ones with !."""
    x = issues.select("issue_id", F.col("primary.severity").alias("severity"), F.col("primary.score").alias("score"), F.col("primary.rule_id").alias("rule_id"), "occurrences", *(c for c in ("holds", "verdict", "tools") if c in issues.columns), _location(F.col("primary")).alias("location"))
    x = x.orderBy(F.desc("score"), "issue_id").limit(limit)
    mark = F.when(F.size("holds") > 0, "!").otherwise("") if "holds" in x.columns else F.lit("")
    return x.withColumn("shown", F.concat(F.format_string("%.0f", F.bround("score", 0)), mark))


def terminal_text(header: Header, issues: DataFrame, limit: int = 40) -> str:
    """What a terminal prints: files and language, the table, counts, coverage notes, degraded steps."""
    rows = terminal(issues, limit).collect()
    out = [f"{header.scanned_files} files · {header.primary_language or 'unknown'}", ""]
    if rows:
        table = [("score", "sev", "verdict", "rule", "location", "tools"), *((r.shown, r.severity, r.verdict.replace("_", " "), r.rule_id, r.location, ",".join(r.tools)) for r in rows)]
        width = [max(len(str(row[k])) for row in table) for k in range(6)]
        out += ["  ".join(str(v).ljust(w) for v, w in zip(row, width)).rstrip() for row in table]
        n = totals(issues).first()
        out += ["", f"{n.issues} issues · {n.actionable} actionable · {n.dismissed} dismissed"]
    else:
        out.append("no findings")
    return "\n".join([*out, *header.notes(), *(f"degraded {s['step']}: {s['detail']}" for s in header.degraded)])


def _listed(issues: DataFrame, limit: int) -> tuple[list, object]:
    p = "primary"
    rows = issues.orderBy(F.desc(f"{p}.score"), "issue_id").limit(limit)
    verdict = F.coalesce("verdict", F.lit("needs_human")) if "verdict" in issues.columns else F.lit("needs_human")
    title = F.col(f"{p}.title") if "title" in issues.schema[p].dataType.names else F.col(f"{p}.rule_id")
    found = rows.select("issue_id", f"{p}.severity", f"{p}.score", title.alias("title"), _location(F.col(p)).alias("location"), "tools", verdict.alias("verdict")).collect()
    return found, totals(issues.withColumn("verdict", verdict)).first()


def html_document(issues: DataFrame, title: str = "Findings", limit: int = 1000, header: Header | None = None) -> str:
    """A page of the first ``limit`` issues by score with counts of all and the coverage notes; all text escaped."""
    e, header = lambda x: html.escape(str(x if x is not None else "")), header or Header()
    rows, n = _listed(issues, limit)
    cells = "".join(f"<tr><td>{r.score:.0f}</td><td>{e(r.severity)}</td><td>{e(r.verdict.replace('_', ' '))}</td><td>{e(r.title)}</td><td>{e(r.location)}</td><td>{e(', '.join(r.tools))}</td></tr>" for r in rows)
    meta = f"<p>{e(header.project_id)} · scan {e(header.scan_id)} · generated {e(header.generated_at)}<br>{header.scanned_files} files scanned · {e(header.primary_language or 'unknown')}</p>"
    table = f"<p>{n.issues} issue{'s' if n.issues != 1 else ''} · {n.actionable} actionable</p><table><tr><th>Risk</th><th>Severity</th><th>Verdict</th><th>Rule</th><th>Location</th><th>Tools</th></tr>{cells}</table>" if rows else "<p>No findings.</p>"
    notes = "".join(f"<p>{e(x)}</p>" for x in header.notes())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1>{meta}{table}{notes}</body></html>"


def pdf_document(issues: DataFrame, title: str = "Findings", limit: int = 1000, header: Header | None = None) -> bytes:
    """The same table as a PDF of plain text lines: built-in Helvetica, Latin-1, titles cut to 60 characters."""
    header = header or Header()
    rows, n = _listed(issues, limit)
    lines = [title, f"{header.project_id} - scan {header.scan_id} - generated {header.generated_at}", f"{header.scanned_files} files scanned - {header.primary_language or 'unknown'}", ""]
    lines += [f"{n.issues} issue(s) - {n.actionable} actionable", "", "Risk  Severity  Verdict  Rule  Location", *(f"{r.score:.0f}  {r.severity}  {r.verdict.replace('_', ' ')}  {r.title[:60]}  {r.location}" for r in rows)] if rows else ["No findings."]
    return _pdf([lines[i : i + 56] for i in range(0, len(lines), 56)])


def _pdf(pages: list[list[str]]) -> bytes:
    """A PDF 1.4 file of pages of lines."""
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for k, lines in enumerate(pages):
        shown = b"".join(b"(" + x.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T*\n" for x in lines)
        stream = zlib.compress(b"BT /F1 9 Tf 12 TL 40 760 Td\n" + shown + b"ET")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>".encode())
        objects.append(f"<< /Length {len(stream)} /Filter /FlateDecode >>\nstream\n".encode() + stream + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for no, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{no} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def report_order(formats: Column, order: tuple[str, ...] = fixed.REPORT_ORDER) -> Column:
    """The formats there are, in the order that lists show them."""
    return F.filter(F.array(*map(F.lit, order)), lambda f: F.array_contains(formats, f))


def quick_format(status: Column, formats: Column) -> Column:
    """The format offered first for a completed scan; null if there is none."""
    return F.when(status == "completed", F.get(report_order(formats, fixed.QUICK_ORDER), F.lit(0)))


def download_name(label: Column, scan_id: Column, form: Column, prefix: str = "siftline") -> Column:
    """A file name from a scan's label, with - for what isn't a letter, digit, -, _ or a dot."""
    return F.concat(F.lit(f"{prefix}-"), F.regexp_replace(label, r"[^\p{L}\p{N}\-_.]", "-"), F.lit("-"), scan_id, F.lit("."), form)


def write_all(writers: dict[str, Callable[[], None]]) -> dict[str, str]:
    """Runs every writer; returns the names of those that failed, with the reason."""
    notes = {}
    for name, write in writers.items():
        try:
            write()
        except Exception as error:  # a format that fails leaves the others standing, and says so
            notes[name] = f"{type(error).__name__}: {error}"
    return notes
