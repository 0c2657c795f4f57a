"""Whole scans and what surrounds them, against literals and plain Python."""

import hashlib
import json
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from siftline import catalogue
from siftline.operators import findings as ops
from siftline.operators import scans
from siftline.plans import pipeline, reports

SF = "/root/testdata/sf0.001"


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], list(given)) if given else spark.range(1)
    return row.select(column).first()[0]


def test_gates(spark):
    runs = spark.createDataFrame([("a", 0.1, 0.9, 0.0), ("b", 0.95, 0.41, 0.2)], "run string, recall double, hold_rate double, noise_reduction double")
    assert [tuple(r) for r in scans.gate_failures(runs).collect()] == [("hold_rate", 0.41, 0.40)]
    assert scans.gate_failures(runs.where("run = 'x'")).count() == 0


def test_metrics_text(spark):
    x = ops.metrics(spark.createDataFrame([(3, 1, 4, 1, 1, 1)], "tp long, fp long, tn long, fn long, held long, held_positive long"))
    assert scans.metrics_text(x).first()[0].splitlines()[:1] == ["n=10  tp=3 fp=1 tn=4 fn=1 held=1"]
    assert "recall=0.600  precision=0.750" in scans.metrics_text(x).first()[0]


def test_coverage(spark):
    files = spark.createDataFrame([("a.py", 9), ("package.json", 1), ("poetry.lock", 1), ("pyproject.toml", 1)], "path string, size long")
    got = {r.domain: (r.coverage, r.reason) for r in scans.coverage(ops.profile(files), ops.ecosystems(files)).collect()}
    assert got["sca"][0] == "partial" and got["sca"][1].startswith("no lockfile for npm;") and got["sast"] == ("full", "source detected for Python")
    none = files.where("false")
    got = {r.domain: (r.coverage, r.reason) for r in scans.coverage(ops.profile(none), ops.ecosystems(none)).collect()}
    assert got == {"sca": ("none", "no dependency manifests found"), "sast": ("none", "no files in a supported source language")}


def test_packs_labels_and_names(spark):
    assert value(spark, scans.rule_packs(F.array(F.lit("C++"), F.lit("Python"), F.lit("C"), F.lit("x")))) == ["p/security-audit", "p/secrets", "p/c", "p/python"]
    assert value(spark, scans.rule_packs(F.lit(None).cast("array<string>"))) == ["p/security-audit", "p/secrets"]
    assert [value(spark, scans.upload_label(F.col("x")), x=x) for x in ("a.tar.gz", "b.ZIP", "c.txt", "")] == ["a", "b", "c.txt", "upload"]
    assert value(spark, scans.unknown_scanners(F.array(F.lit("trivy"), F.lit("zz")), ["trivy"])) == ["zz"]
    assert value(spark, scans.extractor(F.lit("TypeScript"))) == "javascript"


@pytest.mark.parametrize("meta, want", [
    (None, (False, True)), ("{", (True, True)), ('{"UpdatedAt": "2024-01-01T00:00:00Z", "NextUpdate": "2024-01-03T00:00:00Z"}', (True, False)),
    ('{"UpdatedAt": "2024-01-01T00:00:00Z", "NextUpdate": "2024-01-01T06:00:00Z"}', (True, True)), ('{"UpdatedAt": "2024-01-01T00:00:00Z"}', (True, True)),
])
def test_database_status(spark, meta, want):
    x = spark.createDataFrame([(meta,)], "m string").select(scans.database_status(F.col("m"), F.lit("2024-01-02 00:00:00").cast("timestamp")).alias("s")).first().s
    assert (x.present, x.stale) == want


def test_error_detail(spark):
    detail = lambda out, err: value(spark, scans.error_detail(F.col("o"), F.col("e")), o=out, e=err)
    assert detail('{"errors": [{"message": " killed "}]}', "x") == "killed"
    assert detail('{"errors": []}', " why ") == "why" and detail("not json", "why") == "why" and len(detail("", "y" * 900)) == 400


def test_policies_and_prompts(spark):
    assert scans.policy_hash({"a": 1.0}) == hashlib.sha256(b'{"a":1.0}').hexdigest()[:16]
    assert scans.prompt_hash("x") == hashlib.sha256(b"x").hexdigest()[:16]
    assert value(spark, scans.render("{{{a}}} at {b}!", {"a": F.col("a"), "b": F.col("b")}), a="{b}", b=3) == "{{b}} at 3!"
    with pytest.raises(KeyError):
        scans.render("{a}", {})


def test_provenance_and_steps(spark):
    a = spark.createDataFrame([(2, "m2", "t.v3"), (1, "m1", "t.v2"), (3, "m3", "t.v3")], "ord int, model_id string, prompt_version string")
    assert tuple(scans.provenance(a).first()) == ("m1", ["t.v2", "t.v3"])
    steps = spark.createDataFrame([(1, 1, "profile", "ok", "", 10), (1, 2, "scan:trivy", "degraded", "late", 30), (2, 1, "fetch", "ok", "", None)], "scan_id int, ord int, step string, status string, detail string, duration_ms int")
    assert {r.scan_id: r.degraded for r in scans.degraded(steps).collect()} == {1: True, 2: False}
    assert {(r.scan_id, r.ord): (r.offset_ms, r.total_ms, r.share) for r in scans.timings(steps).collect()} == {(1, 1): (0, 40, 0.25), (1, 2): (10, 40, 0.75), (2, 1): (0, 0, 0.0)}
    heads = spark.createDataFrame([(1, "running", "scan", "2/3"), (2, "failed", None, None)], "scan_id int, status string, current_step string, progress string")
    got = {(r.scan_id, r.step): (r.label, r.status, r.detail) for r in scans.trace(heads, steps).collect()}
    assert got[1, "scan:trivy"] == ("Scan · trivy", "degraded", "late") and got[1, "scan"] == ("Run scanners", "running", "2/3") and got[1, "fetch"][1] == "pending"
    assert len([k for k in got if k[0] == 1]) == 9 and [k for k in got if k[0] == 2] == [(2, "fetch")]


def test_formats(spark):
    assert [value(spark, scans.duration(F.col("x")), x=x) for x in (12, 1500, 34400, 125000)] == ["12ms", "1.5s", "34s", "2m 5s"]
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    ago = lambda at: value(spark, scans.time_ago(F.col("x").cast("timestamp"), now), x=at)
    assert [ago(x) for x in ("2024-03-01 11:59:30", "2024-03-01 11:30:00", "2024-03-01 09:00:00", "2024-02-20 12:00:00", "2023-01-05 00:00:00")] == ["just now", "30m ago", "3h ago", "10d ago", "2023-01-05"]
    assert value(spark, scans.percent(F.lit(0.125))) == "13%"
    bars = value(spark, scans.contribution_bars(F.create_map(F.lit("a"), F.lit(-40.0), F.lit("b"), F.lit(0.0), F.lit("c"), F.lit(10.0))))
    assert bars == {"a": -1.0, "c": 0.25}


@pytest.mark.parametrize("by", [[], ["scan"]])
def test_ranked_is_the_total_order(spark, by):
    r = random.Random(3)
    rows = [(i, float(r.choice([0, 10, 10, 55])), r.choice("ab"), r.choice(["s", "t", None])) for i in range(300)]
    x = spark.createDataFrame(rows, "arrival int, score double, file_path string, scan string").drop(*({"scan"} - set(by)))
    want, seen = {}, {}
    for row in sorted(rows, key=lambda v: (-v[1], v[2], v[0])):
        k = row[3] if by else 0
        want[row[0]] = seen[k] = seen.get(k, 0) + 1
    assert {v.arrival: v.ord for v in ops.ranked(x).collect()} == want
    assert ops.ranked(x.limit(0)).count() == 0


def scan_of(spark, **more):
    rules = {"results": [
        {"check_id": "py.sql-injection", "path": "/a.py", "start": {"line": 2}, "end": {"line": 2}, "extra": {"message": "m", "severity": "ERROR", "metadata": {"cwe": "CWE-89: x", "confidence": "HIGH"}}},
        {"check_id": "generic.secrets.key", "path": "a.py", "start": {"line": 3}, "end": {"line": 3}, "extra": {"message": "k", "severity": "ERROR", "lines": "key = wxyz1234"}}]}
    sarif = {"runs": [{"tool": {"driver": {"rules": []}}, "results": [{"ruleId": "sqli", "message": {"text": "t"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 1}}}]}]}]}
    given = {"semgrep": rules, "codeql": sarif, "trivy": {"Results": [{"Target": "lock.json", "Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "p", "InstalledVersion": "1", "FixedVersion": "2", "Severity": "HIGH"}, {"PkgName": "q"}]}]}}
    files = spark.createDataFrame([("a.py", "import x\nq(u)\nkey = wxyz1234\nend")], "file_path string, content string")
    return pipeline.scan({k: spark.createDataFrame([(1, json.dumps(v))], "arrival int, report string") for k, v in given.items()}, files, **more)


def test_whole_scan(spark):
    got = scan_of(spark)
    assert got.findings.count() == 4 and got.rejected.count() == 1 and got.issues.count() == 4
    assert sorted(r.ord for r in got.findings.collect()) == [1, 2, 3, 4]
    shown = {r.instance_id: r.context for r in pipeline.primary_snippets(got).collect()}
    assert len(shown) == 3 and all("wxyz1234" not in c and "q(u)" in c for c in shown.values())
    assert pipeline.exit_code(got) == 1 and reports.terminal(got.issues).count() == 4
    row = scans.issue_summary(got.issues, got.findings.select("instance_id", "verdict")).first()
    assert (row.raw_findings, row.issues, row.actionable, row.dismissed, row.multi_tool) == (4, 4, 4, 0, 0)
    assert scan_of(spark, min_score=101.0).issues.count() == 0


def test_scan_with_triage(spark):
    dismiss = lambda found, cut: found.select("instance_id", F.lit("false_positive").alias("verdict"), F.lit(1.0).alias("confidence"), F.lit(1).alias("ord"))
    got = scan_of(spark, triage=dismiss, duplicates=False)
    assert pipeline.exit_code(got) == 0 and "duplicates" not in got.issues.columns
    assert {r.score for r in got.findings.where("severity = 'critical'").collect()} == {60.0}


def test_durations_of_all_events(spark):
    def shown(ms):
        if ms < 1000:
            return f"{ms}ms"
        s, half_up = ms / 1000, lambda x, unit="1": Decimal(x).quantize(Decimal(unit), ROUND_HALF_UP)
        return f"{half_up(s, '0.1')}s" if s < 10 else f"{half_up(s)}s" if s < 60 else f"{ms // 60000}m {half_up(s % 60)}s"

    got = spark.range(70000).select("id", scans.duration(F.col("id")).alias("shown")).collect()
    assert [r for r in got if r.shown != shown(r.id)] == []
    got = catalogue.QUERIES["durations"](spark, SF).collect()
    want = [(r.event_id, shown(r.event_id * 37 % 200000)) for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(want) and any("." in v for _, v in want)
