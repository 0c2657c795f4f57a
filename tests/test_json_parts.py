"""Elements of JSON documents that are read in splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siftline.sources.json_parts import Beginning, Reader, Summing, beginnings, read_elements, steps

TARGETS = {"results": "results[]", "rules": "runs[0].tool.rules[]", "inner": "runs[0].results[]"}


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind < 2:
        return "".join(rng.choice(['a', ',', '"', "\\", "{", "]", "é", "\n", "results", ": ["]) for _ in range(rng.randrange(8)))
    if kind < 6:
        return rng.choice([1, -2.5, None, True, "", "results"])
    if kind == 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "results", "b,c", "runs"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def document(rng):
    runs = [{"tool": {"rules": [value(rng) for _ in range(rng.randrange(4))], "x": value(rng)}, "results": [value(rng) for _ in range(rng.randrange(6))]} for _ in range(rng.randrange(3))]
    members = [("results", [value(rng) for _ in range(rng.randrange(6))]), ("runs", runs), ("other", value(rng)), ("nested", {"results": [1, {"results": [2]}]})]
    rng.shuffle(members)
    return dict(members[: rng.randrange(1, 5)])


def wanted(doc):
    runs = doc.get("runs") or []
    found = {"results": doc.get("results", []), "rules": runs[0]["tool"]["rules"] if runs else [], "inner": runs[0]["results"] if runs else []}
    return {k: v for k, v in found.items() if v}


def split_read(text, cuts):
    """As the tasks do it, over splits that begin after the commas ``cuts``."""
    parsed = {k: steps(p) for k, p in TARGETS.items()}
    edges = [0, *cuts, len(text)]
    spans = list(zip(edges, edges[1:]))
    sums = []
    for a, b in spans:
        s = Summing(b == len(text))
        s.feed((text[a:b] if b == len(text) else text[a : b - 1]).split(b","))
        s.end()
        sums.append((a, s.sums))
    out, parts, errors = [], {}, []
    for (a, b), (_, begin) in zip(spans, beginnings(sums, parsed)):
        if begin is None:
            continue
        r = Reader(parsed, begin, b == len(text), len(spans) == 1)
        for piece in (text[a:b] if b == len(text) else text[a : b - 1]).split(b","):
            r.feed([piece])
        r.end()
        for target, no, piece, begins, ends in r.found:
            if begins and ends:
                out.append((a + no, target, piece))
            else:
                parts.setdefault(a if begins else begin.of, []).append((a + no, target, piece, ends))
        errors += [r.error] if r.error else []
    for p in parts.values():
        if any(x[3] for x in p):
            p.sort(key=lambda x: x[0])
            out.append((p[0][0], p[0][1], b"".join(x[2] for x in p)))
    found = {}
    for _, target, piece in sorted(out):
        found.setdefault(target, []).append(json.loads(piece))
    return found, errors


def test_splits_equal_the_whole_document():
    rng = random.Random(9)
    for _ in range(1500):
        doc = document(rng)
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode()
        commas = [i + 1 for i, c in enumerate(text) if c == 44]
        cuts = sorted(rng.sample(commas, min(len(commas), rng.choice([0, 1, 2, 5, 50]))))
        assert split_read(text, cuts) == (wanted(doc), []), (text, cuts)


def test_cut_documents_give_what_is_whole():
    rng = random.Random(10)
    for _ in range(600):
        doc = {"results": [value(rng) for _ in range(6)], "z": 1}
        text = json.dumps(doc).encode()
        text = text[: rng.randrange(1, len(text))]
        commas = [i + 1 for i, c in enumerate(text[:-1]) if c == 44]
        found, errors = split_read(text, sorted(rng.sample(commas, min(len(commas), 2))))
        got = found.get("results", [])
        assert got == doc["results"][: len(got)] and errors == ["the document ends early"]
        closed = sum(1 for n in range(6) if len(json.dumps(doc["results"][: n + 1])) + len('{"results": ') <= len(text))
        assert len(got) >= closed - 1


@pytest.mark.parametrize("text", [b"[1, 2}", b'{"results": [1]} {}', b"{}}", b'"text"', b"12", b'{"results": [1]]', b"{} x", b"{},{}"])
def test_faults(text):
    found, errors = split_read(text, [])
    assert len(errors) == 1 and found in ({}, {"results": [1]})


def test_elements_of_files(spark, tmp_path):
    rng = random.Random(11)
    docs = {f"d{i}.json": document(rng) for i in range(20)}
    docs["big.json"] = {"results": [{"n": i, "t": "x,y" * (i % 50), "deep": [[i, [i]]]} for i in range(3000)] + ["one, " * 30_000, 7]}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc))
    (tmp_path / "cut.json").write_text(json.dumps(docs["big.json"])[:200_000])
    (tmp_path / "empty.json").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_elements(spark, str(tmp_path), TARGETS).withColumn("file", F.substring_index("file", "/", -1)).orderBy("file", "at").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in rows:
        if r.error is None:
            got.setdefault(r.file, {}).setdefault(r.target, []).append(json.loads(r.value))
    cut = got.pop("cut.json")["results"]
    assert got == {name: wanted(doc) for name, doc in docs.items() if wanted(doc)}
    assert cut == docs["big.json"]["results"][: len(cut)] and len(cut) > 1000
    assert [(r.file, r.error) for r in rows if r.error] == [("cut.json", "the document ends early")] and rows[[r.file for r in rows].index("d0.json") - 1].error
    assert Beginning().stack == []


def test_reports_of_files_equal_whole_reports(spark, tmp_path):
    """Each kind of report, read whole and in splits; a report that breaks off gives what is whole in it, and one error."""
    from siftline.sources import adapters

    rng = random.Random(12)
    n = 400
    rule = lambda i: {"check_id": f"r.{i % 9}", "path": rng.choice(["a.py", "/repo/b,c.py", "/etc/x"]), "start": {"line": i}, "end": {"line": i + 1}, "extra": {"message": f'm, "{i}" {{', "severity": "ERROR", "lines": "x", "metadata": {"cwe": ["CWE-89: x"]}}}
    dependency = lambda i: {"Target": f"l{i}.json", "Packages": [{"Identifier": {"UID": "u"}, "Locations": [{"StartLine": 3, "EndLine": 4}]}], "Vulnerabilities": [{"VulnerabilityID": f"CVE-{i}", "PkgName": "p,q", "PkgIdentifier": {"UID": "u"}, "InstalledVersion": "1", "Severity": "HIGH"}], "Secrets": [{"RuleID": "k", "Severity": "LOW", "StartLine": 2}]}
    rules = [{"id": f"q{i % 5}", "shortDescription": {"text": f"t{i}"}, "properties": {"tags": ["external/cwe/cwe-079"], "security-severity": str(i)}} for i in range(8)]
    result = lambda i: {"ruleId": f"q{i % 6}", "message": {"text": f"m,{i}"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f"f{i}.py"}, "region": {"startLine": i}}}]}
    cases = [
        (adapters.rule_findings, adapters.rule_files, {"errors": [{"path": "x"}], "results": [rule(i) for i in range(n)]}),
        (adapters.dependency_findings, adapters.dependency_files, {"SchemaVersion": 2, "Results": [dependency(i) for i in range(n)]}),
        (adapters.sarif_findings, adapters.sarif_files, {"runs": [{"tool": {"driver": {"name": "x", "rules": rules}}, "results": [result(i) for i in range(n)]}, {"results": [result(7)]}]}),
    ]
    for whole, files, doc in cases:
        text = json.dumps(doc)
        folder = tmp_path / whole.__name__
        folder.mkdir()
        (folder / "a.json").write_text(text)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
        try:
            got = files(spark, str(folder))
            keys = [c for c in got.columns if c not in ("arrival", "at", "result", "kind")]
            rows = sorted(str(r) for r in got.select(*keys).collect())
            assert rows == sorted(str(r) for r in whole(spark.createDataFrame([(text, 1)], "report string, arrival long")).select(*keys).collect()) and len(rows) >= n
            (folder / "a.json").write_text(text[: len(text) // 2])
            cut = files(spark, str(folder)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r.error for r in cut if r.error and r.error.startswith("malformed")] == ["malformed report: the document ends early"] and n // 4 < len(cut) < n + n // 4


def test_one_scan_and_parse_of_a_report(spark):
    from siftline.sources import adapters

    df = spark.createDataFrame([('{"runs": []}', 1), ("[1]", 2), ('{"a', 3), (None, 4), ('{"runs": [{"results": "odd"}]}', 5)], "report string, arrival long")
    assert sorted((r.arrival, r.error) for r in adapters.sarif_findings(df).collect()) == [(2, "malformed report"), (3, "malformed report"), (4, "malformed report")]
    text = adapters.sarif_findings(df)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LocalRelation") + text.count("LogicalRDD") == 1 and text.count("from_json") == 1


def test_the_first_pass_is_one_job(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"results": [{"a": [no, {"b": "x,]y"}]} for no in range(4000)]}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.sparkContext.setJobGroup("first-pass", "reading elements")
    try:
        rows = read_elements(spark, str(tmp_path), TARGETS)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("first-pass"))
        assert [json.loads(r.value)["a"][0] for r in rows.orderBy("at").collect()] == list(range(4000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 4  # one of each pass; a job for every split were more than twenty
