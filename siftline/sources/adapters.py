"""Scanner reports to finding rows: rule-scanner JSON, dependency-scanner JSON, SARIF.

Each takes a table (report: string, arrival: long) of whole reports and returns finding rows in report order, with
``error`` set where a required field is missing or a path is unsafe (``strict`` raises instead).  A report that is no
whole JSON object gives one row, which has only ``arrival`` and ``error``.  A report is scanned and parsed once.  The
``..._files`` functions read reports of any size from files: split over tasks, the readable rows of a broken report, then
one row with its error; ``arrival`` is the file there, and ``at`` rises in a file's order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import scalar as S
from siftline.operators.graph import written
from siftline.sources.json_parts import read_elements

RULE_RESULT = "struct<check_id string, path string, start struct<line int>, end struct<line int>, extra struct<message string, severity string, lines string, metadata struct<cwe string, confidence string, owasp string, references string>>>"
RULES = f"results array<{RULE_RESULT}>, errors array<struct<rule_id string, path string, message string>>"
DEPENDENCY_RESULT = "struct<Target string, Packages array<struct<Identifier struct<UID string>, Locations array<struct<StartLine int, EndLine int>>>>, Vulnerabilities array<struct<VulnerabilityID string, PkgName string, PkgIdentifier struct<UID string>, InstalledVersion string, FixedVersion string, Severity string, CweIDs array<string>, Title string, Description string, VendorIDs string, References string, PrimaryURL string>>, Secrets array<struct<RuleID string, Category string, Severity string, Title string, StartLine int, EndLine int>>>"
DEPENDENCIES = f"Results array<{DEPENDENCY_RESULT}>"
SARIF_RULE = "struct<id string, shortDescription struct<text string>, defaultConfiguration struct<level string>, properties struct<tags array<string>, precision string, `security-severity` string>>"
SARIF_RESULT = "struct<ruleId string, message struct<text string>, locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int, endLine int>>>>>"
SARIF = f"runs array<struct<tool struct<driver struct<name string, rules array<{SARIF_RULE}>>>, results array<{SARIF_RESULT}>>>"

_EMPTY = "CAST(array() AS array<string>)"


def _either(a: Column, b: Column | str) -> Column:
    return F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(F.lit(b) if isinstance(b, str) else b)


def _line(x: Column, other: Column | int) -> Column:
    other = F.lit(other) if isinstance(other, int) else other
    return F.when(F.coalesce(x, F.lit(0)) == 0, other).otherwise(x)


def _finish(x: DataFrame, columns: dict[str, Column], required: dict[str, Column], order: list[str], strict: bool) -> DataFrame:
    """The rows' ``columns`` and errors; a row with ``fault`` (its report is broken) has only ``arrival`` and the error."""
    missing = F.filter(F.array(*(F.when(v.isNull(), F.lit(k)) for k, v in required.items())), lambda k: k.isNotNull())
    fault = F.col("fault").isNotNull()
    error = F.when(fault, F.col("fault")).when(F.size(missing) > 0, F.concat(F.lit("missing or invalid: "), F.array_join(missing, ", ")))
    out = x.select("arrival", *(F.when(~fault, F.col(k)).alias(k) for k in order), *(F.when(~fault, v).alias(k) for k, v in columns.items()), error.alias("error"), fault.alias("_whole"))
    if strict:
        said = F.when(F.col("_whole"), F.concat("error", F.lit(" "), F.col("arrival").cast("string"))).otherwise(F.concat(F.lit("result at index "), F.col("at").cast("string"), F.lit(": "), "error"))
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(said)))
    return out.drop("_whole")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _exploded(reports: DataFrame, schema: str, element: str, elements: Callable[[Column], Column]) -> DataFrame:
    """(arrival, at, e, fault): the elements of each report, or one row without any and a fault.  One scan, one parse.

    Fields of an unexpected kind are null, as the parser leaves them; only then is the text looked at again, whether it is
    a JSON object at all.
    """
    read = F.from_json("report", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    text = F.col("report")

    def rows(p: Column) -> Column:
        whole = F.coalesce(S.strip(text).startswith("{") & (p["_bad"].isNull() | F.try_parse_json(text).isNotNull()), F.lit(False))
        broken = F.array(F.struct(F.lit(None).cast(element).alias("e"), F.lit("malformed report").alias("fault")))
        return F.when(whole, F.transform(elements(p), lambda e: F.struct(e.alias("e"), F.lit(None).cast("string").alias("fault")))).otherwise(broken)

    return reports.select("arrival", F.posexplode(_once(read, rows)).alias("at", "_e")).select("arrival", "at", "_e.e", "_e.fault")


def _parts(spark: SparkSession, paths: str | list[str], target: str, element: str) -> DataFrame:
    """The same of files: (arrival, at, e, fault) with a file's name as arrival."""
    x = read_elements(spark, paths, {"e": target})
    return x.select(F.col("file").alias("arrival"), "at", F.from_json("value", element).alias("e"), F.when(F.col("error").isNotNull(), F.concat(F.lit("malformed report: "), "error")).alias("fault"))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


PACKAGE, SECRET = "struct<name:string,installed_version:string,fixed_version:string,is_direct:boolean>", "struct<kind:string,last_four:string>"


def rule_findings(reports: DataFrame, root: str = "/", version: str = "unknown", tool: str = "semgrep", strict: bool = False) -> DataFrame:
    """A rule that looks for secrets makes a critical secret finding, which keeps four characters and no raw fields."""
    return _rule_rows(_exploded(reports, RULES, RULE_RESULT, lambda p: p["results"]), root, version, tool, strict)


def rule_files(spark: SparkSession, paths: str | list[str], root: str = "/", version: str = "unknown", tool: str = "semgrep", strict: bool = False) -> DataFrame:
    return _rule_rows(_parts(spark, paths, "results[]", RULE_RESULT), root, version, tool, strict)


def _rule_rows(x: DataFrame, root: str, version: str, tool: str, strict: bool) -> DataFrame:
    r = F.col("e")
    raw_path = r["path"]
    prefix = root.rstrip("/") + "/"
    path = F.when(raw_path.startswith("/"), F.when(raw_path.startswith(prefix), F.substr(raw_path, F.lit(len(prefix) + 1)))).otherwise(raw_path)
    start = F.greatest(_line(r["start"]["line"], 1), F.lit(1))
    secret = S.is_secret_rule(r["check_id"])
    meta = r["extra"]["metadata"]
    entries = F.coalesce(F.from_json(meta["cwe"], "array<string>"), F.array(meta["cwe"]))
    entries = F.when(meta["cwe"].startswith("["), entries).when(meta["cwe"].isNotNull(), F.array(meta["cwe"])).otherwise(F.expr(_EMPTY))
    message = S.strip(F.coalesce(r["extra"]["message"], F.lit("")))
    raw = F.when(~secret, F.to_json(F.struct(meta["owasp"].alias("owasp"), meta["references"].alias("references"), meta["confidence"].alias("confidence"), r["extra"]["severity"].alias("severity")))).otherwise("{}")
    columns = {
        "tool": F.lit(tool), "tool_version": F.lit(version), "rule_id": r["check_id"], "domain": F.when(secret, "secret").otherwise("sast"), "title": S.title_of_rule(r["check_id"]),
        "description": message, "severity": F.when(secret, "critical").otherwise(S.rule_severity(r["extra"]["severity"], meta["confidence"])), "cwe_ids": S.prose_cwes(entries), "cve_id": _null("string"),
        "file_path": path, "line_start": start, "line_end": F.greatest(_line(r["end"]["line"], start), start), "package": _null(PACKAGE),
        "secret": F.when(secret, F.struct(r["check_id"].alias("kind"), S.last_four(F.coalesce(r["extra"]["lines"], F.lit(""))).alias("last_four"))), "raw": raw,
    }
    return _finish(x, columns, {"check_id": r["check_id"], "path": path}, ["at"], strict)


def rule_errors(reports: DataFrame, shown: int = 3) -> DataFrame:
    """Per report: failed rules (distinct), errors without a rule, and the first names with the number of the rest."""
    x = reports.select("arrival", F.explode(F.from_json("report", RULES)["errors"]).alias("e"))
    x = x.groupBy("arrival").agg(F.array_sort(F.collect_set("e.rule_id")).alias("rules"), F.count_if(F.col("e.rule_id").isNull()).alias("file_errors"))
    rest = F.size("rules") - shown
    names = F.concat(F.array_join(F.slice("rules", 1, shown), ", "), F.when(rest > 0, F.concat(F.lit(", +"), rest.cast("string"), F.lit(" more"))).otherwise(""))
    return x.select("arrival", F.size("rules").alias("failed_rules"), "file_errors", names.alias("names"))


def dependency_findings(reports: DataFrame, version: str = "unknown", tool: str = "trivy", strict: bool = False) -> DataFrame:
    """Vulnerabilities before secrets within a result; a vulnerability's lines are those of the last package of its UID.

    What is parsed is written once, since packages, vulnerabilities and secrets are read from it; the job runs when this is called.
    """
    return _dependency_rows(_exploded(reports, DEPENDENCIES, DEPENDENCY_RESULT, lambda p: p["Results"]), version, tool, strict)


def dependency_files(spark: SparkSession, paths: str | list[str], version: str = "unknown", tool: str = "trivy", strict: bool = False) -> DataFrame:
    """As ``dependency_findings``, of files; one result is a row, so a lock file's packages are in one task."""
    return _dependency_rows(_parts(spark, paths, "Results[]", DEPENDENCY_RESULT), version, tool, strict)


def _dependency_rows(x: DataFrame, version: str, tool: str, strict: bool) -> DataFrame:
    x = written(x.select("arrival", F.col("at").alias("result"), F.col("e").alias("r"), "fault"), "dependencies")
    path = S.relative_path(F.col("r.Target"))
    v = F.col("v")
    # the last of a result's packages of one UID that has a location wins; a join, so large reports stay linear
    packages = x.select("arrival", "result", F.posexplode("r.Packages").alias("no", "p")).where(F.col("p.Identifier.UID").isNotNull() & (F.size("p.Locations") > 0))
    places = packages.groupBy("arrival", "result", F.col("p.Identifier.UID").alias("uid")).agg(F.max_by(F.get("p.Locations", 0), "no").alias("place"))
    vulns = x.select("arrival", "result", path.alias("path"), F.lit(None).cast("string").alias("fault"), F.posexplode("r.Vulnerabilities").alias("at", "v")).withColumn("uid", F.col("v.PkgIdentifier.UID")).join(places, ["arrival", "result", "uid"], "left")
    start, end = F.coalesce("place.StartLine", F.lit(1)), F.coalesce("place.EndLine", F.lit(1))
    text = lambda c: S.strip(F.coalesce(c, F.lit("")))
    columns = {
        "tool": F.lit(tool), "tool_version": F.lit(version), "rule_id": v["VulnerabilityID"], "domain": F.lit("sca"), "title": _either(v["Title"], v["VulnerabilityID"]), "description": text(v["Description"]),
        "severity": S.named_severity(v["Severity"]), "cwe_ids": F.coalesce(S.clean_cwes(v["CweIDs"]), F.expr(_EMPTY)), "cve_id": F.when(v["VulnerabilityID"].startswith("CVE-"), v["VulnerabilityID"]),
        "file_path": F.col("path"), "line_start": F.greatest(start, F.lit(1)), "line_end": F.greatest(end, start, F.lit(1)),
        "package": F.struct(v["PkgName"].alias("name"), v["InstalledVersion"].alias("installed_version"), F.nullif(v["FixedVersion"], F.lit("")).alias("fixed_version"), _null("boolean").alias("is_direct")),
        "secret": _null(SECRET), "raw": F.to_json(F.struct(v["VendorIDs"].alias("vendor_ids"), v["References"].alias("references"), v["PrimaryURL"].alias("primary_url"))),
    }
    order = ["result", "kind", "at"]
    first = _finish(vulns.withColumn("kind", F.lit(0)), columns, {"Target": F.col("path"), "VulnerabilityID": v["VulnerabilityID"], "PkgName": v["PkgName"], "InstalledVersion": v["InstalledVersion"]}, order, strict)
    s = F.col("s")
    none = F.array(F.lit(None).cast(x.schema["r"].dataType["Secrets"].dataType.elementType))
    found = x.select("arrival", "result", "fault", path.alias("path"), F.posexplode(F.when(F.col("fault").isNotNull(), none).otherwise(F.col("r.Secrets"))).alias("at", "s")).withColumn("kind", F.lit(1))
    begin = _line(s["StartLine"], 1)
    columns |= {
        "rule_id": s["RuleID"], "domain": F.lit("secret"), "title": _either(s["Title"], s["RuleID"]), "description": F.concat(F.coalesce(s["Category"], F.lit("secret")), F.lit(" detected by the scanner")),
        "severity": S.named_severity(s["Severity"]), "cwe_ids": F.expr(_EMPTY), "cve_id": _null("string"), "line_start": F.greatest(begin, F.lit(1)), "line_end": F.greatest(_line(s["EndLine"], begin), begin, F.lit(1)),
        "package": _null(PACKAGE), "secret": F.struct(s["RuleID"].alias("kind"), F.lit("").alias("last_four")), "raw": F.lit("{}"),
    }
    return first.unionByName(_finish(found, columns, {"Target": F.col("path"), "RuleID": s["RuleID"]}, order, strict))


def sarif_findings(reports: DataFrame, version: str = "unknown", tool: str = "codeql", strict: bool = False) -> DataFrame:
    """The first run and each result's first location; an unknown rule gives medium severity and its id as title."""
    pair = f"struct<r {SARIF_RESULT}, rule {SARIF_RULE}>"

    def with_rules(p: Column) -> Column:
        """A run's results, each with the last rule of its id: the rules stay in the row that is exploded."""
        run = F.get(p["runs"], F.lit(0))
        rules = F.filter(F.coalesce(run["tool"]["driver"]["rules"], F.array().cast(f"array<{SARIF_RULE}>")), lambda q: q["id"].isNotNull())
        last = lambda q, i: ~F.array_contains(F.transform(F.slice(rules, i + 2, F.greatest(F.size(rules), F.lit(1))), lambda o: o["id"]), q["id"])
        by = F.map_from_entries(F.transform(F.filter(rules, last), lambda q: F.struct(q["id"], q)))
        return _once(by, lambda known: F.transform(run["results"], lambda r: F.struct(r.alias("r"), F.try_element_at(known, r["ruleId"]).alias("rule"))))

    x = _exploded(reports, SARIF, pair, with_rules).select("arrival", "at", "fault", F.col("e.r").alias("r"), F.col("e.rule").alias("rule"))
    return _sarif_rows(x, version, tool, strict)


def sarif_files(spark: SparkSession, paths: str | list[str], version: str = "unknown", tool: str = "codeql", strict: bool = False) -> DataFrame:
    """As ``sarif_findings``, of files; results meet their rules by (file, id)."""
    x = read_elements(spark, paths, {"results": "runs[0].results[]", "rules": "runs[0].tool.driver.rules[]"})
    rules = x.where("target = 'rules'").select("file", "at", F.from_json("value", SARIF_RULE).alias("q")).where("q.id IS NOT NULL")
    rules = rules.groupBy(F.concat("file").alias("of"), F.col("q.id").alias("id")).agg(F.max_by("q", "at").alias("rule"))
    fault = F.when(F.col("error").isNotNull(), F.concat(F.lit("malformed report: "), "error"))
    found = x.where("target = 'results' OR error IS NOT NULL").select(F.col("file").alias("arrival"), "at", F.from_json("value", SARIF_RESULT).alias("r"), fault.alias("fault"))
    found = found.join(rules, (F.col("arrival") == F.col("of")) & (F.col("r.ruleId") == F.col("id")), "left").select("arrival", "at", "fault", "r", "rule")
    return _sarif_rows(found, version, tool, strict)


def _sarif_rows(x: DataFrame, version: str, tool: str, strict: bool) -> DataFrame:
    r, rule = F.col("r"), F.col("rule")
    place = F.get(r["locations"], 0)["physicalLocation"]
    path = S.relative_path(F.nullif(place["artifactLocation"]["uri"], F.lit("")))
    start = _line(place["region"]["startLine"], 1)
    props = rule["properties"]
    columns = {
        "tool": F.lit(tool), "tool_version": F.lit(version), "rule_id": r["ruleId"], "domain": F.lit("sast"), "title": _either(rule["shortDescription"]["text"], r["ruleId"]), "description": S.strip(F.coalesce(r["message"]["text"], F.lit(""))),
        "severity": S.scored_severity(props["security-severity"], rule["defaultConfiguration"]["level"]), "cwe_ids": F.coalesce(S.tag_cwes(props["tags"]), F.expr(_EMPTY)), "cve_id": _null("string"), "file_path": path,
        "line_start": F.greatest(start, F.lit(1)), "line_end": F.greatest(_line(place["region"]["endLine"], start), start, F.lit(1)), "package": _null(PACKAGE), "secret": _null(SECRET),
        "raw": F.to_json(F.struct(props["precision"].alias("precision"), props["security-severity"].alias("security_severity"))),
    }
    return _finish(x, columns, {"ruleId": r["ruleId"], "uri": path}, ["at"], strict)


#: Adapters by the scanner's name; ``register`` adds others.
REGISTRY: dict[str, Callable[..., DataFrame]] = {"semgrep": rule_findings, "trivy": dependency_findings, "codeql": sarif_findings}


def register(name: str, adapter: Callable[..., DataFrame]) -> None:
    REGISTRY[name] = adapter


def chosen(languages: list[str] | None) -> list[str]:
    """Names of the scanners for a profile: SARIF analysis only where a language has an extractor, or without a profile."""
    from siftline.functions.fixed import EXTRACTOR

    return ["semgrep", "trivy", *(["codeql"] if languages is None or any(x in EXTRACTOR for x in languages) else [])]
