"""Scalar functions on columns: identities, severities, weaknesses, paths, risk.  All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import fixed

ID_LENGTH, SEPARATOR = 32, "\x1f"


def lookup(table: dict, key: Column) -> Column:
    """table[key], null for an unknown key."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def digest(*parts: Column | str) -> Column:
    """First 32 hex digits of SHA-256 over the parts joined by a unit separator; null parts count as empty."""
    columns = [F.coalesce(F.lit(p) if isinstance(p, str) else p, F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *columns), 256), 1, ID_LENGTH)


def strip(text: Column) -> Column:
    """Without white space at either end, line ends and the information separators included."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def round2(x: Column) -> Column:
    """Rounded to two places by the double's exact value, ties to the even digit; for magnitudes below 2**20.

    Away from the middle between two hundredths the nearest one is plain.  Near it the double is split into two parts
    whose products by 25 are exact, so its distance from the middle has the right sign; that rare part is a lambda,
    which keeps the generated code small enough to be compiled.
    """
    size = F.abs(x) * 100.0
    plain = F.floor(size + 0.5) / 100.0
    clear = F.abs(size - F.floor(size) - 0.5) > 1e-6
    near = F.when(clear, plain).otherwise(F.get(F.transform(F.array(F.abs(x)), _near_half), F.lit(0)))
    return F.when(x < 0, -near).otherwise(near)


def _near_half(size: Column) -> Column:
    high = F.floor(size * 1048576.0) / 1048576.0
    low, k = (size - high) * 25.0, F.floor(size * 100.0 + 0.5)
    past = lambda odd: (high * 25.0 - odd / 8.0) + low
    below, above, odd = past(2 * k - 1), past(2 * k + 1), k % 2 == 1
    return F.when((below < 0) | ((below == 0) & odd), k - 1).when((above > 0) | ((above == 0) & odd), k + 1).otherwise(k) / 100.0


def utf8_prefix(text: Column, size: int) -> Column:
    """The first ``size`` bytes of a text in UTF-8, without a character that they cut in two."""
    head = F.hex(F.substring(F.encode(text, "UTF-8"), 1, size))
    return F.decode(F.unhex(F.regexp_replace(head, "(?:F[0-7](?:[89AB].){0,2}|E.(?:[89AB].)?|[CD].)$", "")), "UTF-8")


_STRING = r"""(?s)("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""


def normalize_snippet(code: Column) -> Column:
    """Code without comments and layout: strings kept, white space collapsed, none around brackets, commas, semicolons.

    The text between strings is split off and joined by a marker, so a comment may span what was a string; strings that
    a comment holds go with it.
    """
    strings = F.regexp_extract_all(code, F.lit(_STRING), F.lit(1))
    pieces = F.split(code, _STRING, -1)
    marked = F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("\x00"), (i - 1).cast("string"), F.lit("\x00"), x))), "")
    for pattern in (r"//[^\n]*", r"#[^\n]*", r"(?s)/\*.*?\*/", r"(?s)<!--.*?-->"):
        marked = F.regexp_replace(marked, pattern, " ")
    marked = F.regexp_replace(F.regexp_replace(marked, r"(?U)\s+", " "), r"^ | $", "")
    marked = F.regexp_replace(marked, r"(?U)\s*([(){}\[\];,])\s*", "$1")
    numbered = F.arrays_zip(strings.alias("s"), F.sequence(F.lit(0), F.size(strings) - 1).alias("i"))
    restored = F.aggregate(numbered, marked, lambda acc, x: F.replace(acc, F.concat(F.lit("\x00"), x["i"].cast("string"), F.lit("\x00")), x["s"]))
    return F.when(F.size(strings) > 0, restored).otherwise(marked)


def snippet_hash(code: Column) -> Column:
    return digest(normalize_snippet(code))


def instance_id(tool: Column, rule: Column, path: Column, line: Column, snippet: Column) -> Column:
    anchor = F.when(F.coalesce(snippet, F.lit("")) != "", snippet_hash(snippet)).otherwise(F.concat(F.lit("line:"), line.cast("string")))
    return digest("instance", tool, rule, path, anchor)


def issue_id(domain: Column, path: Column, cwes: Column, rule: Column, package: Column, cve: Column, kind: Column, last_four: Column) -> Column:
    first = F.when(F.size(cwes) > 0, F.get(cwes, 0)).otherwise(F.concat(F.lit("rule:"), rule))
    by_package = digest("issue", "sca", package, F.coalesce(F.nullif(cve, F.lit("")), rule))
    by_secret = digest("issue", "secret", path, kind, last_four)
    return F.when((domain == "sca") & package.isNotNull(), by_package).when((domain == "secret") & kind.isNotNull(), by_secret).otherwise(digest("issue", domain, path, first))


def content_signature(tool: Column, rule: Column, snippet: Column) -> Column:
    """Null without a snippet."""
    return F.when(F.coalesce(snippet, F.lit("")) != "", digest("content", tool, rule, normalize_snippet(snippet)))


def cache_key(instance: Column, prompt: Column, model: Column) -> Column:
    return digest(instance, prompt, model)


def severity_rank(severity: Column) -> Column:
    return lookup({s: i for i, s in enumerate(fixed.SEVERITIES)}, severity)


def rule_severity(severity: Column, confidence: Column) -> Column:
    given = lambda x, other: F.when(F.coalesce(x, F.lit("")) == "", F.lit(other)).otherwise(F.upper(x))
    return F.coalesce(lookup(fixed.RULE_SEVERITY, F.concat_ws(" ", given(severity, ""), given(confidence, "MEDIUM"))), F.lit("low"))


def named_severity(name: Column) -> Column:
    return F.coalesce(lookup(fixed.NAMED_SEVERITY, F.upper(F.coalesce(name, F.lit("")))), F.lit("info"))


def scored_severity(score: Column, level: Column) -> Column:
    x = score.try_cast("double")
    by_score = F.when(x >= 9, "critical").when(x >= 7, "high").when(x >= 4, "medium").when(x > 0, "low").otherwise("info")
    return F.when(x.isNotNull(), by_score).otherwise(F.coalesce(lookup(fixed.LEVEL_SEVERITY, F.lower(F.coalesce(level, F.lit("")))), F.lit("medium")))


def by_number(cwes: Column) -> Column:
    """Distinct weakness ids in the order of their numbers."""
    keyed = F.transform(F.array_distinct(cwes), lambda c: F.struct(F.substring(c, 5, 20).cast("long").alias("n"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def _matches(texts: Column, pattern: str) -> Column:
    return F.filter(F.transform(texts, lambda t: F.regexp_extract(t, pattern, 1)), lambda n: n != "")


def prose_cwes(texts: Column) -> Column:
    """From prose such as "CWE-89: ...": the first id of each entry, leading zeros kept."""
    return by_number(F.transform(_matches(texts, r"(?U)\bCWE-(\d+)\b"), lambda n: F.concat(F.lit("CWE-"), n)))


def tag_cwes(tags: Column) -> Column:
    """From tags such as external/cwe/cwe-089, leading zeros dropped."""
    return by_number(F.transform(_matches(tags, r"(?i)external/cwe/cwe-(\d+)"), lambda n: F.concat(F.lit("CWE-"), n.cast("long").cast("string"))))


def clean_cwes(ids: Column) -> Column:
    """Well-formed ids, in their order."""
    return F.filter(ids, lambda c: c.rlike(r"^CWE-\d+$"))


def family(cwes: Column) -> Column:
    """Each id and its direct ancestors."""
    table = F.create_map(*(x for k, v in fixed.CWE_ANCESTORS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.array_union(cwes, F.flatten(F.filter(F.transform(cwes, lambda c: F.element_at(table, c)), lambda x: x.isNotNull())))


def related(a: Column, b: Column) -> Column:
    """Some id of one side equals, or is an ancestor of, an id of the other (siblings are not related)."""
    return F.coalesce(F.arrays_overlap(a, family(b)) | F.arrays_overlap(b, family(a)), F.lit(False))


def title_of_rule(rule: Column) -> Column:
    words = F.trim(F.translate(F.element_at(F.split(rule, r"\."), -1), "-_", "  "))
    return F.when(words == "", rule).otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substr(words, F.lit(2)))))


def is_secret_rule(rule: Column) -> Column:
    low = F.lower(rule)
    out = F.lit(False)
    for marker in fixed.SECRET_RULE_MARKERS:
        out = out | low.contains(marker)
    return out


def last_four(text: Column) -> Column:
    return F.right(F.regexp_replace(text, r"(?U)\s", ""), F.lit(4))


def relative_path(path: Column) -> Column:
    """With forward slashes; null where absolute or with a parent part."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(~p.startswith("/") & ~F.array_contains(F.split(p, "/"), ".."), p)


def path_role(path: Column) -> Column:
    low = F.lower(path)
    under = lambda names: low.rlike("(?:^|/)(?:" + "|".join(map(re.escape, names)) + ")/")
    name = F.substring_index(low, "/", -1)
    return F.when(under(fixed.TEST_DIRS) | name.rlike(fixed.TEST_FILE), "test").when(under(fixed.EXAMPLE_DIRS), "example").when(under(fixed.TOOLING_DIRS), "tooling").otherwise("production")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def report_level(severity: Column) -> Column:
    return F.coalesce(lookup(fixed.REPORT_LEVEL, severity), F.lit("warning"))


def language_of(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return lookup(fixed.LANGUAGE, F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def repository_url(url: Column) -> Column:
    """struct(host, owner, name, ref), null where the URL isn't https on a known host with well-formed parts."""
    clean = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(clean, r"^https://([^/?#]+)", 1)), r"^www\.", "")
    path = F.regexp_extract(clean, r"^https://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    owner, name = F.get(parts, 0), F.regexp_replace(F.get(parts, 1), r"\.git$", "")
    ref = F.when((F.size(parts) >= 4) & (F.get(parts, 2) == "tree"), F.array_join(F.slice(parts, F.lit(4), F.size(parts)), "/"))
    ok = host.isin(*fixed.HOSTS) & owner.rlike(fixed.SEGMENT) & name.rlike(fixed.SEGMENT) & (ref.isNull() | (ref.rlike(fixed.REF) & ~ref.contains("..")))
    return F.when(ok, F.struct(host.alias("host"), owner.alias("owner"), name.alias("name"), ref.alias("ref")))


def clone_url(repo: Column) -> Column:
    return F.concat(F.lit("https://"), repo["host"], F.lit("/"), repo["owner"], F.lit("/"), repo["name"], F.lit(".git"))


def repository_name(repo: Column) -> Column:
    """owner/name, with @ref where there is one."""
    return F.concat(repo["owner"], F.lit("/"), repo["name"], F.coalesce(F.concat(F.lit("@"), repo["ref"]), F.lit("")))


def tool_version(output: Column, key: str | None = None) -> Column:
    """The version in a tool's output: a key of its JSON, else the whole output; ``unknown`` for nothing."""
    whole = F.coalesce(F.nullif(strip(output), F.lit("")), F.lit("unknown"))
    if key is None:
        return whole
    inside = F.coalesce(F.nullif(F.get_json_object(output, f"$.{key}"), F.lit("")), F.lit("unknown"))
    return F.when(F.try_parse_json(output).isNotNull() & strip(output).startswith("{"), inside).otherwise(whole)


def ruleset_hash(rules: Column) -> Column:
    return F.substring(F.sha2(F.array_join(rules, "\n"), 256), 1, 16)


def archive_format(head: Column) -> Column:
    """zip, tar or null, by the leading bytes (binary) of a file."""
    starts = lambda *marks: F.hex(head).rlike("^(?:" + "|".join(marks) + ")")
    return F.when(starts("504B0304", "504B0506", "504B0708"), "zip").when(starts("1F8B", "425A68", "FD377A585A00", "28B52FFD") | (F.substring(head, 258, 5) == F.lit(b"ustar")), "tar")


def unsafe_member(name: Column) -> Column:
    """Why a member's path can't be extracted, or null."""
    p = F.replace(name, F.lit("\\"), F.lit("/"))
    return F.when(name.isNull() | (name == ""), "empty").when(name.contains("\x00"), "nul").when(F.length(name) > 4096, "too long").when(p.startswith("/"), "absolute").when(p.rlike(r"^[A-Za-z]:"), "drive letter").when(F.array_contains(F.split(p, "/"), ".."), "escape")


def looks_binary(content: Column) -> Column:
    return content.isNull() | F.hex(F.substring(content, 1, 8192)).rlike("^(?:..)*00")


# -- risk -------------------------------------------------------------------------------------------------------------


def blend(factor: Column, confidence: Column, pull: float = fixed.CONFIDENCE_PULL) -> Column:
    weight = confidence + (F.lit(1.0) - confidence) * F.lit(1.0 - pull)
    return factor * weight + F.lit(1.0) * (F.lit(1.0) - weight)


def fix_availability(package: Column, fixed_version: Column) -> Column:
    return F.when(package.isNull(), 0.5).when(F.coalesce(fixed_version, F.lit("")) != "", 1.0).otherwise(0.0)


def dependency_depth(package: Column, direct: Column) -> Column:
    return F.when(package.isNull() | direct.isNull(), 0.5).when(direct, 1.0).otherwise(0.25)
