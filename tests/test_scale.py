"""Operators whose method matters at scale: components, interval joins, line indexes, folding, stores, whole reports."""

import random
import time

import pytest
from pyspark.sql import functions as F

from siftline.functions import guards
from siftline.operators import findings as ops
from siftline.operators.graph import components


def leaves(edges, nodes):
    root = list(range(nodes))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in range(nodes)}


@pytest.mark.parametrize("order", ["random", "reversed bits", "sorted"])
def test_long_paths_settle(spark, order, monkeypatch):
    n = 1024
    names = list(range(n))
    if order == "random":
        random.Random(4).shuffle(names)
    elif order == "reversed bits":
        names = [int(f"{x:010b}"[::-1], 2) for x in names]
    rounds = []
    from siftline.operators import graph

    put = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: rounds.append(name) or put(df, name))
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == dict.fromkeys(range(n), 0) and len(rounds) < 30


def test_components_equal_a_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(7, 7), (299, 299)]
    want = leaves(pairs, 300)
    rows = components(spark.createDataFrame(pairs + [(None, 3), (None, None)], "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {x: want[x] for p in pairs for x in p} and len(rows) == len({x for p in pairs for x in p})
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
    assert {(r.node, r.root) for r in components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_intervals_cover_exactly(spark):
    rng = random.Random(6)
    ranges = [(a, a + rng.randrange(200)) for a in (rng.randrange(-50, 500) for _ in range(300))] + [(5, 4), (9, 2), (None, 3), (3, None), (1, 1)]
    for r in spark.createDataFrame(ranges, "a int, b int").withColumn("i", guards.intervals(F.col("a"), F.col("b"))).collect():
        if r.a is None or r.b is None:
            assert r.i is None
            continue
        lines = [x for i in r.i for x in range(i.place << i.level, (i.place + 1) << i.level)]
        assert sorted(lines) == list(range(r.a, r.b + 1))
    wide = spark.range(1).select(F.size(guards.intervals(F.lit(1), F.lit(2**31))).alias("n"), F.size(guards.intervals(F.lit(1), F.lit(2**61))).alias("m")).first()
    assert wide.n < 64 and wide.m < 124


def test_covered_equals_brute_force(spark):
    rng = random.Random(7)
    secrets = [(f"f{rng.randrange(3)}", a := rng.randrange(1, 300), a + rng.choice([-2, 0, 1, 5, 90, 2**31 - 400]), f"k{i}", i) for i in range(60)] + [("f1", None, 3, "x", 90), (None, 1, 9, "y", 91)]
    rows = [(f"f{f}", n, f"f{f}") for f in range(4) for n in range(1, 400, 3)] + [("f0", None, "f0"), ("n", 5, None)]
    want = {}
    for key, no, path in rows:
        hit = [s for s in secrets if path and no and s[0] == path and s[1] is not None and s[1] <= no <= s[2]]
        if hit:
            first = min(hit, key=lambda s: s[4])
            want[key, no] = (first[3], first[4])
    lines = spark.createDataFrame(rows, "key string, no int, file_path string")
    got = guards.covered(lines, spark.createDataFrame(secrets, "file_path string, line_start long, line_end long, kind string, ord long"), ["key", "no"]).collect()
    assert {(r.key, r.no): (r.kind, r.by) for r in got} == want and len(got) == len(want)


def test_snippets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ops, "PLACES", 8)
    rng = random.Random(8)
    ends = ["\n", "\r\n", "\r", "\x0b", " "]
    files = {f"f{i}": "".join("".join(rng.choice("abcé世 ") for _ in range(rng.randrange(900 if i == 2 else 12))) + rng.choice(ends) for _ in range(60)) for i in range(3)} | {"empty": ""}
    keys = [(rng.choice([*files, "gone"]), a := rng.randrange(1, 70), a + rng.choice([0, 0, 1, 30]), i) for i in range(200)] * 2
    out = ops.snippets(spark.createDataFrame(keys, "file_path string, line_start int, line_end int, n int"), spark.createDataFrame(list(files.items()), "file_path string, content string")).collect()
    assert len(out) == len(keys)
    for r in out:
        all_ = files.get(r.file_path, "").splitlines()
        if r.line_start > len(all_):
            assert (r.matched, r.context, r.context_start, r.truncated) == ("", "", 1, True)
            continue
        last, start = min(r.line_end, len(all_)), max(1, r.line_start - 8)
        matched, context = "\n".join(all_[r.line_start - 1 : last]), "\n".join(all_[start - 1 : last + 8])
        assert (r.matched, r.context, r.context_start, r.truncated) == (matched[:4000], context[:8000], start, len(matched) > 4000 or len(context) > 8000)


def test_many_places_of_one_file(spark):
    text = "\n".join(f"line {i}" for i in range(200_000))
    keys = spark.range(400_000).select(F.lit("big").alias("file_path"), (1 + F.col("id") % 199_000).cast("int").alias("line_start"), (1 + F.col("id") % 199_000 + F.col("id") % 2).cast("int").alias("line_end"))
    start = time.time()
    out = ops.snippets(keys, spark.createDataFrame([("big", text)], "file_path string, content string"))
    got = out.agg(F.count("*").alias("n"), F.sum((F.col("matched").startswith(F.concat(F.lit("line "), F.col("line_start") - 1))).cast("int")).alias("good")).first()
    assert (got.n, got.good) == (400_000, 400_000) and time.time() - start < 120


# -- one file, the scan store ---------------------------------------------------------------------------------------------


def test_one_file_of_many_rows(spark, tmp_path):
    import json

    from siftline.plans import reports
    from siftline.plans.onefile import write_document

    n = 20_000
    x = spark.range(n, numPartitions=7).select((n - F.col("id")).alias("ord"), F.concat(F.lit("r"), F.col("id") % 5).alias("rule_id"), F.concat(F.lit('t"\n'), F.col("id") % 5).alias("title"), F.lit("").alias("description"), F.lit("high").alias("severity"), F.array(F.lit("CWE-89")).alias("cwe_ids"), F.lit("a.py").alias("file_path"), F.col("id").cast("int").alias("line_start"), F.col("id").cast("int").alias("line_end"), F.lit("i").alias("issue_id"))
    path = str(tmp_path / "report.sarif")
    size = reports.sarif_file(x, path)
    text = open(path).read()
    assert json.loads(text) == json.loads(reports.sarif_document(x)) and len(json.loads(text)["runs"][0]["results"]) == n and size == len(text.encode())
    reports.sarif_file(x.limit(0), path)  # over the older one
    assert json.loads(open(path).read())["runs"][0]["results"] == []
    assert [f for f in (p.name for p in tmp_path.iterdir()) if not f.endswith(".crc")] == ["report.sarif"]
    rows = spark.createDataFrame([("1", 2), (None, 1), ("0", 0)], "v string, o int")
    write_document(spark, str(tmp_path / "x.json"), ["[", (rows, ["o"]), "]"])
    assert json.loads((tmp_path / "x.json").read_text()) == [0, 1]


def test_json_file_equals_the_document(spark, tmp_path):
    import json

    from siftline.plans import reports

    place = "struct<ord:long,instance_id:string,tool:string,rule_id:string,title:string,severity:string,cwe_ids:array<string>,score:double,file_path:string,line_start:int>"
    rows = [(f"i{k}", 1, ["semgrep"], False, (k, f"n{k}", "semgrep", "r", "t", "high", ["CWE-1"], float(k % 7), "a.py", k), "") for k in range(500)]
    issues = spark.createDataFrame(rows, f"issue_id string, occurrences long, tools array<string>, confirmed_by_multiple_tools boolean, primary {place}, correlation_reason string").repartition(5)
    header = reports.Header("s", "o", "p")
    reports.json_file(header, issues, str(tmp_path / "report.json"))
    assert json.loads((tmp_path / "report.json").read_text()) == json.loads(reports.json_document(header, issues))


def test_store_survives_a_stop_at_any_file_operation(spark, tmp_path, monkeypatch):
    from siftline.operators import storage

    class Stop(Exception):
        pass

    for stop in range(12):
        store = storage.ScanStore(spark, str(tmp_path / f"s{stop}"))
        store.add({"id": "a", "status": "queued", "label": "x"})
        seen = 0

        def counted(do):
            def run(*args, **more):
                nonlocal seen
                seen += 1
                if seen > stop:
                    raise Stop
                return do(*args, **more)

            return run

        with monkeypatch.context() as m:
            m.setattr(store._files, "write", counted(store._files.write))
            m.setattr(store, "_claim", counted(store._claim))
            m.setattr(store, "compact", counted(store.compact))
            m.setattr(store, "_named", counted(store._named))
            m.setattr(store, "versions", counted(store.versions))
            try:
                store.update("a", status="completed")
                done = True
            except Stop:
                done = False
        fresh = storage.ScanStore(spark, str(tmp_path / f"s{stop}"))
        status = fresh.get("a")["status"]
        assert status == "completed" if done else status in ("queued", "completed")
        assert fresh.update("a", label="y")["status"] == status and fresh.scans().count() == 1
    assert done


def test_two_writers_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from siftline.operators import storage

    stores = [storage.ScanStore(spark, str(tmp_path / "scans")) for _ in range(2)]
    stores[0].add({"id": "a", "status": "running"})
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: [stores[k].update("a", **{f"w{k}_{i}": i}) for i in range(15)], range(2)))
    record = stores[1].get("a")
    assert all(record[f"w{k}_{i}"] == i for k in range(2) for i in range(15)) and stores[0].versions("a")[-1] == 31
    assert stores[0].compact("a") == storage.KEPT_VERSIONS - 1 and stores[0].get("a") == record


def test_purge_deletes_and_counts(spark, tmp_path):
    from siftline.operators import storage

    path = str(tmp_path / "scans")
    rows = spark.range(100).select(F.concat(F.lit("s"), "id").alias("scan_id"), F.when(F.col("id") % 2 == 0, "o1").otherwise("o2").alias("org_id"), F.expr("timestamp'2024-01-31 00:00:00' - make_dt_interval(CAST(id AS INT))").alias("started_at"))
    rows.repartitionByRange(5, "scan_id").write.parquet(path)
    now = F.expr("timestamp'2024-02-01 00:00:00'")
    want = {r.scan_id for r in storage.purge(rows, "o1", 30, now).collect()}
    assert storage.purge_table(spark, path, "o1", 30, now) == 100 - len(want) > 0
    assert sorted(r.scan_id for r in spark.read.parquet(path).collect()) == sorted(want)
    assert storage.purge_table(spark, path, "o1", 30, now) == 0


# -- folding --------------------------------------------------------------------------------------------------------------


def test_folding_equals_the_unicode_data(spark):
    import unicodedata

    from siftline.functions.folding import nfkd

    bare = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    rng = random.Random(13)
    odd = [c for c in points if bare(c) != c]
    texts = ["".join(points[i : i + 512]) for i in range(0, len(points), 512)]
    texts += ["".join(rng.choice([rng.choice(points), rng.choice(odd), "a", "\n", "ẹ́"]) for _ in range(rng.randrange(30))) for _ in range(2000)] + ["", "plain", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", nfkd(F.col("t")).alias("n"))
    assert {r.i: r.n for r in out.collect()} == {i: None if t is None else bare(t) for i, t in enumerate(texts)}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_the_directive_scan(spark):
    from siftline import catalogue

    plan = catalogue.QUERIES["injection_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_evaluation_by_a_callable(spark):
    rows = [("c1", "a.py", 2, 2, "i1", 1, "CWE-89"), ("c1", "a.py", 3, 3, "i2", 2, "CWE-89"), ("c2", "a.py", 2, 2, "i3", 3, "CWE-79"), ("c2", "gone.py", 1, 1, "i4", 4, "CWE-79"), ("c2", "b.py", 1, 1, "i5", 5, "CWE-79")]
    x = spark.createDataFrame(rows, "case string, file_path string, line_start int, line_end int, instance_id string, ord long, cwe string").withColumns({"cwe_ids": F.array("cwe"), "rule_id": F.lit("r"), "title": F.lit(None).cast("string")})
    files = spark.createDataFrame([("c1", "a.py", "one\nbad(x)\nfine(x)"), ("c2", "a.py", "one\nfine(y)"), ("c2", "b.py", "held")], "case string, file_path string, content string")

    def judge(finding, snippet):
        assert finding["title"] is None and finding["case"] in ("c1", "c2")
        if snippet is None:
            return "needs_human"
        return None if snippet["matched"] == "held" else "true_positive" if "bad" in snippet["matched"] else "false_positive"

    verdicts = ops.judged(x, judge, files)
    assert {r.instance_id: r.verdict for r in verdicts.collect()} == {"i1": "true_positive", "i2": "false_positive", "i3": "false_positive", "i4": "needs_human", "i5": None}
    from siftline.operators import storage

    labels = storage.labels({"c1": [{"file": "a.py", "line": 2, "cwe": "CWE-89", "vulnerable": True}], "c2": [{"file": "a.py", "line": 2, "cwe": "CWE-79", "vulnerable": False}, {"file": "b.py", "line": 1, "cwe": "CWE-79", "vulnerable": True}]}, spark)
    row = ops.evaluate(x, labels, verdicts)[0].first()
    assert row.tp >= 1 and row.tn == 1 and row.held == 1
    assert {r.verdict for r in ops.judged(x, lambda finding, snippet: str(snippet)).collect()} == {"None"}
