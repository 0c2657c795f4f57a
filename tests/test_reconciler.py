"""The stateful reconciliation equals ``reconcile`` over all scans so far, after every batch."""

import random

from pyspark.sql import functions as F

from siftline.operators.findings import reconcile
from siftline.streaming import reconciler


def wanted(spark, rows):
    out = set()
    for scan in range(max(r[0] for r in rows) + 1):
        part = lambda s: spark.createDataFrame([r[1:] for r in rows if r[0] == s], "ord long, issue_id string, content_signature string")
        if any(r[0] == scan for r in rows):
            out |= {(scan, r.issue_id, r.status, r.previous_id) for r in reconcile(part(scan), part(scan - 1) if scan else None).collect()}
    return out


def test_state_equals_reconcile_after_every_batch(spark, tmp_path):
    rng = random.Random(14)
    every = []
    for scan in range(4):
        ids = rng.sample("abcdefghijkl", 7)
        rows = [(scan, 0, i, rng.choice(["s1", "s2", "s3", "s4", None])) for i in ids for _ in range(rng.choice([1, 1, 2]))]
        rng.shuffle(rows)
        every += [(s, n, i, g) for n, (s, _, i, g) in enumerate(rows)]
    late = [r for r in every if r[1] in (1, 4) and r[0] > 0]  # arrive in the last batches; some issues are reopened by them
    batches = [[r for r in every if r[0] == s and r not in late] for s in range(4)] + [late[::2], late[1::2] + late[:1]]
    so_far = []
    for rows in batches:
        so_far += rows
        spark.createDataFrame(rows, reconciler.FINDING).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(reconciler.FINDING).parquet(str(tmp_path / "in"))
        reconciler.advance(stream, str(tmp_path / "out"))  # a new query each time: a restart
        got = [tuple(r) for r in reconciler.statuses(spark, str(tmp_path / "out")).collect()]
        assert set(got) == wanted(spark, so_far) and len(got) == len(set(got))
    assert {s for _, _, s, _ in got} == {"new", "persisting", "renamed", "fixed"}
    spark.createDataFrame([(None, 1, "x", "y"), (0, 1, None, "y"), (0, None, "x", None)], reconciler.FINDING).write.mode("append").parquet(str(tmp_path / "in"))
    reconciler.advance(spark.readStream.schema(reconciler.FINDING).parquet(str(tmp_path / "in")), str(tmp_path / "out"))
    assert set(got) == {tuple(r) for r in reconciler.statuses(spark, str(tmp_path / "out")).collect()}
    assert F is not None


def test_state_is_called_by_bucket_and_not_by_issue(spark, tmp_path):
    rows = [(scan, n, f"i{n + 150 * scan}", f"s{n % 200}") for scan in (0, 1) for n in range(300)]
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, reconciler.FINDING).write.mode("append").parquet(str(tmp_path / "in"))
        reconciler.advance(spark.readStream.schema(reconciler.FINDING).parquet(str(tmp_path / "in")), str(tmp_path / "out"), buckets=3)
    got = [tuple(r) for r in reconciler.statuses(spark, str(tmp_path / "out")).collect()]
    assert set(got) == wanted(spark, rows) and len(got) == len(set(got))
    state = spark.read.format("statestore").option("stateVarName", "scans").load(str(tmp_path / "out" / "checkpoint-facts"))
    assert state.count() <= 3 * 2  # a value for each bucket and scan
