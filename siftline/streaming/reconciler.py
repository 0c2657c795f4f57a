"""Reconciliation of scans as they arrive, late findings included: the statuses of every scan against the scan before it.

Two stateful streams, each a log of changes that is never rewritten:

1. by issue: the state has, for each scan that the issue was found in, its least place, its signatures with their least
   places, and the signature of its last place.  Findings that arrive, in whatever order, change which scans the issue
   persists in, is fresh in or is gone in; what changed is given as facts that begin (+1) or end (-1) to hold.
2. by content signature: the state has, for each scan, the fresh and the gone issues of that signature.  Its changes are
   the renames that begin or end to hold: the first fresh issue and the last gone one.

Issues and signatures are dealt into BUCKETS by a hash, and a bucket's state is one value for each scan, so the calls of the
state store, of which each costs as much as many findings, grow with the buckets at most.  A bucket's state is touched only
for the scans around those that arrived.  ``statuses`` sums the logs up.  State is kept in
RocksDB beside the checkpoints, so a restart goes on where the last batch ended, and a batch that is run again gives the
same files.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FINDING = "scan long, ord long, issue_id string, content_signature string"
FACT = "kind string, scan long, issue_id string, signature string, ord long, delta int"
RENAME = "scan long, issue_id string, previous_id string, delta int"
#: Buckets of issues, and of signatures: each is read and written as a whole, at some ten milliseconds a call.
BUCKETS = 256
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def facts(issue: str, scan: int, found: dict[int, dict], first: int) -> set[tuple]:
    """What holds of an issue in ``scan``, by what was ``found`` in it and in the scan before."""
    now, before = found.get(scan), found.get(scan - 1)
    if now and before:
        return {("persisting", scan, issue, None, None)}
    if now:
        signed = {("fresh_signature", scan, issue, s, n) for s, n in now["signatures"].items()} if scan > first else set()
        return {("fresh", scan, issue, None, None)} | signed
    return {("gone", scan, issue, before["last"][1], before["ord"])} if before else set()


class ByBucket(StatefulProcessor):
    """State by scan: a JSON object of what is known of each issue, or signature, of the bucket."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scans = handle.getMapState("scans", "scan long", "known string")

    def known(self, scan: int) -> dict:
        return json.loads(self.scans.getValue((scan,))[0]) if self.scans.containsKey((scan,)) else {}

    def keep(self, scan: int, known: dict) -> None:
        self.scans.updateValue((scan,), (json.dumps(known, separators=(",", ":")),))

    def close(self) -> None:
        pass


class ByIssue(ByBucket):
    def __init__(self, first: int):
        self.first = first

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, dict[int, list]] = {}
        for part in rows:
            for scan, ord_, issue, signature in zip(part["scan"], part["ord"], part["issue_id"], part["content_signature"]):
                new.setdefault(issue, {}).setdefault(int(scan), []).append((int(ord_), signature if isinstance(signature, str) else None))
        arrived = {s for scans in new.values() for s in scans}
        state = {s: self.known(s) for s in sorted({s + d for s in arrived for d in (-1, 0, 1)})}
        out = []
        for issue, scans in new.items():
            found = {s: state[s][issue] for a in scans for s in (a - 1, a, a + 1) if issue in state[s]}
            touched = sorted({s + d for s in scans for d in (0, 1)})
            before = {s: facts(issue, s, found, self.first) for s in touched}
            for scan, places in scans.items():
                own = found[scan] = state[scan].setdefault(issue, {"ord": places[0][0], "last": [-1, None], "signatures": {}})
                own["ord"] = min(own["ord"], *(n for n, _ in places))
                for n, signature in places:
                    if signature is not None:
                        own["signatures"][signature] = min(n, own["signatures"].get(signature, n))
                        own["last"] = max(own["last"], [n, signature], key=lambda x: x[0])
            for s in touched:
                after = facts(issue, s, found, self.first)
                out += [(*x, 1) for x in after - before[s]] + [(*x, -1) for x in before[s] - after]
        for scan in arrived:
            self.keep(scan, state[scan])
        yield pd.DataFrame(out, columns=["kind", "scan", "issue_id", "signature", "ord", "delta"]).astype({"ord": "Int64"})


class BySignature(ByBucket):
    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes: dict[int, dict[str, Counter]] = {}
        for part in rows:
            for kind, scan, issue, signature, ord_, delta in zip(part["kind"], part["scan"], part["issue_id"], part["signature"], part["ord"], part["delta"]):
                changes.setdefault(int(scan), {}).setdefault(signature, Counter())[kind, int(ord_), issue] += int(delta)
        out = []
        for scan, signatures in changes.items():
            state = self.known(scan)
            for signature, own in signatures.items():
                sides = {kind: {tuple(x) for x in found} for kind, found in state.get(signature, {"gone": [], "fresh_signature": []}).items()}
                before = self._pair(sides)
                for (kind, ord_, issue), delta in own.items():  # what began and ended since changes nothing
                    if delta < 0:
                        sides[kind].remove((ord_, issue))
                    elif delta > 0:
                        sides[kind].add((ord_, issue))
                state[signature] = {kind: sorted(found) for kind, found in sides.items()}
                if (after := self._pair(sides)) != before:
                    out += [(scan, *pair, sign) for pair, sign in ((before, -1), (after, 1)) if pair]
            self.keep(scan, state)
        yield pd.DataFrame(out, columns=["scan", "issue_id", "previous_id", "delta"])

    @staticmethod
    def _pair(sides: dict) -> tuple[str, str] | None:
        fresh, gone = sides["fresh_signature"], sides["gone"]
        return (min(fresh)[1], max(gone)[1]) if fresh and gone else None


def _dealt(rows: DataFrame, column: str, buckets: int) -> GroupedData:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(column), F.lit(buckets))).groupBy("bucket")


def _run(spark: SparkSession, changes: DataFrame, folder: str, name: str) -> None:
    """Runs a stream over what has arrived, to its log of files; the state store's kind is set for this query alone."""
    old = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        query = changes.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/checkpoint-{name}").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, old) if old else spark.conf.unset(_STORE)
    query.awaitTermination()


def advance(findings: DataFrame, folder: str, first: int = 0, buckets: int = BUCKETS) -> None:
    """Takes in what has arrived on ``findings``, a stream of (scan, ord, issue_id, content_signature), below ``folder``.

    Scans are numbered without gaps from ``first``; ``ord`` is a finding's place in its scan.  Findings without a scan, a
    place or an issue are left out; repeated ones change nothing.  ``buckets`` must be
    the same for every call on a folder: more of them make smaller values of the state.  Returns when all that has arrived is in the logs.
    """
    spark = findings.sparkSession
    rows = findings.where("scan IS NOT NULL AND ord IS NOT NULL AND issue_id IS NOT NULL").selectExpr("CAST(scan AS BIGINT) scan", "CAST(ord AS BIGINT) ord", "issue_id", "content_signature")
    _run(spark, _dealt(rows, "issue_id", buckets).transformWithStateInPandas(ByIssue(first), FACT, "Append", "None"), folder, "facts")
    signed = spark.readStream.schema(FACT).parquet(f"{folder}/facts").where("signature IS NOT NULL")
    _run(spark, _dealt(signed, "signature", buckets).transformWithStateInPandas(BySignature(), RENAME, "Append", "None"), folder, "renames")


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    """(scan, issue_id, status, previous_id) of every scan so far: new, persisting, renamed or fixed, as ``reconcile`` has them."""
    log = lambda name, schema, *keys: spark.read.schema(schema).parquet(f"{folder}/{name}").groupBy(*keys).agg(F.sum("delta").alias("n")).where("n > 0").drop("n")
    held = log("facts", FACT, "kind", "scan", "issue_id").where("kind <> 'fresh_signature'")
    last = held.where("kind <> 'gone'").agg(F.max("scan").alias("newest"))
    held = held.join(F.broadcast(last), F.col("scan") <= F.col("newest")).drop("newest")  # one row
    renames = log("renames", RENAME, "scan", "issue_id", "previous_id").groupBy("scan", "issue_id").agg(F.min("previous_id").alias("previous_id"))
    went = renames.select("scan", F.col("previous_id").alias("issue_id"), F.lit(True).alias("moved")).distinct()
    fresh = held.where("kind = 'fresh'").join(renames, ["scan", "issue_id"], "left").select("scan", "issue_id", F.when(F.col("previous_id").isNotNull(), "renamed").otherwise("new").alias("status"), "previous_id")
    gone = held.where("kind = 'gone'").join(went, ["scan", "issue_id"], "left_anti").select("scan", "issue_id", F.lit("fixed").alias("status"), F.lit(None).cast("string").alias("previous_id"))
    kept = held.where("kind = 'persisting'").select("scan", "issue_id", F.lit("persisting").alias("status"), F.lit(None).cast("string").alias("previous_id"))
    return kept.unionByName(fresh).unionByName(gone)
