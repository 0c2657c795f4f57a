"""Tables that change: outbox, retention, tenants, the scan catalogue, evaluation runs.  Plain Parquet and JSON files:
rewrites and logs, no UPDATE.  Paths may lie in any file system that Spark reads."""

from __future__ import annotations

import json
import os
import re
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import fixed
from siftline.operators.findings import metrics
from siftline.operators.files import Files

_NAME = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")


def pending(events: DataFrame, limit: int = 100, published: DataFrame | None = None) -> DataFrame:
    """Oldest unpublished events; ``published`` is a log of event ids that supersedes published_at."""
    x = events.where("published_at IS NULL")
    if published is not None:
        x = x.join(published.select("event_id"), "event_id", "left_anti")
    return x.orderBy("created_at", "event_id").limit(limit)


def mark_published(events: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """The events with published_at set for those in ``ids`` (event_id)."""
    x = events.join(ids.select("event_id", F.lit(True).alias("_hit")).distinct(), "event_id", "left")
    return x.withColumn("published_at", F.when(F.col("_hit"), at).otherwise(F.col("published_at"))).drop("_hit")


def expired(scans: DataFrame, org_id: str, days: int, now: Column) -> DataFrame:
    """A tenant's scans that began before ``now`` less ``days``, oldest first."""
    return scans.where((F.col("org_id") == org_id) & (F.col("started_at") < now - F.make_dt_interval(F.lit(days)))).orderBy("started_at")


def purge(scans: DataFrame, org_id: str, days: int, now: Column) -> DataFrame:
    """What stays when the expired scans of a tenant go; ``purge_table`` deletes them."""
    return scans.where(~F.coalesce((F.col("org_id") == org_id) & (F.col("started_at") < now - F.make_dt_interval(F.lit(days))), F.lit(False)))


def purge_table(spark: SparkSession, path: str, org_id: str, days: int, now: Column) -> int:
    """Deletes the expired scans of a tenant from the Parquet table at ``path``; returns how many.

    Only files that hold such rows are touched: what stays of them is written to new files of the same table first, and
    then the old ones go.  A crash in between leaves some rows that stay twice (scan_id tells them), and never loses one.
    """
    table = spark.read.parquet(path)
    gone = expired(table, org_id, days, now)
    hit = gone.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).collect()  # file names, no rows
    if hit:
        purge(spark.read.schema(table.schema).parquet(*(r.file for r in hit)), org_id, days, now).write.mode("append").parquet(path)
        files = Files(spark, path)
        for r in hit:
            files.fs.delete(files.path(r.file), False)
    return sum(r.n for r in hit)


def identifier(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def tenant_view(table: DataFrame, name: str, org_id: str, column: str = "org_id") -> None:
    """A temporary view of one tenant's rows."""
    table.where(F.col(identifier(column)) == org_id).createOrReplaceTempView(identifier(name))


def recovered(scans: DataFrame) -> DataFrame:
    """The catalogue after a restart: what was queued or running has failed, and is at no step."""
    broken = F.col("status").isin("queued", "running")
    changes = {"error": F.when(broken, fixed.INTERRUPTED).otherwise(F.col("error")), "status": F.when(broken, "failed").otherwise(F.col("status"))}
    if "current_step" in scans.columns:
        changes["current_step"] = F.when(~broken, F.col("current_step"))
    return scans.withColumns(changes)


def in_flight(scans: DataFrame) -> DataFrame:
    """(in_flight): whether any scan is queued or running."""
    return scans.agg(F.coalesce(F.bool_or(F.col("status").isin("queued", "running")), F.lit(False)).alias("in_flight"))


def newest_first(scans: DataFrame) -> DataFrame:
    return scans.orderBy(F.desc("created_at"), F.desc("scan_id"))


def latest_completed(scans: DataFrame, label: str = "label") -> DataFrame:
    """Each label's newest completed scan."""
    order = Window.partitionBy(label).orderBy(F.desc("created_at"), F.desc("scan_id"))
    return scans.where("status = 'completed'").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def portfolio(scans: DataFrame, label: str = "label") -> DataFrame:
    """(repositories, raw, actionable, urgent, noise) over each label's newest completed scan, so that rescans don't count
    twice; urgent: critical and high; noise: 1 - actionable / raw, null without raw findings.  Needs raw_findings,
    actionable, critical and high."""
    x = latest_completed(scans, label)
    total = lambda *c: F.coalesce(F.sum(sum((F.coalesce(k, F.lit(0)) for k in c), F.lit(0))), F.lit(0))
    x = x.agg(F.count("*").alias("repositories"), total("raw_findings").alias("raw"), total("actionable").alias("actionable"), total("critical", "high").alias("urgent"))
    return x.withColumn("noise", noise_reduction(F.col("raw"), F.col("actionable")))


def noise_reduction(raw: Column, actionable: Column) -> Column:
    """The share of raw findings that nobody has to look at; null without any."""
    return 1.0 - F.try_divide(actionable, raw)


def noise_funnel(summary: DataFrame) -> DataFrame:
    """(stage, label, n, share) of a scan's summary (raw_findings, issues, actionable): the share is of the raw findings."""
    most = F.greatest("raw_findings", F.lit(1))
    stages = [("raw_findings", "Raw findings"), ("issues", "After dedup"), ("actionable", "Actionable")]
    return summary.select(F.inline(F.array(*(F.struct(F.lit(k).alias("stage"), F.lit(name).alias("label"), F.col(c).cast("long").alias("n"), (F.col(c) / most).alias("share")) for k, (c, name) in enumerate(stages)))))


def severity_bars(counts: Column) -> Column:
    """map(severity -> struct(n, part, height)) of a map of counts: the part of all, and the share of the largest (1 at least)."""
    n = lambda s: F.coalesce(counts[s], F.lit(0)).cast("long")
    total, most = sum((n(s) for s in fixed.SEVERITIES), F.lit(0)), F.greatest(*(n(s) for s in fixed.SEVERITIES), F.lit(1))
    return F.create_map(*(x for s in reversed(fixed.SEVERITIES) for x in (F.lit(s), F.struct(n(s).alias("n"), F.try_divide(n(s), total).alias("part"), (n(s) / most).alias("height")))))


def events(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Outbox rows of (org_id, event_type, payload as a struct or JSON text): a new event_id each, unpublished."""
    text = F.col("payload") if rows.schema["payload"].dataType.simpleString() == "string" else F.to_json("payload")
    name = F.concat(F.lit("evt_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16))
    return rows.select(name.alias("event_id"), "org_id", "event_type", text.alias("payload"), (now if now is not None else F.current_timestamp()).alias("created_at"), F.lit(None).cast("timestamp").alias("published_at"))


def enqueue(rows: DataFrame, outbox: str) -> None:
    """Appends events to the outbox table at a path; Spark's commit makes a batch whole or absent."""
    events(rows).write.mode("append").parquet(outbox)


def insert_rows(rows: DataFrame, connect, table: str, batch: int = 500, mark: str = "?") -> None:
    """Inserts rows into a table of a database: ``connect`` makes a DB-API connection on the executor that holds a partition,
    which commits once.  A task that is run again inserts again, so the table needs a key (or take ``relay`` with one)."""
    names = [identifier(c) for c in rows.columns]
    text = f"INSERT INTO {identifier(table)} ({', '.join(names)}) VALUES ({', '.join([mark] * len(names))})"

    def send(part) -> None:
        held, link = [], connect()
        try:
            cursor = link.cursor()
            for row in part:
                held.append(tuple(row))
                if len(held) == batch:
                    cursor.executemany(text, held)
                    held = []
            if held:
                cursor.executemany(text, held)
            link.commit()
        finally:
            link.close()

    rows.foreachPartition(send)


_META = "id string, label string, status string, error string, current_step string, created_at string, started_at string, finished_at string, reports array<string>, summary map<string,long>"


#: Versions of a record that stay when a newer one is written, for readers that have listed them.
KEPT_VERSIONS = 8


class ScanStore:
    """The scan catalogue: a folder for each scan with a log of its record and its reports, read as a table, changed as a whole.

    A record is never changed in place.  Version n + 1 is written beside version n (``log/<number>.json``), complete, and
    gets its name only if no other writer has taken it: then the change is made anew on what that writer left.  So a
    reader finds the old record or the new one whatever fails in between, writers in other processes lose nothing, and
    the newest version that can be read is the record.  A ``meta.json`` from before is version 0.  The file system's
    rename must refuse to replace a file (as HDFS does); local files are linked instead, since their rename does replace.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._files = Files(spark, self.folder)
        self._files.fs.mkdirs(self._path())

    def _path(self, *parts: str):
        return self._files.path(self.folder, *parts)

    def scans(self) -> DataFrame:
        """(scan_id, ...) of every scan's newest readable record; broken files are left out; what was in flight before has failed."""
        found = [p for p in (f"{self.folder}/*/log/*.json", f"{self.folder}/*/meta.json") if self._files.fs.globStatus(self._files.path(p))]
        if not found:
            return recovered(self.spark.createDataFrame([], _META)).withColumnRenamed("id", "scan_id")
        x = self.spark.read.schema(_META).option("multiLine", True).option("mode", "DROPMALFORMED").option("ignoreMissingFiles", True).json(found).select("*", "_metadata.file_name")
        version = F.coalesce(F.regexp_extract("file_name", r"^(\d+)\.json$", 1).try_cast("long"), F.lit(0))
        x = x.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*[c for c in x.columns if c not in ("id", "file_name")]), version).alias("r"))
        return recovered(x.select("id", "r.*")).withColumnRenamed("id", "scan_id")

    def versions(self, scan_id: str) -> list[int]:
        """The versions of a scan's record that there are, ascending."""
        log = self._path(scan_id, "log")
        names = [s.getPath().getName() for s in self._files.fs.listStatus(log)] if self._files.fs.exists(log) else []
        old = [0] if self._files.fs.exists(self._path(scan_id, "meta.json")) else []
        return old + sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def _newest(self, scan_id: str) -> tuple[int, dict | None]:
        """The newest version's number (-1: none) and the newest record that can be read."""
        there = self.versions(scan_id)
        for n in reversed(there):
            try:
                return there[-1], json.loads(self._text(self._named(scan_id, n)))
            except (ValueError, Py4JJavaError):  # broken, or removed since it was listed
                continue
        return (there[-1] if there else -1), None

    def _named(self, scan_id: str, version: int):
        return self._path(scan_id, "log", f"{version:012d}.json") if version else self._path(scan_id, "meta.json")

    def add(self, record: dict) -> dict:
        """Puts a record, over an older one of its id."""
        return self._put(record["id"], lambda _: record)

    def get(self, scan_id: str) -> dict | None:
        return self._newest(scan_id)[1]

    def update(self, scan_id: str, **changes) -> dict:
        """The record with changes; KeyError for an unknown scan."""

        def change(record: dict | None) -> dict:
            if record is None:
                raise KeyError(scan_id)
            return record | changes

        return self._put(scan_id, change)

    def _put(self, scan_id: str, change) -> dict:
        """``change`` of the newest record as the next version; anew while other writers are faster."""
        while True:
            version, record = self._newest(scan_id)
            record = change(record)
            temporary = self._path(scan_id, f".record-{uuid.uuid4().hex}.tmp")
            self._files.write(temporary, json.dumps(record, indent=2).encode())
            self._files.fs.mkdirs(self._path(scan_id, "log"))
            taken = self._claim(temporary, self._named(scan_id, max(1, version + 1)))
            self._files.fs.delete(temporary, False)
            if taken:
                self.compact(scan_id, KEPT_VERSIONS)
                return record

    def _claim(self, temporary, target) -> bool:
        """Gives a complete file its name, unless there is one of that name."""
        if self._files.fs.getScheme() != "file":
            return not self._files.fs.exists(target) and bool(self._files.fs.rename(temporary, target))
        try:
            os.link(temporary.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        return True

    def compact(self, scan_id: str, keep: int = 1) -> int:
        """Deletes all but the newest ``keep`` versions of a record, oldest first; returns how many went."""
        old = self.versions(scan_id)[:-keep]
        for n in old:
            self._files.fs.delete(self._named(scan_id, n), False)
        return len(old)

    def list(self) -> DataFrame:
        return newest_first(self.scans())

    def reports(self, scan_id: str) -> list[tuple[str, str, int]]:
        """(format, path, bytes) of the reports that a scan has."""
        found = ((form, self._path(scan_id, name)) for form, (name, _) in fixed.REPORTS.items())
        return [(form, p.toString(), self._files.fs.getFileStatus(p).getLen()) for form, p in found if self._files.fs.exists(p)]

    def _text(self, path) -> str:
        source = self._files.fs.open(path)
        try:
            return bytes(self._files.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()


def new_scan_id() -> str:
    return uuid.uuid4().hex[:12]


def labels(cases: dict[str, list[dict]], spark: SparkSession) -> DataFrame:
    """(case, file_path, line, cwe, vulnerable, note, label_ord) of labels by case, in their order, as a label file has them."""
    rows = [(case, x["file"], x["line"], x["cwe"], x["vulnerable"], x.get("note", "")) for case, entries in cases.items() for x in entries]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "case string, file_path string, line int, cwe string, vulnerable boolean, note string, label_ord long")


def save_run(confusion: DataFrame, unmatched: DataFrame, folder: str, name: str, at: datetime | None = None) -> str:
    """Writes an evaluation's metrics, counts and unmatched findings below ``folder``; returns the run's folder, whose name sorts by time."""
    stamp = (at or datetime.now(UTC)).strftime("%Y%m%dT%H%M%S")
    path = f"{folder.rstrip('/')}/run={stamp}-{name}"
    x = confusion if "recall" in confusion.columns else metrics(confusion)
    scored = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") + F.col("held")
    x.select(F.lit(name).alias("name"), F.lit(stamp).alias("at"), "recall", "precision", "f1", "mcc", "hold_rate", "noise_reduction", "tp", "fp", "tn", "fn", "held", scored.alias("scored")).coalesce(1).write.mode("overwrite").json(path)
    unmatched.write.mode("overwrite").json(f"{folder.rstrip('/')}/unmatched/run={stamp}-{name}")
    return path


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every saved run, with ``run`` as its key; ``scans.gate_failures`` takes the newest."""
    return spark.read.option("basePath", folder).json(f"{folder.rstrip('/')}/run=*")
