"""Shared helpers of the training-data operators.

* ``materialise`` cuts lineage by writing Parquet below ``spark.checkpoint.dir`` (shared by all executors), so a lost
  executor only costs the tasks that were running on it; ``dropped`` removes such a table once no later one needs it.
* ``Texts`` exposes an Arrow string column as one flat UTF-8 buffer with offsets, so numpy works on bytes and no Python
  string is made per row.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy operators work on at once (one longer document is a block of its own).
BLOCK_BYTES = 1 << 18
#: Settings of a write by ``materialise``: bytes to an Arrow batch, so that neither long texts nor whole sets pile up in
#: the JVM and in Python at once; shuffle files go when the write ends.
WRITE = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Further settings of a ``shuffled`` write.  A broadcast join holds its table on the driver, and each runs there in a thread
#: of its own, of which Spark keeps up to 128 with their stacks and native memory.
SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
#: The clones of each session that ``writer`` made, and the settings that they have.
_writers: weakref.WeakKeyDictionary[SparkSession, dict[bool, tuple[JavaObject, dict[str, str]]]] = weakref.WeakKeyDictionary()
#: The class of a word byte: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one is set only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def writer(spark: SparkSession, shuffled: bool = False) -> JavaObject:
    """The session that ``materialise`` writes in: a clone of ``spark``, with the settings that it has now and ``WRITE``.

    A clone is made once for each session, not for each write: the driver keeps those that its idle threads ran for.
    """
    clones, now = _writers.setdefault(spark, {}), dict(spark.conf.getAll)
    own, was = clones.get(shuffled) or (spark._jsparkSession.cloneSession(), now)
    then = now | WRITE | (SHUFFLED if shuffled else {})
    for key in was.keys() - then.keys():
        own.conf().unset(key)
    for key, value in then.items() - was.items():
        own.conf().set(key, value)
    clones[shuffled] = own, then
    return own


def materialise(df: DataFrame, name: str, shuffled: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back with its own schema.

    The write runs in a clone of the session (``writer``), so that its settings reach no other query of the session.
    ``shuffled``: no join gathers a side on the driver to broadcast it (``SHUFFLED``); for joins whose keys spread.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frames = getattr(spark.sparkContext._jvm.org.apache.spark.sql.classic, "Dataset$").__getattr__("MODULE$")
    frames.ofRows(writer(spark, shuffled), df._jdf.queryExecution().analyzed()).write().parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that ``materialise`` wrote: only after all that reads them has been written itself."""
    for x in tables:
        if path := getattr(x, "_written_to", None):
            where = x.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(x.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function whose worker gives its free memory back to the system when a task ends; workers outlive tasks."""

    def trim(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return trim


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unused(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of a whole row: all columns, and which of them are null."""
    plain = lambda f: F.to_json(F.struct(f"`{f.name}`")) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f"`{f.name}`")
    return F.xxhash64(*map(plain, docs.schema), *(F.col(f"`{c}`").isNull() for c in docs.columns))


def buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))


class Texts:
    """A string column as ``data`` (uint8) and ``offsets`` (int64, one more than rows); nulls are empty."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string() if not pa.types.is_binary(column.type) else pa.large_binary())
        _, offsets, data = column.buffers()
        n, at = len(column), column.offset
        self.valid = ~np.asarray(column.is_null()) if n else np.zeros(0, bool)
        self.offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        if n and not self.valid.all():  # a null slot may hold any bytes
            lengths = np.where(self.valid, np.diff(self.offsets), 0)
            if (lengths != np.diff(self.offsets)).any():
                column = column.fill_null("")
                _, offsets, data = column.buffers()
                self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
                self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def blocks(self, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
        """Ranges of rows of about ``limit`` bytes each."""
        first, n = 0, len(self)
        while first < n:
            last = int(np.searchsorted(self.offsets, self.offsets[first] + limit, side="right")) - 1
            last = min(n, max(first + 1, last))
            yield first, last
            first = last
