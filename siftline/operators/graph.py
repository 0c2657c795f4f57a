"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a temporary one is set only on a local master where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` cut from its lineage: written below the shared folder and read back.

    The write runs in a clone of the session, in which shuffle files go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    own = spark._jsparkSession.cloneSession()
    own.conf().set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    frames = getattr(spark.sparkContext._jvm.org.apache.spark.sql.classic, "Dataset$").__getattr__("MODULE$")
    frames.ofRows(own, df._jdf.queryExecution().analyzed()).write().parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` made, once nothing reads them any more."""
    for x in tables:
        if path := getattr(x, "_written_to", None):
            where = x.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(x.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) reaches; null ends link nothing.

    Edges point from the larger node to the smaller.  A round has two steps: of every node, first the larger neighbours
    and then the smaller ones are hooked to the least node around it, which keeps components and brings their least node
    nearer; it ends when every component is a star.  Each step is one aggregate and one join, and a path of n nodes, in
    whatever order, takes about log2(n) rounds.  Runs jobs, written below the checkpoint folder, when it is called.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "links")
    while True:
        around = now.unionByName(now.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = around.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("m"))
        least = least.select("node", F.least("node", "m").alias("m"))
        hooked = around.where("low > high").join(least, F.col("high") == F.col("node")).select(F.col("low").alias("high"), F.col("m").alias("low")).distinct()
        lowest = hooked.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("m"))
        rest = hooked.join(lowest, F.col("high") == F.col("node")).where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        then = written(rest.unionByName(lowest.select(F.col("node").alias("high"), F.col("m").alias("low"))).distinct(), "links")
        discard(now)
        now = then
        # stars: no node is the larger end of two edges, or of one while it is the smaller end of another
        ends = now.select(F.explode(F.array(F.struct(F.col("high").alias("x"), F.lit(1).alias("up")), F.struct(F.col("low").alias("x"), F.lit(0).alias("up")))).alias("e"))
        if not ends.groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least")).where("ups > 1 OR (ups = 1 AND least = 0)").limit(1).count():
            break
    roots = now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    out = now.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(roots)
    out = out.unionByName(loops.join(out.select(F.col("node").alias("n")), F.col("node") == F.col("n"), "left_anti"))
    out._written_to = now._written_to
    return out
