"""Session helpers: where intermediate tables live and how they are cut off from their lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH_CONF = "spark.checkpoint.dir"
#: Share of the driver's largest heap that may stay taken from the system after a stored frame.
HEAP_SHARE = 0.45


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where the session names none (tests, local mode) a temporary folder of this machine is taken.
    """
    root = spark.conf.get(SCRATCH_CONF, None) or spark.sparkContext.getConf().get(SCRATCH_CONF)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SCRATCH_CONF} must name a shared folder on a cluster")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set(SCRATCH_CONF, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never used twice."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there, and a lost
    executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    relieve_driver(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*frames: DataFrame | None) -> None:
    """Deletes the files of stored frames that nothing reads any more. What was made from them must be stored itself."""
    for df in frames:
        path = getattr(df, "stored_at", None) if df is not None else None
        if path:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def relieve_driver(spark: SparkSession) -> None:
    """Frees shuffles if the driver's heap has grown beyond HEAP_SHARE of its limit: many short jobs let it grow to the limit over
    what is long garbage, and only a whole collection gives memory back to the system."""
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        free_shuffles(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
