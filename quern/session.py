"""Sessions and the shared folder in which lineage is cut."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from quern.errors import ConfigError


def get_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session without that setting on one machine (tests) gets a folder of its own; on a cluster its lack is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if (own := sc.getCheckpointDir()) is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quern-"))
        own = sc.getCheckpointDir()
    return own.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern-{os.getpid()}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The table outlives any executor, and each later reader takes only the columns it needs.
    """
    return written(df, new_path(df.sparkSession, name), partition_by)


def written(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables for as long as one job needs them: written to the shared folder, and deleted at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(path := new_path(self.spark, name))
        return written(df, path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names early."""
        gone = [p for p in self.paths if p.rpartition("/")[2].rpartition("-")[0] in names]
        for path in gone:
            remove(self.spark, path)
            self.paths.remove(path)

    def __enter__(self) -> Scratch:
        return self

    def close(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths.clear()

    def __exit__(self, *_) -> None:
        self.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the cluster's own file system client."""
    jvm, sc = spark._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan needs any more; Spark removes them when the driver's garbage is collected."""
    for _ in range(2):  # what the first round finds, the second lets go of
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def spread(df: DataFrame) -> DataFrame:
    """Split a table that arrives in fewer partitions than there are cores.

    A table of one small file would otherwise pass through a single Python worker. Larger
    tables already have more splits than cores and are returned as they are, so that no text
    is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def unused(df: DataFrame, n: int) -> list[str]:
    """``n`` names that no column of ``df`` has, in upper or lower case."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if (name := f"_quern{k}") not in taken:
            out.append(name)
        k += 1
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for a session, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    fd, path = tempfile.mkstemp(prefix="quern-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "quern")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)  # the driver serves it from there
    sc._quern_shipped = True


def clean(spark: SparkSession) -> None:
    """Remove the intermediate tables that this process wrote to the shared folder. No result that still reads them may be in use."""
    remove(spark, f"{shared_dir(spark)}/quern-{os.getpid()}")
