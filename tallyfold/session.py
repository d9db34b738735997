"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings; all of them may be set on a session that already runs.
RUNTIME_CONF = {
    # Dates are kept as written, so nothing may shift with the machine's zone.
    "spark.sql.session.timeZone": "UTC",
    # windows-1254 is refused by the decoder unless the JVM's own charsets are allowed.
    "spark.sql.legacy.javaCharsets": "true",
    # Long chains of text patterns make methods the JVM will not compile; beyond its limit of 8000 bytes
    # separate, compiled steps are faster than one fused, interpreted one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows that go to Python tasks are held on both sides of the pipe: they go in small batches, whatever their length.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyfold")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: the cluster's ``spark.checkpoint.dir``.

    Only where the setting is absent (a local test) is a temporary folder made; on a cluster that
    would be a machine-local path, so it is refused there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder, read back.

    Unlike a checkpoint it has the sizes of what was written, so the planner sees that facts are small before it moves the
    rows they are joined with, and columns that a step does not need are not read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables between the steps of one job. Each is dropped when no later step reads it, so the disk holds a few of them at a time."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._paths: dict[str, str] = {}

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = self._paths[label] = scratch_path(self._spark, label)
        df.write.option("compression", "zstd").parquet(path)
        # Spark removes the shuffles of a finished step once the driver's collector has found them unused; left to itself it may not run for many steps.
        self._spark._jvm.System.gc()
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Remove these tables, all if none is named."""
        for label in labels or list(self._paths):
            path = self._spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(label))
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Needed where a non-deterministic column (a row number taken from the physical order) is used
    twice: both uses must see the same rows, also after an executor was lost.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
