"""Session, table and staging helpers shared by all operators."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(cpus: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter owns the configuration."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillmesh")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Workers live on from stage to stage: memory that arrays leave goes back to the system.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows of text may be long: unless the session says otherwise, Arrow batches hold this many.
BATCH_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the same place as the driver does; bound their batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set(key, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan one parquet table; naming the columns keeps the read schema narrow."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def rounded(column: Column | str, digits: int) -> Column:
    """A double rounded half up as SQL does it: once times the power of ten, in binary. F.round() reads the decimal digits, so ties differ."""
    return F.round((F.col(column) if isinstance(column, str) else column) * 10**digits) / 10**digits


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and the master is local (tests, a laptop) is a local folder made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stage(frame: DataFrame, label: str, **options) -> DataFrame:
    """Write a frame as Parquet to the shared folder, with the writer's options, and read it back: cuts lineage, survives lost executors.

    The files are removed when the driver's JVM ends.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    frame.write.options(**options).parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(frame.schema).parquet(path)


def unstage(frame: DataFrame) -> None:
    """Delete the files behind a staged frame once no later plan reads them. Of any other frame nothing is deleted."""
    spark = frame.sparkSession
    own = re.sub(r"^[a-z0-9]*:?/*", "/", f"{shared_dir(spark)}/staged/")
    for name in {os.path.dirname(f) for f in frame.inputFiles()}:
        if own in name:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(name)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def numbered(frame: DataFrame, label: str, *order, rows: int = 50_000) -> DataFrame:
    """frame, staged, with `_number`, from 0 in the order of the columns: sorted by ranges, no range over about `rows` rows of unlike keys.

    Ranges are drawn from a sample, so what each holds is written before its rows are counted.
    """
    ranges = max(1, -(-frame.count() // rows))
    found = stage(frame.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), label)
    before = (
        found.groupBy("_range").agg(F.count("*").alias("n"))
        .select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    )  # fmt: skip  a row a range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return found.withColumn("_own", own).join(before, "_range").withColumn("_number", F.col("_before") + F.col("_own") - 1).drop("_range", "_own", "_before")


def in_tasks(frame: DataFrame, key: str, rows: int) -> DataFrame:
    """A frame of costly rows dealt by a key of many values to tasks of about `rows` rows each, however few splits hold it."""
    return frame.repartition(max(1, -(-frame.count() // rows)), key)
