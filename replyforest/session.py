"""Session helpers: the shared folder and tables staged in it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Only ids and small facts are shuffled, a tenth or so of the input; and map outputs are
# tracked per partition, so that their number must not grow without end.
INPUT_PER_PARTITION = 1024**3
MOST_PARTITIONS = 20_000
LOCAL_FOLDER = "/tmp/checkpoints"  # of a local session that names no folder
SMALL_ROWS = 200_000  # narrow rows that may be broadcast, or sorted in one task, once they were counted


def build_session(app_name: str = "replyforest", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; ``conf`` overrides them.

    Partition counts are left to adaptive execution: it coalesces small shuffles
    and splits skewed ones.  ``forceOptimizeSkewedJoin`` lets it split a hot key
    even where that costs one more shuffle further down.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def grow_shuffles(spark: SparkSession, *paths: str, most: int = MOST_PARTITIONS) -> int:
    """Raises the number of shuffle partitions to the size of the input files.

    Adaptive execution can merge partitions but not make more of them, so a number that
    fits a small table would leave huge partitions of a large one.  It is never lowered.
    Inputs of more than ``most`` GB get larger partitions; raise it where the driver has the memory to track more.
    """
    sizes = spark.read.format("binaryFile").load(list(paths)).agg(F.sum("length")).first()[0] or 0
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(max(current, -(-sizes // INPUT_PER_PARTITION)), most)
    if wanted > current:
        spark.conf.set("spark.sql.shuffle.partitions", wanted)
    return max(wanted, current)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    A local session without the setting, as in a trial, uses ``LOCAL_FOLDER``.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return LOCAL_FOLDER


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application below the shared one."""
    return f"{shared_dir(spark)}/replyforest/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new path for this application."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


# Spark has no public call to look at or delete a path; these handles are those of a classic session.
def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def mark(spark: SparkSession) -> str:
    """An empty folder that shows whether what was staged around it is still there."""
    path = scratch_path(spark, "mark")
    files, folder = _folder(spark, path)
    files.mkdirs(folder)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this application wrote."""
    files, folder = _folder(spark, path)
    files.delete(folder, True)


@contextmanager
def passing_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for steps between two tables, deleted at the end."""
    folder = scratch_path(spark, name)
    try:
        yield folder
    finally:
        remove(spark, folder)


def stage(df: DataFrame, name: str = "table", partition_by: str | None = None, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage without losing it to an executor, keeps column pruning and
    gives adaptive execution real sizes.
    """
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_and_count(
    df: DataFrame, name: str, condition: Column | None = None, partition_by: str | None = None, folder: str | None = None
) -> tuple[DataFrame, int]:
    """As ``stage``, with the number of rows that meet ``condition``, counted while they are written."""
    seen = Observation()
    counted = F.count(F.lit(1) if condition is None else F.when(condition, F.lit(1)))
    staged = stage(df.observe(seen, counted.alias("rows")), name, partition_by, folder)
    rows = seen.get.get("rows")
    if rows is None:
        rows = (staged if condition is None else staged.where(condition)).count()
    return staged, rows


def small_side(df: DataFrame) -> DataFrame:
    """Narrow join side of keys, broadcast when it was counted to be small.

    A larger one is left to a shuffled join.
    """
    staged, rows = stage_and_count(df, "side")
    return F.broadcast(staged) if rows <= SMALL_ROWS else staged
