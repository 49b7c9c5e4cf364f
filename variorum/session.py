"""Session and staging helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "variorum") -> SparkSession:
    """A session for tests and the bench. On a cluster the submitter makes the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach. Only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if folder:
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-variorum-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back.

    Cuts the lineage, so a lost executor costs a read and not a second run of the work above, and
    gives the optimiser real sizes. Use it where one costly result feeds several branches. Shuffle files
    of the write are of no more use after it and go at once.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    _staged(spark).append(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._variorum_path = path
    return read


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh shared folder for files of a job's own; ``clear_staged`` removes it."""
    path = fresh_folder(spark, name)
    _staged(spark).append(path)
    return path


def unstage(*tables: DataFrame) -> None:
    """Remove tables that ``stage`` returned and nothing will read again."""
    for table in tables:
        spark, place = table.sparkSession, table._variorum_path
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _staged(spark).remove(place)


def _staged(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_variorum_staged"):
        context._variorum_staged = []
    return context._variorum_staged


def clear_staged(spark: SparkSession) -> None:
    """Remove what ``stage`` has written in this session. Results are lazy over it: write or count them first."""
    paths = _staged(spark)
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that may have a row a document or page: not to be broadcast.

    What files take tells little of what rows take: 1.5 million rows of 8 bytes in a file of 2 MB are 79 MB on the
    driver, and a broadcast is planned by the file.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores is spread once; a large one already is and stays."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for the few jobs that run Python there."""
    import shutil
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_variorum_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-variorum-zip-", dir="/tmp")) / "variorum"
    archive = shutil.make_archive(str(target), "zip", root_dir=root.parent, base_dir=root.name)
    context.addPyFile(archive)
    context._variorum_shipped = True
