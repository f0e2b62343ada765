"""The folder that driver and executors share, and tables written there between steps."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder, made once and set
    for the application; on a cluster, where executors would not see it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-spindle-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get()
    return found.rstrip("/")


def local_path(folder: str) -> str:
    """The path of a folder that driver and executors mount, for code that opens files by themselves. A folder in a
    store that only Spark reads is refused."""
    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        return folder
    if scheme != "file":
        raise ValueError(f"{folder} is in a store that only Spark reads; a folder that driver and executors mount is needed")
    return "/" + rest.lstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="spark-spindle-")) / "spindle_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(to))
    _shipped.add(context.applicationId)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    written = spark._jvm.org.apache.hadoop.fs.Path(path)
    return written.getFileSystem(spark._jsc.hadoopConfiguration()), written


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _located(spark, path)
    return system.exists(place)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete what was written there when the driver ends."""
    system, written = _located(spark, path)
    system.deleteOnExit(written)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back. It cuts the lineage, fixes
    generated row ids and spares recomputation; a lost executor loses nothing of it."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    drop_at_exit(df.sparkSession, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


#: Bytes up to which spread() deals a table out anew.
SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table may be one part of one file, which a single task would read: its rows are dealt over
    all cores. One of more than SMALL bytes, by the plan's own estimate, has parts enough and stays."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


#: Tasks for each core, and bytes of a task, that a scan of small files is gathered to.
WAVES, GATHERED = 4, 16 << 20


def gathered(files: DataFrame) -> DataFrame:
    """A scan of files. Spark deals some 32 small ones to a task, and a task, with the file that it writes, costs more than
    reading these: so tasks are joined to WAVES for each core, or to GATHERED bytes each where that makes more."""
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return files.coalesce(max(WAVES * files.sparkSession.sparkContext.defaultParallelism, -(-size // GATHERED)))


def discard(*staged: DataFrame) -> None:
    """Delete tables of stage() that nothing will read any more."""
    for df in staged:
        system, written = _located(df.sparkSession, df._staged_at)
        system.delete(written, True)
