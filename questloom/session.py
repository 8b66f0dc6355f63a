"""Session settings used by the bench and the tests.

A cluster brings its own session; nothing in the library creates one.
"""

from __future__ import annotations

import atexit
import functools
import itertools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "16g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("questloom")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder, made once; a cluster gets an
    error, since executors cannot read one another's local disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="questloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_numbers = itertools.count()


@functools.cache
def _own_folder(spark: SparkSession, app: str) -> str:
    """A folder of this application in the shared one, removed when the driver ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/tables-{app}-{uuid.uuid4().hex[:8]}"

    def remove() -> None:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass

    atexit.register(remove)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_own_folder(spark, spark.sparkContext.applicationId)}/{next(_numbers):04d}-{name}"


def kept(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and a recovery point."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
