"""What the operators share: row keys, scratch tables in the shared folder, batch helpers."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_count = itertools.count()
_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``, removed when the driver ends.

    Where the setting is missing, a local session gets a temporary folder and a cluster an
    error: executors cannot read one another's local disks.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="questloom-")
        _roots[app] = f"{named.rstrip('/')}/llm-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a recovery point, computed once."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{next(_count):04d}-{name}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*cols: str) -> list[Column]:
    """Two 64-bit hashes that stand for a row's named columns, nulls included.

    Equal rows share a key, so an operator that joins by it treats repeated rows alike.
    """
    parts = [c for n in cols for c in (F.col(n).isNull(), F.col(n))]
    return [F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit(1), *parts).alias("_k2")]


def unclashed(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def small_batches(
    batches: Iterator[pa.RecordBatch], rows: int = 512
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that what a task unpacks at once stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def with_columns(batch: pa.RecordBatch, **cols: pa.Array) -> pa.RecordBatch:
    """The batch with further columns."""
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *cols.values()], names=[*batch.schema.names, *cols]
    )
