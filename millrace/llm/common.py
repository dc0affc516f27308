"""Shared plumbing of the training-data operators.

* ``workdir`` / ``materialize`` cut lineage by writing Parquet under the folder that
  ``spark.checkpoint.dir`` names, which every executor of a cluster shares.
* ``documents`` narrows an input to the columns an operator uses, so extra columns
  (clashing names included) never reach a join.
* ``fold`` is the learn/hold-out rule of the labelled operators.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: texts may hold 100 kB each and numpy some tens of bytes for each of theirs, so batches stay small.
ARROW_ROWS = "256"
_scratch: set[str] = set()


def workdir(spark: SparkSession) -> str:
    """The shared folder of this session; a private one only where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is removed when the driver ends."""
    path = f"{workdir(spark)}/millrace-{spark.sparkContext.applicationId}"
    if path not in _scratch:
        _scratch.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already, and with it the way to the folder
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the copy survives lost executors.

    ``scratch`` of the result is its folder, for ``discard``.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark drop shuffle files that nothing refers to any more
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*written: DataFrame | None) -> None:
    """Remove what ``materialize`` wrote, once nothing that is still to run reads it."""
    for df in written:
        if df is not None:
            _remove(df.sparkSession, df.scratch)


def arrow_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), and whichever of ``more`` the caller asks for."""
    arrow_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in more])


def fold(modulus: int) -> Column:
    """crc32 of the decimal text of ``doc_id``, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_fraction(bound: int, rows: int) -> float:
    return 1.0 if rows <= bound else bound / rows


def hashed_below(column: Column, fraction: Column | float) -> Column:
    """A fixed pseudo-random subset of rows: the hash of the key lies below the fraction."""
    unit = F.pmod(F.xxhash64(column, F.lit("millrace-sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return unit < (F.lit(fraction) if isinstance(fraction, float) else fraction)
