"""Parquet and JSON sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.chunks import Chunk


def file_chunks(spark: SparkSession, paths: Sequence[str], weights: Sequence[float] | None = None) -> list[Chunk]:
    """One chunk per file, weighing what is given or else its size; folders and globs are expanded.

    Sizes come from the file system Spark reads through, so remote files weigh what they are.
    """
    if weights is not None:
        if len(weights) != len(paths):
            raise ValueError(f"{len(paths)} paths but {len(weights)} weights")
        return [Chunk(f"f{i}", {"path": p}, float(w)) for i, (p, w) in enumerate(zip(paths, weights, strict=True))]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: list[tuple[str, int]] = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        system = path.getFileSystem(conf)
        for status in system.globStatus(path) or []:
            below = system.listFiles(status.getPath(), True)
            while below.hasNext():
                f = below.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    found.append((f.getPath().toString(), f.getLen()))
    return [Chunk(f"f{i}", {"path": p}, float(n)) for i, (p, n) in enumerate(found)]


def read_parquet(spark: SparkSession, paths: Sequence[str], chunks: Sequence[Chunk] = ()) -> DataFrame:
    """A lazy scan of the files; with a plan, rows carry the ``_chunk_id`` of their file's chunk."""
    df = spark.read.parquet(*paths)
    if not chunks:
        return df
    pairs = [(_bare(m.params["path"]), c.id) for c in chunks for m in (c.members or [c])]
    of = spark.createDataFrame(pairs, "__path string, _chunk_id string")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    return df.withColumn("__path", path).join(of, "__path").drop("__path")


def _bare(path: str) -> str:
    return re.sub("^file:/*", "/", path)


def read_json(spark: SparkSession, paths: Sequence[str], schema: StructType | str) -> DataFrame:
    """JSON lines, never inferred."""
    return spark.read.schema(schema).json(list(paths))


def write_parquet(df: DataFrame, path: str, cap_rows: int = 1_000_000, one_file: bool = False) -> None:
    """Parts of at most ``cap_rows`` rows; one part only where a single file is asked for."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("maxRecordsPerFile", cap_rows).parquet(path)


def write_json(df: DataFrame, path: str, cap_rows: int = 1_000_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", cap_rows).json(path)
