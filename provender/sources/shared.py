"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; a temporary one only in local mode, where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[.*)?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/{spark.sparkContext.applicationId}"


def computed(df: DataFrame) -> DataFrame:
    """df with its columns computed once for each row: a condition on one of them isn't rewritten as one on what it is made
    from, which would parse a record anew for each field that the condition looks at."""
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over all cores, twice as many tasks: for rows that are quick to read and slow to work on, as a few
    megabytes, or a file that can't be split, are one task's otherwise. What is worked out of a row, and conditions on that, stay after it."""
    return computed(df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism))


def dealt(df: DataFrame, rows: int, *columns: str, each: int = 250_000) -> DataFrame:
    """df with so many rows dealt by columns, about ``each`` to a part: a part is as large however many rows there are. Spark goes by
    bytes as they are packed, of which narrow rows take so few that a task sorts millions of them."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *columns)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: planned and computed once, and a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Remove what ``kept`` has written for a table, which can't be read any more then; other files stay."""
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    own = re.sub(r"^file:/+", "/", shared_folder(spark)) + "/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.sub(r"^file:/+", "/", folder).startswith(own):
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
