"""Tables between the jobs of an operator, in the folder that the whole cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and the session is local (tests) a folder of this process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        where = "file://" + os.path.join(tempfile.gettempdir(), f"llm-{os.getpid()}")
    return where


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage ends here and lost executors cost nothing."""
    at = f"{shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` whole texts for this session, unless it has a size of its own: a task holds a
    batch several times over, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)
