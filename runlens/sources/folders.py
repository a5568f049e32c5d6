"""Tables that several uses share: written once to the folder that the cluster shares, read by each."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares, or in a temporary one where none is named, in local sessions only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='spark-stream-')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows as a table in the shared folder: what uses them several times computes them once, and reads only its columns.
    by: columns that the rows are dealt by, so that groups by these and more columns need no further shuffle."""
    spark, at = df.sparkSession, shared_folder(df.sparkSession, name)
    if not by:
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)
    table = at.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").option("path", at).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).saveAsTable(table)
    return spark.table(table)


#: How a session takes a folder's files: tasks that list it (a task a folder otherwise, up to 10,000); what opening a file counts as in bytes
#: (4 MB otherwise, so a task takes 30 files, and what it writes is as small); and bytes a task (128 MB otherwise, which is 2 GB of a log's text).
LISTING, OPENING, TAKING = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Within, many folders of small compressed files, such as logs, are listed and read by fewer tasks, and large ones by more."""
    wanted = {LISTING: 4 * spark.sparkContext.defaultParallelism, OPENING: 1 << 17, TAKING: 1 << 25}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
