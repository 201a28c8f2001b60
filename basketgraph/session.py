"""What iterative jobs share: tables in the shared folder and portable random numbers."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset on one machine (tests), a new local folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="basketgraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths made in the scopes of scratch() that are open, the innermost last.
_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Removes what is written within when it ends; what is passed to the function that it gives stays, as in `return keep(df)`.

    keep() writes its rows outside of the scope (to that around it, if there is one).
    """
    own: list[str] = []
    _scopes.append(own)

    def keep(df: DataFrame, name: str = "kept") -> DataFrame:
        _scopes.remove(own)
        try:
            return materialize(df, name)
        finally:
            _scopes.append(own)

    try:
        yield keep
    finally:
        _scopes.remove(own)
        remove(spark, own)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes paths in any file system that Spark writes to."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cuts lineage: the rows are written to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Rows numbered from 0 in an order, without bringing them together: by ranges, how many come before each, and the place within."""
    ranges = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # a row a range
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return ranges.join(F.broadcast(starts), "_range").withColumn(name, place).drop("_range", "_before")


def uniform(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) from a seed and columns, the same however rows are partitioned, and easy to write in SQL."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)
