"""Shared helpers: tables, scratch tables in the shared checkpoint folder, let-bindings."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words: space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, read through Spark's own file systems."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where it is unset the warehouse, unless that is a local folder and executors are elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir"), spark.conf.get("spark.master", "")
    if warehouse.startswith(("file:", "/")) and not re.match(r"local($|\[)", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; the driver's file system removes it at exit."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).deleteOnExit(target)
    return path


def stored(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, never the work that
    made this table, and readers prune columns as on any Parquet table. A narrow table (a few numbers a row) is written
    by an eighth of a shuffle's tasks, two a core at least: a file costs more than its rows there.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it in body, also below other lambdas.

    Catalyst may inline a column into a lambda that runs once for each array element;
    a lambda variable is never inlined, so the value is computed once for each row.
    """
    return F.transform(F.array(value), body).getItem(0)


def literal_array(values: list[int], kind: str = "int") -> Column:
    """A constant array, folded when the query is planned."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
