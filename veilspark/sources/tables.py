"""Pages in, redacted copies out: readers, run folders, names that never overwrite."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NoSharedFolder(RuntimeError):
    """Executors do not see what the driver or another executor writes to a folder of its own machine."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset the warehouse, unless that is a local folder and executors are elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir"), spark.conf.get("spark.master", "")
    if warehouse.startswith(("file:", "/")) and not re.match(r"local($|\[)", master):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_scratch"


class Store:
    """Tables of one run, in the shared checkpoint folder (the warehouse where none is set) unless a folder is given."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        root = folder or shared_folder(spark)
        self.spark, self.folder = spark, f"{root.rstrip('/')}/run-{uuid.uuid4().hex}"
        target = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt out to all cores, for texts that are made from them: a file of one row group is one task otherwise."""
    return rows.repartition(max(3 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page a document."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page"), "text")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages of one document."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text", "role")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as pages: doc_id is the path; unreadable ones stay, with empty text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.lit(1).alias("page"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, extension: str = "pdf") -> DataFrame:
    """Files by extension in any case, with bytes: for a page reader given by the caller."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter(F.lower("path").endswith(f".{extension}")).select("path", "length", "content")


def readable(pages: DataFrame) -> DataFrame:
    """pages with status: ok, or no_text where there is nothing to examine."""
    return pages.withColumn("status", F.when(F.rlike(F.coalesce("text", F.lit("")), F.lit(r"(?U)\S")), "ok").otherwise("no_text"))


def annotations(pages: DataFrame) -> DataFrame:
    """(doc_id, page, value) of annotations, an array of struct<value, contents>: both are strings to match."""
    each = pages.select("doc_id", "page", F.explode("annotations").alias("a"))
    return each.select("doc_id", "page", F.explode(F.array("a.value", "a.contents")).alias("value")).filter("value is not null and value <> ''")


def output_name(name: str, taken: set[str] = frozenset()) -> str:
    """'report.pdf' -> 'report redacted.pdf', then 'report redacted 2.pdf' and so on."""
    stem, dot, extension = name.rpartition(".")
    stem, extension = (stem, dot + extension) if dot and stem else (name, "")
    n, out = 1, f"{stem} redacted{extension}"
    while out in taken:
        n += 1
        out = f"{stem} redacted {n}{extension}"
    return out


def published(result: DataFrame, staging: str, final: str, verified: bool, hold: bool = False) -> str | None:
    """Write to staging; only a verified result (or one held for review) is renamed to its final path, which must
    not exist. Returns the path, or nothing if the result was withdrawn."""
    spark = result.sparkSession
    result.write.parquet(staging)
    path = spark._jvm.org.apache.hadoop.fs.Path
    source, target = path(staging), path(final)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (verified or hold):
        files.delete(source, True)
        return None
    if files.exists(target):
        files.delete(source, True)
        raise FileExistsError(final)
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"{staging} could not be moved to {final}")
    return final


def replaced(existing: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """existing with all rows of the documents in fresh replaced by fresh's."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def withdrawn(spark: SparkSession, path: str) -> bool:
    """Delete a plan or a redacted copy that is not wanted any more; whether there was one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
