"""Redacted copies as a transactional sink: staged by tasks, read back, and published only then.

A folder of copies holds data files, each of one bucket of documents, and versions: manifests that list the files that
are visible. A run writes new files only. Spark's tasks write them through a Python data source whose commit gathers what
each successful attempt wrote into a staged manifest; files of attempts that were lost are in none, and an aborted run
deletes its own. published() reads the staged files back through Spark, and only if they hold what was to be written, and
every document of the run is settled (or the run is held for review), a new version is put in place by a rename that
refuses to replace another one. So a reader sees the old copies or the new ones, whole, and never a copy that failed.

A version replaces documents, not files: only the buckets that hold documents of the run are written again, with the other documents
that they hold; the files of all others keep their names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "redacted_copies"
BUCKETS = 64
BUCKET = "_bucket"
ROWS = 1 << 16


class SameAsSource(ValueError):
    """Copies must never be written over what they are copies of."""


class Conflict(RuntimeError):
    """Another run has published the same buckets meanwhile."""


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """For Python workers: the file system of a path and the path in it, as Spark's own file systems name it."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]  # bucket, file, rows


class CopyWriter(DataSourceArrowWriter):
    """Writes rows that come by bucket: one file open at a time, read back once it is closed."""

    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.root)
        files: list[dict] = []
        folder = f"data/{self.run}"
        fs.create_dir(f"{root}/{folder}", recursive=True)
        out, stream = None, None

        def close() -> None:
            nonlocal out, stream
            if out is not None:
                out.close()
                stream.close()
                out = None
                with fs.open_input_file(f"{root}/{files[-1]['file']}") as f:
                    there = pyarrow.parquet.ParquetFile(f).metadata.num_rows
                if there != files[-1]["rows"]:
                    raise OSError(f"{files[-1]['file']} holds {there} rows of {files[-1]['rows']}")

        for batch in iterator:
            at = batch.schema.get_field_index(BUCKET)
            buckets, start = batch.column(at).to_pylist(), 0
            while start < batch.num_rows:
                stop = start + 1
                while stop < batch.num_rows and buckets[stop] == buckets[start]:
                    stop += 1
                rows = batch.slice(start, stop - start)
                if out is None or files[-1]["bucket"] != buckets[start]:
                    close()
                    files.append({"bucket": buckets[start], "file": f"{folder}/b{buckets[start]:05d}-{uuid.uuid4().hex}.parquet", "rows": 0})
                    stream = fs.open_output_stream(f"{root}/{files[-1]['file']}")
                    out = pyarrow.parquet.ParquetWriter(stream, batch.schema.remove(at), compression="zstd")
                out.write_batch(rows.select([c for c in batch.schema.names if c != BUCKET]), row_group_size=ROWS)
                files[-1]["rows"] += rows.num_rows
                start = stop
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.root)
        fs.create_dir(f"{root}/_staged", recursive=True)
        with fs.open_output_stream(f"{root}/_staged/{self.run}.json") as f:
            f.write(json.dumps({"run": self.run, "files": [x for m in messages if m for x in m.files]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.root)
        for m in messages:
            for x in m.files if m else ():
                fs.delete_file(f"{root}/{x['file']}")


@dataclass
class CopyFile(InputPartition):
    file: str


class CopyReader(DataSourceReader):
    """The files of the newest version, each a partition. visible() reads the same through Spark's own Parquet reader."""

    def __init__(self, root: str, names: list[str]):
        self.root, self.names = root, names

    def partitions(self) -> list[CopyFile]:
        return [CopyFile(x["file"]) for x in newest(self.root)[1]["files"]]

    def read(self, partition: CopyFile) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(self.root)
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            yield from pyarrow.parquet.ParquetFile(f).iter_batches(batch_size=1024, columns=self.names)


class CopySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return newest(self.options["path"])[1]["ddl"]

    def reader(self, schema) -> CopyReader:
        return CopyReader(self.options["path"], schema.names)

    def writer(self, schema, overwrite: bool) -> CopyWriter:
        if "run" not in self.options:
            raise ValueError("copies are written by staged(), which names a run")
        return CopyWriter(self.options["path"], self.options["run"])


def newest(root: str) -> tuple[int, dict]:
    """(number, manifest) of the newest version, read without Spark."""
    fs, path = file_system(root)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{path}/_versions", allow_not_found=True))
    name = max((x.path for x in found if x.path.endswith(".json")), default=None)
    if name is None:
        return 0, {"files": [], "ddl": "", "buckets": BUCKETS}
    with fs.open_input_stream(name) as f:
        return int(name.rpartition("/")[2].removesuffix(".json")), json.loads(f.read())


@dataclass
class Staged:
    root: str
    run: str
    base: int  # the version that the run saw
    buckets: int
    ddl: str
    files: list[dict]
    touched: frozenset[int]
    expected: tuple[int, int]  # rows, and the sum of their hashes


def _digest(rows: DataFrame) -> tuple[int, int]:
    """Number of rows, and a sum of their hashes that does not hang on their order."""
    nested = ("array", "map", "struct")
    hashed = F.xxhash64(*(F.to_json(F.struct(c)) if rows.schema[c].dataType.typeName() in nested else F.col(c) for c in sorted(rows.columns)))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hashed.cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
    return got["n"], int(got["h"])


def _bucketed(rows: DataFrame, buckets: int, key: tuple[str, ...]) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(key[0]), F.lit(buckets)).cast("int"))


def staged(rows: DataFrame, root: str, key: tuple[str, ...] = ("doc_id",), buckets: int = BUCKETS, source: str | None = None) -> Staged:
    """Write rows as a run, in place of those of the same key (its first column deals them into buckets): nothing of it is visible yet.

    Documents that the newest version holds in the same buckets, and that rows does not replace, are written with them. rows is
    read more than once: store it first if it is dear. source: the path that rows were made from, which is refused as root.
    """
    spark = rows.sparkSession
    if source is not None and _same(spark, root, source):
        raise SameAsSource(root)
    spark.dataSource.register(CopySource)
    base, manifest = newest(root)
    buckets = manifest["buckets"] if base else buckets
    fresh = _bucketed(rows, buckets, key)
    touched = frozenset(r[0] for r in fresh.select(BUCKET).distinct().collect())  # as many as buckets at most
    old = [x for x in manifest["files"] if x["bucket"] in touched]
    if old:
        kept = spark.read.schema(manifest["ddl"]).parquet(*(f"{root}/{x['file']}" for x in old)).join(rows.select(*key).distinct(), [*key], "left_anti")
        fresh = fresh.unionByName(_bucketed(kept, buckets, key), allowMissingColumns=True)
    run = uuid.uuid4().hex
    dealt = fresh.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET)  # large buckets are split and small ones put together by size
    dealt.write.format(FORMAT).mode("append").option("path", root).option("run", run).save()
    fs, path = file_system(root)
    with fs.open_input_stream(f"{path}/_staged/{run}.json") as f:
        files = json.loads(f.read())["files"]
    whole = fresh.drop(BUCKET)
    return Staged(root, run, base, buckets, ", ".join(f"`{n}` {t}" for n, t in whole.dtypes), files, touched, _digest(whole))


def _same(spark: SparkSession, a: str, b: str) -> bool:
    """Whether one of two paths is the other or lies in it."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    x, y = (str(path(p).getFileSystem(conf).makeQualified(path(p))).rstrip("/") + "/" for p in (a, b))
    return x.startswith(y) or y.startswith(x)


def stored_rows(spark: SparkSession, run: Staged) -> DataFrame:
    """What a run has written, read back."""
    if not run.files:
        return spark.createDataFrame([], run.ddl)
    return spark.read.schema(run.ddl).parquet(*(f"{run.root}/{x['file']}" for x in run.files))


def published(spark: SparkSession, run: Staged, verified: bool, hold: bool = False) -> int | None:
    """The number of the new version, or nothing if the run was withdrawn: it did not verify, or its files do not hold what was to be written."""
    sound = _digest(stored_rows(spark, run)) == run.expected
    if not sound or not (verified or hold):
        withdrawn(run)
        return None
    while True:
        number, manifest = newest(run.root)
        if number != run.base:
            seen = {x["file"] for x in version(run.root, run.base)["files"]} if run.base else set()
            if any((x["file"] not in seen) and x["bucket"] in run.touched for x in manifest["files"]) or manifest["buckets"] != run.buckets:
                withdrawn(run)
                raise Conflict(f"version {number} holds other copies of the same buckets")
        files = [x for x in manifest["files"] if x["bucket"] not in run.touched] + run.files
        body = json.dumps({"run": run.run, "held": not verified, "buckets": run.buckets, "ddl": run.ddl, "files": sorted(files, key=lambda x: (x["bucket"], x["file"]))})
        if _renamed(spark, run, number + 1, body):
            return number + 1


def _renamed(spark: SparkSession, run: Staged, number: int, body: str) -> bool:
    """Put a manifest in its place if no other is there."""
    fs, path = file_system(run.root)
    with fs.open_output_stream(f"{path}/_staged/{run.run}.json") as f:
        f.write(body.encode())
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    source, target = hadoop(f"{run.root}/_staged/{run.run}.json"), hadoop(f"{run.root}/_versions/{number:09d}.json")
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    if files.exists(target):
        return False
    return bool(files.rename(source, target))


def withdrawn(run: Staged) -> None:
    """Delete what a run has staged."""
    fs, path = file_system(run.root)
    fs.delete_dir_contents(f"{path}/data/{run.run}", missing_dir_ok=True)
    if fs.get_file_info(f"{path}/_staged/{run.run}.json").type != pyarrow.fs.FileType.NotFound:
        fs.delete_file(f"{path}/_staged/{run.run}.json")
    if fs.get_file_info(f"{path}/data/{run.run}").type != pyarrow.fs.FileType.NotFound:
        fs.delete_dir(f"{path}/data/{run.run}")


def version(root: str, number: int) -> dict:
    fs, path = file_system(root)
    with fs.open_input_stream(f"{path}/_versions/{number:09d}.json") as f:
        return json.loads(f.read())


def visible(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The copies of the newest or of an earlier version; nothing if none was ever published."""
    manifest = newest(root)[1] if number is None else version(root, number)
    if not manifest["ddl"]:
        return None
    files = [f"{root}/{x['file']}" for x in manifest["files"]]
    return spark.read.schema(manifest["ddl"]).parquet(*files) if files else spark.createDataFrame([], manifest["ddl"])


def cleaned(root: str) -> int:
    """Delete files that no version lists, as lost attempts leave them, when no run is under way; how many there were."""
    fs, path = file_system(root)
    manifests = [version(root, int(x.base_name.removesuffix(".json"))) for x in fs.get_file_info(pyarrow.fs.FileSelector(f"{path}/_versions", allow_not_found=True))]
    known = {x["file"] for m in manifests for x in m["files"]}
    loose = [x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(f"{path}/data", recursive=True, allow_not_found=True)) if x.is_file and x.path.removeprefix(f"{path}/") not in known]
    for file in loose:
        fs.delete_file(file)
    return len(loose)
