"""Progress: counts that never fall, and no page counted twice when tasks run again."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from veilspark.plans.progress import Progress
from veilspark.plans.redaction import redact
from veilspark.sources.rules import RuleBook

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RETRIED = """
import tempfile
from pyspark import TaskContext
from pyspark.sql import SparkSession
from veilspark.plans.progress import Progress

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
progress = Progress(spark, 1000)

def late(batches):
    for batch in batches:
        yield batch
        if TaskContext.get().partitionId() % 3 == 0 and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost")

pages = spark.range(0, 1000, 1, 7)
counted = progress.counted(pages, "masked").mapInArrow(late, pages.schema)
rows = counted.count()
again = counted.count()
print("RESULT", rows, again, progress.by_phase(), progress.done)
"""


def test_tasks_that_run_again_count_once():
    said = subprocess.run([sys.executable, "-c", RETRIED], cwd=HERE, capture_output=True, text=True, timeout=180)
    assert "RESULT 1000 1000 {'masked': 1000} 1000" in said.stdout, said.stdout + said.stderr[-3000:]
    assert "lost" in said.stderr


def test_progress_of_a_run(spark):
    pages = spark.range(0, 300, 1, 5).select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("write to u"), F.col("id"), F.lit("@mail.example"))).otherwise("nothing here").alias("text"))
    progress = Progress(spark, 300)
    assert (progress.done, progress.phase, progress.by_phase()) == (0, None, {})
    book = RuleBook.parse(spark, "emails\n")
    out = redact(pages, book, progress=progress)
    assert progress.by_phase() == {"masked": 300, "read back 1": 100} and progress.phase == "read back 1" and progress.done == 300
    plain = redact(pages, book)
    assert sorted(map(tuple, out.pages.collect())) == sorted(map(tuple, plain.pages.collect()))
    with pytest.raises(ValueError):
        progress.counted(pages, "masked")


def test_done_never_falls_and_never_passes_the_total(spark):
    progress = Progress(spark, 10)
    seen = []
    for phase, n in (("a", 4), ("b", 2), ("c", 25), ("d", 0)):
        progress.counted(spark.range(n), phase).write.format("noop").mode("overwrite").save()
        seen.append(progress.done)
    assert seen == [4, 4, 10, 10] and progress.phase == "c" and progress.by_phase()["d"] == 0
    empty = Progress(spark)
    assert (empty.done, empty.phase) == (0, None)
