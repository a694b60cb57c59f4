"""Tables that an operator writes between two of its steps.

They go to the folder named by ``spark.checkpoint.dir``, which all executors share, so a
lost executor costs at most the tasks that it ran.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Only a local session that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="spark-llm-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


#: Rows of an Arrow batch, unless the session sets another number: texts of a few KB make a few
#: MB then, which bounds what a Python worker and the JVM beside it hold at once.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, str(BATCH_ROWS))


#: Partitions of a shuffle where the session has Spark's default of 200. Up to 200
#: (spark.shuffle.sort.bypassMergeThreshold) each task writes a file for each partition, which
#: costs more than a small table's rows; for more, it sorts its rows by partition into one file.
PARTITIONS = 256


@contextmanager
def sorted_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside write one file for each task and shuffle; a number of partitions that the
    session sets itself stays."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    if before == "200":  # Spark's default
        spark.conf.set(name, str(PARTITIONS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str, keep: bool = False, **options: object) -> DataFrame:
    """Writes the rows as Parquet and returns them as read from there; with ``keep``, release
    leaves the table."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    if not keep:
        _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a stored table that no later step reads."""
    _delete(df.sparkSession, df._scratch_path)


def release(spark: SparkSession) -> None:
    """Deletes all stored tables; call it once results that read them are written."""
    for path in list(_written):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _written:
        _written.remove(path)
