"""Helpers that the corpus operators share: the cluster's shared folder and Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: One chunk of text that a NumPy kernel looks at, in bytes. A longer single text is one chunk.
CHUNK_BYTES = 1 << 20


#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The table, for a kernel over its texts: batches are cut by bytes, so a batch of long documents doesn't fill a worker. Only ever lowers the session's limit."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one where it names none, which only a local session may do."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terravane-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/terravane/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes `df` as a table in the shared folder and reads it again, which cuts its lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of `materialise` that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def added_name(taken: Iterable[str], name: str) -> str:
    """The name under which an operator adds a column: with as many underscores behind it as it takes to differ from all taken ones, as Spark compares names."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    yield batch.slice(start, n - start)
