"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to a Python worker: bounds the worker's memory for very long texts.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20

#: White space of the text contracts, as a Java and RE2 class.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir. Where that is unset a new one is set on a single machine; a cluster refuses."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = sc._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='groundsearch-')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


#: Rows of a narrow table that one file of the shared folder holds, about.
FILE_ROWS = 250_000


def files_for(rows: int) -> int:
    """How many files a narrow table of so many rows is written to."""
    return max(1, -(-rows // FILE_ROWS))


def materialised(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df computed once and written to the shared folder; its lineage ends there. The files go when the frame does, where Spark is set so.

    rows, if known, keeps the number of files, and of tasks that write them, in proportion.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(files_for(rows))).checkpoint()


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: for frames of which later steps read a few columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow over bounded batches; function takes and gives a RecordBatch."""
    arrow_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary() if batch.column(column).type == pa.string() else pa.large_binary()).to_pylist()


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also where body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
