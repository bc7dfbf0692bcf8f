"""What the operators of this subpackage share: reading, checkpoints, stable hashing, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker turns into objects at a time. Spark itself bounds an Arrow batch by its bytes (64 MB unless set otherwise).
BATCH_ROWS = 512

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, without copies."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only a local session may go without: it gets one of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = sc.getConf().get("spark.checkpoint.dir")
        if not own:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="framelake-checkpoint-")
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again.

    This cuts the lineage as a checkpoint does and outlives lost executors; later reads take only the columns they need.
    Checkpointed plans also carry their constraints along, which grow without end in a loop; a table's plan has none.
    Spark removes the shuffle files of the write when it ends: the table is there, and nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by stored() that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(conf).delete(at, True)


def whole_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row as one struct `row` beside its text, for operators that take an id: whole rows then go through them."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for the row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text is divisible by five; such rows are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
