"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bound a Python worker's memory where texts are long.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Smaller batches for this session (plans read the setting when they run), so that very long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="genoframe-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: later steps don't run its plan again.

    The plan's shuffle files go once the driver's garbage is collected, which is asked for here, else they'd pile up on the executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_sweep, spark, path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that stored() gave back; they must not be read afterwards."""
    for df in tables:
        _sweep(df.sparkSession, df.stored_at)


def _sweep(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended
        return


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs without the rows of bad (doc_id, text_hash), which goes by a doc_id, null or not, and the hash of its text. docs may have any other columns.

    bad grows with docs, so it isn't broadcast at any size."""
    return docs.alias("d").join(bad.select("doc_id", "text_hash").distinct().hint("merge").alias("b"), F.expr("d.doc_id <=> b.doc_id and xxhash64(d.text) = b.text_hash"), "left_anti")


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_kept: list = []


def sole(make):
    """make's last result is kept, and those of other functions so marked are let go: a worker that serves several operators holds one's memo at a time."""
    cached = lru_cache(1)(make)

    @wraps(make)
    def get(*args):
        if _kept[:1] != [cached]:
            for other in _kept:
                other.cache_clear()
            _kept[:] = [cached]
        return cached(*args)

    return get


class Memo(dict):
    """A bounded memo. When full it keeps what it has, and is emptied once as many more keys were missed (the data have changed)."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.missed = most, 0

    def keep(self, key, value) -> None:
        if len(self) < self.most:
            self[key] = value
        else:
            self.missed += 1
            if self.missed > self.most:
                self.clear()
                self.missed = 0
