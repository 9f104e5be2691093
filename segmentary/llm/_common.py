"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Ids or hashes (8 bytes each) up to which they are sent to all executors; above, tables are joined by shuffles.
BROADCAST_KEYS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="segmentary-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a folder of our own, if all runs on this machine; on a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path or _own_dir()


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/segmentary/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there and survives lost executors.

    Results read these files, so they stay until ``release``.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_to_all(keys: DataFrame) -> DataFrame:
    """A written table of one number a row, to be sent to all executors unless it is larger than ``BROADCAST_KEYS``."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def release(spark: SparkSession) -> None:
    """Delete what this application wrote into the shared folder, once its results have been written elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def struct_of(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else _parse_datatype_string(schema)


def map_batches(df: DataFrame, function: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | StructType) -> DataFrame:
    """Apply a function of Arrow batches. ``function()`` is called once per task and returns what maps a batch to columns."""
    kind = struct_of(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = function()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(apply(batch), schema=arrow)

    return df.mapInArrow(run, kind)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column, null as the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_rows(df: DataFrame, function: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of ``df``, all columns, for which the function of Arrow batches says true. No shuffle, no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = function()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(apply(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def id_bucket(column: str, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(n)


def sampled(rows: DataFrame, key: str, by: str, bound: int | dict) -> DataFrame:
    """Of each value of ``by`` about ``bound`` rows, picked by a hash of ``key``: one narrow count, then a filter without a shuffle."""
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    span = 1 << 30
    share = F.lit(0)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        limit = bound[value] if isinstance(bound, dict) else bound
        share = F.when(F.col(by) == F.lit(value), F.lit(span if n <= limit else int(span * limit / n))).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(71)), F.lit(span)) < share)
