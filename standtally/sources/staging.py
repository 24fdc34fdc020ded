"""Tables staged in the shared checkpoint folder, and size checks before a broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A broadcast side has at most this many rows and about this many bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

_LOCAL_ROOTS: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where it is unset and the session is local, one
    temporary folder per application, which goes when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        root = tempfile.mkdtemp(prefix="standtally-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _LOCAL_ROOTS[context.applicationId] = root
    return _LOCAL_ROOTS[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the staging root."""
    return f"{staging_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage, survives lost executors, has known size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ingest(df: DataFrame, name: str, splits: int | None = None) -> DataFrame:
    """Store an input once as Parquet; an input of few splits spreads over all cores first.

    ``splits`` is the number of splits of what the input is read from. Asking the input itself
    would run its shuffles, and an input that is shuffled is spread already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if splits is None:
        splits = df.rdd.getNumPartitions()
    return stage(df.repartition(cores) if splits < cores else df, name)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed small table as a plan literal, so that the planner knows its size."""
    fields = T.StructType.fromDDL(schema).fields
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: eight per column, plus texts and elements."""
    size = F.lit(8 * len(df.columns)).cast("bigint")
    for field in df.schema.fields:
        column = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType | T.MapType):
            size = size + 16 * F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0))
    return size


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table is small enough to be sent to every executor, by rows and by bytes.

    Every task sends two numbers, so asking is cheap however large the table is.
    """
    rows, size = df.agg(F.count("*"), F.sum(_row_bytes(df))).first()
    return rows <= max_rows and (size or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a table of checked size; leave any other to a shuffled join."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df
