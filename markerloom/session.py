"""Session helpers shared by every operator: table access, cut lineage, size-checked broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when its counted rows and their bytes stay below these bounds.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one on a single machine where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context_dir = spark.sparkContext.getCheckpointDir()
    if context_dir:
        return context_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="markerloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return


def clean(spark: SparkSession) -> None:
    """Delete every table :func:`materialize` wrote; call it when the results that read them are no longer needed."""
    for own, path in list(_written):
        if own is spark:
            _delete(spark, path)
            _written.remove((own, path))


def _width(field: T.StructField) -> Column:
    """Bytes of a value, about: of text, bytes and arrays by their length."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 16 + 8
    return F.lit(8)


def sized_broadcast(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if its counted rows and bytes prove the side small; otherwise leave the join to a shuffle (adaptive skew splitting applies)."""
    width = reduce(add, [_width(f) for f in df.schema.fields])
    n, size = df.limit(bound + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= bound and size <= BROADCAST_BYTES else df


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in ``columns`` (all, if none are named), as conditions that reach the scan."""
    return df.where(reduce(and_, [F.col(f"`{c}`").isNotNull() for c in columns or df.columns]))


def spread(df: DataFrame) -> DataFrame:
    """Rows of too few files over all cores before costly work on each row; inputs of enough partitions are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
