"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only where that is unset in local mode (tests, one machine) does a temporary
    folder stand in; a cluster without the setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="knotweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor then costs a reread, not a recomputation, and what looks at
    the table twice sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/knotweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that ``saved`` wrote, once nothing reads it any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        assert folder.getParent().getName() == "knotweave"
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Bytes of files up to which a table is dealt over the cores by a shuffle.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer splits than there are cores.

    Only tables of files of at most ``SPREAD_BYTES`` together are shuffled for
    that: a larger one has splits enough to work on.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < cores
    return df.repartition(cores) if few and _file_bytes(df) <= SPREAD_BYTES else df


def _file_bytes(df: DataFrame) -> int:
    """What the optimizer's statistics say of a table's size: its files' bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Rows and bytes up to which a side of a join is broadcast.
SMALL_ROWS, SMALL_BYTES = 500_000, 64 << 20


def _bytes(name: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    value = F.col(f"`{name}`")
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.octet_length(value) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return F.octet_length(F.array_join(value, "")) + 16 * F.size(value) + 16
        return 16 * F.size(value) + 16
    return F.lit(16) if isinstance(kind, T.AtomicType) else F.octet_length(F.to_json(F.struct(value))) + 16


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether ``df`` is counted to have at most ``rows`` rows and ``SMALL_BYTES`` bytes; counting stops there."""
    size = F.lit(0).cast("long")
    for field in df.schema:
        size = size + F.coalesce(_bytes(field.name, field.dataType), F.lit(16))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(size)).first()
    return n <= rows and (total or 0) <= SMALL_BYTES


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small; a larger one is left to a shuffled join."""
    return F.broadcast(df) if is_small(df, rows) else df
