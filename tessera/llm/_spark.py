"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.storage import new_folder

#: A table is broadcast up to this many measured bytes, and joined by shuffle beyond.
BROADCAST_BYTES = 32 << 20

#: The word pattern of the contracts, for Java and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts its lineage,
    and the loss of an executor does not lose it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs whose results are written.

    Its cleaner removes them once the driver has collected the plans, which a
    driver with a large heap may not do for hours.
    """
    gc.collect()
    spark._jvm.System.gc()


def text_column(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc(column: Column) -> Column:
    """CRC-32 of a value's text form."""
    return F.crc32(column.cast("string").cast("binary"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Bind a value once for an expression that uses it more than once."""
    return F.transform(F.array(value), then)[0]


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of ``df`` takes, arrays and texts by their own length."""
    total = F.lit(16).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType):
            item = 8 * max(1, len(f.dataType.elementType)) if isinstance(f.dataType.elementType, T.StructType) else 8
            total = total + 16 + F.coalesce(F.size(f.name), F.lit(0)) * item
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + 16 + F.coalesce(F.octet_length(f.name), F.lit(0))
        else:
            total = total + 8
    return total


def small_enough(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows are measured to be small in all; else Spark joins it by shuffle."""
    size = df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
