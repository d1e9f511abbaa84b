"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_case(text: Column) -> Column:
    """A-Z to a-z, other letters unchanged; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(data: bytes) -> list[bytes]:
    """Words of UTF-8 bytes, A-Z lower-cased. bytes.split() splits at exactly the six characters of SPACES."""
    return data.translate(LOWER_BYTES).split()


def fold_of(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5))


_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of our own serves in local mode only, as other machines could not read it."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftlake-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


@atexit.register
def _remove_written() -> None:
    """Results may be read until the program ends; then the tables go, if Spark is still there to remove them."""
    sc = SparkContext._active_spark_context
    for path in _WRITTEN if sc is not None and sc._jsc is not None else ():
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def stash(df: DataFrame) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and read them back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.add(path)
    return spark.read.schema(df.schema).parquet(path)
