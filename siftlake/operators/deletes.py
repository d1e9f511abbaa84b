"""Deletes from partitioned tables by copy-on-write of the partitions that hold doomed rows; all other files stay as they are.

A delete that is stopped and run again gives the same table: what is doomed is found anew in what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write(rows: DataFrame, path: str, parts: list[str]) -> None:
    """A table in folders by its partition columns, one file for each task and folder."""
    rows.repartition(*parts).write.mode("overwrite").partitionBy(*parts).parquet(path)


def read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _folder(parts: dict) -> str:
    return "/".join(f"{k}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for k, v in parts.items())


def delete(spark: SparkSession, path: str, schema: str | StructType, parts: list[str], doomed: Column | DataFrame, on: list[str] | None = None) -> dict[str, int]:
    """Delete the rows for which the condition `doomed` holds, or whose columns `on` are among the rows `doomed`. Returns rows, partitions and files that it deleted or wrote anew.

    Only partitions with doomed rows are written anew, in one overwrite of just these; partitions without survivors go. The list of touched partitions
    is as long as there are such folders."""
    table = read(spark, path, schema)
    by_column = isinstance(doomed, Column)
    placed = table.select("*", F.col("_metadata.file_path").alias("_file"))
    dead = placed.filter(F.coalesce(doomed, F.lit(False))) if by_column else placed.join(doomed, on, "left_semi")
    files = dead.select(*parts, F.col("_file").alias("file")).groupBy(*parts).agg(F.count(F.lit(1)).alias("dead"), F.countDistinct("file").alias("files"))
    touched = [r.asDict() for r in files.collect()]
    if not touched:
        return {"rows": 0, "partitions": 0, "files": 0}
    # folders without a value have a condition of their own, as a list does not match them
    inside = F.lit(False)
    for row in touched:
        one = F.lit(True)
        for c in parts:
            one = one & F.col(c).eqNullSafe(F.lit(row[c]))
        inside = inside | one
    rows = table.filter(inside)
    left = rows.filter(~F.coalesce(doomed, F.lit(False))) if by_column else rows.join(doomed, on, "left_anti")
    kept = {tuple(r) for r in left.select(*parts).distinct().collect()}
    left.select(table.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    of = spark._jvm.org.apache.hadoop.fs.Path
    for row in touched:
        if tuple(row[c] for c in parts) not in kept:
            at = of(f"{path}/{_folder({c: row[c] for c in parts})}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return {"rows": sum(r["dead"] for r in touched), "partitions": len(touched), "files": sum(r["files"] for r in touched)}
