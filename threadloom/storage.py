"""Where lineage is cut: the folder that the driver and all executors share."""

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where unset (tests), one of this machine."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not at:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="threadloom-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder: they outlive lost executors and aren't computed again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any store that Spark can write to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_folder(spark: SparkSession, at: str) -> bool:
    """Whether a path of any store that Spark can read is a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def clustered(rows: DataFrame, key: str) -> DataFrame:
    """rows in order of a key, over all cores at least: as they are where their partitions hold ranges of it already, else dealt out by ranges."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.rdd.getNumPartitions()
    spans = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low is not null").orderBy("low").collect()  # one row a partition
    if len(spans) < cores or any(a["high"] >= b["low"] for a, b in zip(spans, spans[1:])):
        rows = rows.repartitionByRange(max(cores, parts), key)
    return rows.sortWithinPartitions(key)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in ``order``, from 0, counted without bringing all of them to one task.

    Rows are dealt out by ranges of the order and kept; each range is numbered by itself, from the sum of the ranges before
    it, of which there are as many as shuffle partitions.
    """
    part, base = f"{name}__part", f"{name}__base"
    ranged = cut(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = {r[part]: r["n"] for r in ranged.groupBy(part).agg(F.count("*").alias("n")).collect()}  # one row a partition
    bases, upto = [], 0
    for p in sorted(sizes):
        bases.append((p, upto))
        upto += sizes[p]
    at = rows.sparkSession.createDataFrame(bases, f"{part} int, {base} bigint")
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return ranged.withColumn(name, local).join(F.broadcast(at), part).withColumn(name, (F.col(base) + F.col(name)).cast("bigint")).drop(part, base)
