"""What the operators of this subpackage have in common."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder, stash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash_by(df: DataFrame, key: str, tag: str, dealt: bool = False) -> DataFrame:
    """stash() as a table bucketed by key: joins by it don't shuffle the table again.  Its name leaves with the session.

    dealt: the rows of df lie by key already, so that each task writes few buckets.
    """
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path, n = f"{shared_folder(spark)}/{name}", n_partitions(spark)
    (df if dealt else df.repartition(n, key)).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.table(name)


def unstash(df: DataFrame) -> None:
    """Delete a stashed table that no later plan reads, so that it holds no disk."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def free_name(name: str, columns: list[str]) -> str:
    """The name, with as many underscores after it as it takes that no column has it (letter case aside)."""
    used = {c.lower() for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def split_of(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus: the fold that decides which labels may be learned."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
