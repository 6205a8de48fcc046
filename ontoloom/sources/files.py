"""Files as tables: CSV, JSON, text and binary files, plain or packed, and configuration."""

from __future__ import annotations

import configparser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a payload that may be stored, at most.
LARGEST = 100 << 20


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV file with a header under a schema; what does not fit it is null."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, lines: bool = True) -> DataFrame:
    """JSON records, one to a line, or else one list of them; files that end on .gz are unpacked."""
    return spark.read.json(path, schema=schema, multiLine=not lines)


def read_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """value: the lines of text files, or each whole; files that end on .gz are unpacked."""
    return spark.read.text(path, wholetext=whole)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of files: what downloads leave in the store."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def write_csv(df: DataFrame, path: str, packed: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', compression="gzip" if packed else "none")


def write_json(df: DataFrame, path: str, packed: bool = False) -> None:
    df.write.mode("overwrite").json(path, compression="gzip" if packed else "none")


def write_text(df: DataFrame, column: str, path: str, packed: bool = False) -> None:
    """One line for each row that is not null."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path, compression="gzip" if packed else "none")


def payloads(df: DataFrame, base64: Column, largest: int = LARGEST) -> DataFrame:
    """df with payload and its size: what Base64 text holds, null where it is more than `largest` bytes or not Base64."""
    size = F.octet_length(base64) / 4 * 3
    data = F.try_to_binary(base64, F.lit("base64"))
    df = df.withColumn("payload", F.when(size <= largest + 2, data))
    return df.withColumn("payload", F.when(F.length("payload") <= largest, F.col("payload"))).withColumn("size", F.length("payload").cast("long"))


def paged(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with page: its key cut into ranges of `size`, so that any page is one filter on the key and pages need no order."""
    return df.withColumn("page", F.floor(F.col(key) / size))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def configuration(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """The sections of an INI file, read by whatever Spark reads the path with."""
    parser = configparser.ConfigParser()
    parser.read_string("\n".join(r["value"] for r in read_text(spark, path, whole=True).collect()))
    return {s: dict(parser[s]) for s in parser.sections()}
