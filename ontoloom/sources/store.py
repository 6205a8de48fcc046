"""Tables in the folder that all executors share, and keyed writes to tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, which all executors have to see; a session on one machine gets a default."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints/ontoloom"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: an iteration goes on from files, not from a growing plan.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def replace_table(df: DataFrame, path: str, sort_by: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """Drop, create and insert: df in place of what is at path, sorted within files by its lookup key."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: list[str]) -> None:
    """Rows of new in place of stored rows with their key.

    The merged table is written aside first and then renamed, so a failure leaves the old one readable.
    """
    from ..operators.relational import upsert

    aside = f"{path}.{uuid.uuid4().hex}"
    upsert(spark.read.parquet(path), new, key).write.parquet(aside)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(path), True)
    fs.rename(fs_path(aside), fs_path(path))


def delete_rows(spark: SparkSession, path: str, ids: DataFrame, key: list[str]) -> DataFrame:
    """The stored rows whose key is not among ids."""
    return spark.read.parquet(path).join(ids.select(*key), key, "left_anti")


def add_column(df: DataFrame, name: str, value) -> DataFrame:
    """df with a column if it lacks it; nulls in it are filled."""
    if name in df.columns:
        return df.withColumn(name, F.coalesce(F.col(name), value))
    return df.withColumn(name, value)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes(id, label) and edges(src, dst, score) as a GEXF file, streamed row by row through the driver."""
    from xml.sax.saxutils import quoteattr as q

    with open(path, "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected">\n<nodes>\n')
        for n in nodes.select("id", "label").toLocalIterator():
            out.write(f"<node id={q(str(n['id']))} label={q(str(n['label']))}/>\n")
        out.write("</nodes>\n<edges>\n")
        for k, e in enumerate(edges.select("src", "dst", "score").toLocalIterator()):
            out.write(f'<edge id="{k}" source={q(str(e["src"]))} target={q(str(e["dst"]))} weight="{e["score"]}"/>\n')
        out.write("</edges>\n</graph></gexf>\n")


def write_svg(nodes: DataFrame, edges: DataFrame, path: str, size: int = 800) -> None:
    """nodes(id, label, level) and edges(src, dst) as an SVG drawing: a ring for each level, in order of labels.

    A drawing is for eyes, so it is made on the driver; nodes and edges of more than a few thousand are no drawing.
    """
    import math
    from xml.sax.saxutils import escape

    rings: dict[int, list] = {}
    for n in nodes.orderBy("level", "label", "id").toLocalIterator():
        rings.setdefault(n["level"], []).append((n["id"], n["label"]))
    middle, step, at = size / 2, size / 2 / (len(rings) + 0.5), {}
    for r, level in enumerate(sorted(rings)):
        for k, (i, _) in enumerate(rings[level]):
            turn = 2 * math.pi * k / len(rings[level])
            at[i] = middle + (r + 0.5) * step * math.cos(turn), middle + (r + 0.5) * step * math.sin(turn)
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">\n')
        for e in edges.select("src", "dst").toLocalIterator():
            if e["src"] in at and e["dst"] in at:
                (x, y), (u, v) = at[e["src"]], at[e["dst"]]
                out.write(f'<line x1="{x:.1f}" y1="{y:.1f}" x2="{u:.1f}" y2="{v:.1f}" stroke="gray"/>\n')
        for ring in rings.values():
            for i, label in ring:
                out.write(f'<text x="{at[i][0]:.1f}" y="{at[i][1]:.1f}">{escape(str(label))}</text>\n')
        out.write("</svg>\n")
