"""Written intermediate tables in the folder all executors share.

An operator that reads an intermediate result more than once writes it first, so that
losing an executor replays a read and never a half-finished, differently ordered
computation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a fresh folder only where none is set and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    path = context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="pairlift-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/pairlift-{app}/{label}-{uuid.uuid4().hex}"


def stable(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_workspace(spark: SparkSession) -> bool:
    """Delete every table this application has written in the shared folder; results that read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pairlift-{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Plans of these nodes alone are a scan: reading such a table twice costs a scan and no more.
_SCAN_NODES = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "Relation", "LocalRelation", "LogicalRDD"}


def _name(node) -> str:
    return node.nodeName().split(" ")[0]


def _is_broadcast(node) -> bool:
    """Whether a side of a join carries the hint that ``small_or_plain`` gives to literal rows."""
    while _name(node) in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return _name(node) == "ResolvedHint" and _is_scan(node.children().apply(0))


def _is_scan(node) -> bool:
    """Whether ``node`` only scans files, or looks rows of a scan up in a broadcast table: no shuffle, the same rows in the same places each time."""
    children = node.children()
    sides = [children.apply(i) for i in range(children.size())]
    if _name(node) == "Join":
        return node.joinType().toString() == "Inner" and _is_scan(sides[0]) and _is_broadcast(sides[1])
    if _name(node) == "Union":
        return all(map(_is_scan, sides))
    return _name(node) in _SCAN_NODES and all(map(_is_scan, sides))


def written(df: DataFrame, label: str = "input") -> DataFrame:
    """``df`` itself if it only scans files or looks their rows up in broadcast tables, else a written copy.

    For operators that read their input more than once: the work behind it runs once.
    """
    return df if _is_scan(df._jdf.queryExecution().analyzed()) else stable(df, label)
