"""Sessions: the package on the executors, and lineage cuts in the folder all of them share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="mosaica-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session has none, a new local folder, but only if driver and executors are one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mosaica-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: the plan starts afresh and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with numbers from 0 in the order of ``by``: range partitions are numbered alone and then offset, so no task sees all rows."""
    rows = cut(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__p", F.spark_partition_id()), "numbered")
    before = rows.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n"))
    at = F.row_number().over(Window.partitionBy("__p").orderBy(by)) - 1
    return rows.withColumn("__at", at).join(before, "__p").withColumn(name, F.col("__before") + F.col("__at")).drop("__p", "__n", "__before", "__at")
