"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; a folder of this machine only where it is unset and Spark runs on this machine alone."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:/tmp/checkpoints"


_MADE = threading.local()


def _made() -> list[tuple[str, str]]:
    """(name, path) of what this thread has written and not dropped."""
    if not hasattr(_MADE, "paths"):
        _MADE.paths = []
    return _MADE.paths


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage and survives lost executors.

    rows: how many rows are sent to Python functions at once, where they are long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillmask-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    if rows is not None:
        spark.conf.set(BATCH, rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    _made().append((name, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in what this thread writes, for tidy."""
    return len(_made())


def tidy(spark: SparkSession, since: int, *keep: str) -> None:
    """Drops the tables written since a mark, but for those of the names that are still read."""
    made = _made()
    for name, path in made[since:]:
        if name not in keep:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    made[since:] = [m for m in made[since:] if m[0] in keep]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not use, for columns added on the way."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def octets(text):
    """UTF-8 length of a text column, null as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
