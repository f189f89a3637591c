"""Session helpers: checkpoint folder and plan-time size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoint(): the one the cluster names, else a scratch one in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="strideframe-ckpt-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df as a table written once in the shared checkpoint folder.

    The lineage ends there, a lost executor costs no recomputation, and the next
    plan sees the table's true size. (checkpoint() carries the size estimates of
    the plan it replaces, which multiply from round to round in a loop.)
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/strideframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that cut() returned, once the tables made from them are written and no plan reads them any more."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def any_row(df: DataFrame) -> bool:
    return not df.isEmpty()
