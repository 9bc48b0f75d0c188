"""Session helpers: the shared scratch folder, lineage cuts and table loading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder that the driver and every executor share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset on a
    single machine, as in tests, a temporary folder is made instead, and removed
    at exit; a cluster must name the folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _OWN.setdefault(app, "")
        if not root:
            made = tempfile.mkdtemp(prefix="arborlake-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            root = _OWN[app] = "file://" + made
    return root.rstrip("/")


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Writes ``df`` once to the shared folder and returns the written table.

    This cuts the lineage: a lost executor costs a re-read of files, never a
    re-run of what made them.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Empties a table that ``materialise`` wrote, once nothing that is still to be computed reads it."""
    files = df.inputFiles()
    if files:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
