"""Working tables in the folder that the whole cluster shares.

Executors can be lost at any time, so intermediate results that several jobs read
are written to the folder named by ``spark.checkpoint.dir`` and read back; nothing
is kept on a machine-local disk of a cluster.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="spreadframe-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is scratch space
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet and return the table read back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that is never broadcast.

    Spark takes a table's size from its compressed files and counts neither what an explode adds nor what rows take up
    in memory, so a table of some MB can fill the driver.
    """
    return df.hint("merge")


def drop_table(df: DataFrame) -> None:
    """Remove a table made by :func:`written` that no later job reads."""
    spark, files = df.sparkSession, df.inputFiles()
    if files and "/part-" in files[0]:
        folder = files[0].rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[0].replace("file:", "").replace("//", "").strip("/") == shared_dir(spark).replace("file:", "").replace("//", "").strip("/"):
            _remove(spark, folder)
