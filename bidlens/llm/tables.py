"""Reading the given tables and staging intermediate ones."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.session import cut_lineage

WORD = "[^\\x20\\x09-\\x0D]+"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless their PYTHONPATH has it already."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_bidlens_sent", False):
        return
    package = os.path.join(root, "bidlens")
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "bidlens.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(archive)
    context._bidlens_sent = True


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unclashed(df: DataFrame, known: set[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with all columns but the ``known`` ones renamed, so that helper columns cannot clash, and the new names."""
    names = [c if c in known else f"given_column_{k}" for k, c in enumerate(df.columns)]
    return df.toDF(*names), names


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, safe against lost executors."""
    return cut_lineage(df, label)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again; later tables were written from it and do not go back to it."""
    files = df.inputFiles()
    if files:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(conf).delete(folder, True)


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
