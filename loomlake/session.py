"""Session helpers: a tuned local session and shipping this package to Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: a zip served by the driver, once per application; nothing to do where PYTHONPATH names the repository."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    at = Path(tempfile.mkdtemp(prefix="loomlake-ship-")) / "loomlake.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((ROOT / "loomlake").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a local master, where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomlake.scratch.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master {master})")
        at = f"file://{tempfile.mkdtemp(prefix='loomlake-')}"
        spark.conf.set("loomlake.scratch.dir", at)
    return at


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that has its name only when it is complete; False if the name is taken."""
    fs, p = file_system(spark, path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(at, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.exists(p) and fs.rename(at, p):
        return True
    fs.delete(at, False)
    return False


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lost executors cost a read, not the lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*dfs: DataFrame) -> None:
    """Remove the tables of earlier cut() calls that nothing reads any more."""
    for df in dfs:
        if path := getattr(df, "_cut_path", None):
            fs, p = file_system(df.sparkSession, path)
            fs.delete(p, True)


def local(cores: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("loomlake")
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
