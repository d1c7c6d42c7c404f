"""What the operators share: reading tables, writing intermediate tables, making workers find this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of a batch that goes to a Python worker, so that long texts come a few at a time.
BATCH = "8m"
#: Tables written within each `passing()` that is open.
_PASSING: list[list[str]] = []


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started, bound their batches, and return the session."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [env.get("PYTHONPATH")])])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a new folder if all runs in this process; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="statrill-", dir="/tmp")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept_until_exit(spark: SparkSession, path: str) -> str:
    """The path of a written table, which goes when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, after: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors. `after` keeps it
    beyond the innermost passing()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/statrill-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    scopes = _PASSING[:-1] if after else _PASSING
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(kept_until_exit(spark, path))


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within, other than those for after it, are deleted at its end: nothing may read them then."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free(df: DataFrame, name: str) -> str:
    """A name like the one given that no column of the table has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named, whatever else the table holds."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
