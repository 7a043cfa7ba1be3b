"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode (tests) a temporary folder where it is unset."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if folder:
        return folder
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


_open: list[list[str]] = []


def remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are removed at the end, but for those it is asked to keep."""
    _open.append([])
    try:
        yield
    finally:
        remove(spark, _open.pop())


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that what follows doesn't
    recompute it and a lost executor can't change it. Column names and types stay.

    Within ``scratch`` the table goes at its end; one to ``keep`` goes with the scratch around that, if there is one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with row numbers in its order as ``name``, written once: numbers that are made again at each read change
    when Spark cuts the files differently, as it does with other numbers of cores."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))
