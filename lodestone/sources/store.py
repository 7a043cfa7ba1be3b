"""Tables written where driver and executors both reach them: what follows doesn't compute them anew."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where the session names no folder, as in tests on one machine.
LOCAL_FOLDER = "spark-warehouse"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else a folder of its warehouse; off one machine it must be set."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if not folder:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir', LOCAL_FOLDER)}/lodestone-{spark.sparkContext.applicationId}"
    return folder


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table of its own, read back with its columns and types."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
