"""Tables that cut lineage: written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a new temporary one in local mode, as in tests, else an error."""
    if not (folder := spark.conf.get(_SETTING, None)):
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set(_SETTING, folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder. It stays there, as results may be read from it later."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
