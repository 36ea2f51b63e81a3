"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once and read from there: what reads it several times neither repeats nor depends on its plan.

    ``spark.checkpoint.dir`` names the folder. Only a session whose driver does all the work itself may leave that unset; it
    gets a temporary folder. The files stay there for as long as the folder does.
    """
    spark = frame.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/docloom-tables"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
