"""Tables written in passing, so that what is costly to make is made once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, written to the folder that driver and executors share (spark.checkpoint.dir; where that is unset, one below the warehouse) and read back."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kept"
    path = f"{top}/k-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
