"""Tables that are computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, written to the folder that all machines share (``spark.checkpoint.dir``): later steps read it, whatever executors are lost, and their plans begin there.

    In a local session without that setting the warehouse folder stands in; on a cluster that is an error.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_kept")
    return df.checkpoint()
