"""Tables in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``, else one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tables").rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/boxloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a table of :func:`materialise` that nothing needs any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
