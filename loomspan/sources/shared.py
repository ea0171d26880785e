"""The folder all executors share, for cut lineage and for files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
#: Used only where the session names no shared folder, as in local tests.
LOCAL_FALLBACK = "/tmp/loomspan-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: what the session or context names, else (local mode only) our own."""
    sc = spark.sparkContext
    told = spark.conf.get(CONF, None) or sc.getConf().get(CONF)
    if told:
        return told.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError(f"set {CONF} to a folder that all executors share")
    return LOCAL_FALLBACK


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=eager)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, later reads prune columns."""
    path = f"{shared_dir(df.sparkSession)}/loomspan-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_file(spark: SparkSession, data: bytes, suffix: str) -> str:
    """Write ``data`` as a new file of the shared folder; returns its URI."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomspan-{uuid.uuid4().hex}{suffix}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(data), 0, len(data))
    finally:
        out.close()
    return fs.makeQualified(path).toString()
