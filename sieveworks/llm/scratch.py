"""Tables that cut lineage, in the folder that every executor shares."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_WRITTEN: list[str] = []


class Shared:
    """A broadcast object whose class also travels by value; the caller bounds its size."""

    def __init__(self, spark: SparkSession, value: Any) -> None:
        self._sent, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    @property
    def value(self) -> Any:
        if self._value is None:
            self._value = pickle.loads(self._sent.value)
        return self._value


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one of its own only where it is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sieveworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """Writes df once and reads it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{folder(spark)}/sieveworks-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(docs: DataFrame) -> DataFrame:
    """docs with _row, which no two rows share: the place in its files where docs is a scan of some, else in a stored copy."""
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))
    try:
        return docs.select("*", place.alias("_row"))
    except AnalysisException:
        return table(docs).select("*", place.alias("_row"))


def clean(spark: SparkSession) -> None:
    """Deletes what this process has written here; results that still read it must be stored first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
