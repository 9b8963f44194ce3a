"""A session with the settings that the operators count on, and tables between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def stored(df: DataFrame, path: str | None) -> DataFrame:
    """``df`` written once and read back; as it is where no path is given."""
    if path is None:
        return df
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_path(spark: SparkSession, name: str) -> str | None:
    """A path of its own in the folder that driver and executors share,
    ``spark.checkpoint.dir``. Where none is named, local mode has a temporary folder; on a
    cluster there is no such path, and what would be stored is worked out again."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            return None
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="pactlens-")
        named = _own[app]
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins; partitions follow the data, not a fixed count."""
    b = SparkSession.builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
