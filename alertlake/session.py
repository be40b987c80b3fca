"""Session settings used by the library. A cluster's own settings are never overridden."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(app: str = "alertlake", master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    given = SparkConf()  # what the cluster or the command line sets
    for key, value in {**{k: v for k, v in SETTINGS.items() if not given.contains(k)}, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
