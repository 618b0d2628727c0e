"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Decimals stay exact, times are in UTC, and joins and partitions are planned anew at run time. Everything else is the cluster's choice.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def session(name: str = "granary", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()
