"""A session with the settings the library counts on."""

from pyspark.sql import SparkSession


def session(name: str = "tidemill", **conf: str) -> SparkSession:
    """UTC and adaptive execution; further settings override."""
    builder = SparkSession.builder.appName(name)
    held = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for key, value in held.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
