"""A local session with the settings that the queries assume; on a cluster the deployment sets its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyspark")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
