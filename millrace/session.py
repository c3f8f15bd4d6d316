"""SparkSession for local use and tests; on a cluster the session comes from outside and is left as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: What every plan here relies on, whoever made the session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def local_session(cpus: int | str | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("millrace").config("spark.driver.memory", memory)
    builder = builder.config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
