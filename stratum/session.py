"""Session construction for programs, benches and tests."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "stratum", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time; ``conf`` adds or replaces settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    # Python workers import this package by name, wherever the session was started.
    home = str(Path(__file__).resolve().parents[1])
    settings["spark.executorEnv.PYTHONPATH"] = os.pathsep.join(dict.fromkeys([home, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    if (master or "").startswith("local"):
        os.environ["PYTHONPATH"] = settings["spark.executorEnv.PYTHONPATH"]
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
