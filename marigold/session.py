"""One place for the session settings that queries and tests rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "marigold", *, cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the caller brings its own. Only settings that hold at every size are fixed here."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(max(8, n)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
