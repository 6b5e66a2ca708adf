"""What the engine needs of a session that Spark users have built themselves."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it.

    On a cluster the package is installed or given with ``--py-files``; the driver's folder is then only one more entry.
    """
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if here not in paths:
        env["PYTHONPATH"] = ":".join([*paths, here])
    return spark
