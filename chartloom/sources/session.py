"""What a session needs before Python workers can run this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows go to Python in batches of this many bytes, unless the session says otherwise: texts can be long.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"
#: Python workers give memory back: large arrays when they go, Arrow buffers by the same way, so that one stage's don't
#: add up with the next one's in a worker that serves both.
READY = "CHARTLOOM_READY"
LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(2 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2"}


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and bounds what they hold."""
    environment = spark.sparkContext.environment
    if READY not in environment and spark.sparkContext.getConf().get(BATCH[0]) is None:
        spark.conf.set(*BATCH)  # once, so that a later setting holds
    for name, value in {READY: "1", **LEAN}.items():
        environment.setdefault(name, os.environ.get(name, value))
    root = str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))
