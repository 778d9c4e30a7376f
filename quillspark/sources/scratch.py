"""The shared folder for intermediate tables.

It is the session's ``spark.checkpoint.dir``, which driver and executors share.  Without one, a session in one process gets a temporary folder of
this machine, which goes when the process ends; on a cluster there is no folder that all are sure to see, so the setting is asked for.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="quillspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir("file://" + folder)
    return "file://" + folder
