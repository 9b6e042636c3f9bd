"""The shared folder for tables that a job writes for itself."""

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`, which the driver and all executors share.

    Only a local session may do without the setting; it gets a temporary folder of its process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="billweave-"))
        root = _own[0]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
