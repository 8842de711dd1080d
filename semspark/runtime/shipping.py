"""Getting this package to executors that do not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Zips the package and adds it to the session's Python files, so that workers can import it. Not needed where the
    package is installed on all machines or given to ``--py-files``. Returns the path of the archive."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="semspark-"), "semspark")
    archive = shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    return archive
