"""Makes this package importable where its Python functions run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends the package's code to the workers, unless they find it on their path as the driver does.

    Once for each application; Spark serves the archive to every executor, new
    ones too.
    """
    application = spark.sparkContext.applicationId
    above = str(_ROOT.parent)
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if application in _shipped or above in (os.path.realpath(p) for p in found if p):
        return
    archive = Path(tempfile.mkdtemp(prefix="codeloom-code-")) / "codeloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(_ROOT.rglob("*.py")):
            z.write(file, Path("codeloom") / file.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)
