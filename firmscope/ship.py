"""Send this repository's Python code to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once an application, so that
    workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    folder = tempfile.mkdtemp(prefix="firmscope-code-")
    path = os.path.join(folder, "firmscope_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((_ROOT / "firmscope").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
        for p in sorted(_ROOT.glob("*_pipeline.py")):
            z.write(p, p.name)
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
