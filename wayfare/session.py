"""Sessions, and what workers need to import the package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def session(app: str = "wayfare", **conf: str) -> SparkSession:
    """A session with adaptive plans; local if nothing else is configured."""
    builder = SparkSession.builder.appName(app)
    if not os.environ.get("SPARK_REMOTE") and "spark.master" not in conf:
        builder = builder.master(os.environ.get("WAYFARE_MASTER", "local[*]"))
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_wayfare_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="wayfare-"), "wayfare-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in [*(_ROOT / "wayfare").rglob("*.py"), *_ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(_ROOT))
    context.addPyFile(path)
    context._wayfare_shipped = True
