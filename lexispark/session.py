"""Makes the package known to Python workers, on any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Texts are kilobytes each and some are very long, so what goes to a worker at once is bounded by bytes.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> None:
    """Send the package to the executors, once an application. Spark itself carries the file to every executor, also
    to those that start later."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="lexispark-")) / "lexispark.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path("lexispark") / p.relative_to(here))
    spark.sparkContext.addPyFile(str(at))
    _sent.add(app)
