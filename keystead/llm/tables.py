"""Reading of the given tables by the columns a query needs, and the package's own code for the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..session import stored, work_dir

__all__ = ["read", "ship", "stored", "work_dir"]
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that their Python workers can import it.

    Also lowers the bytes of an Arrow batch where the session has not set them.
    """
    if spark.conf.get(BATCH_BYTES, None) == "67108864b":  # Spark's own default: long texts make large batches
        spark.conf.set(BATCH_BYTES, "16m")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix=f"{root.name}-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df
